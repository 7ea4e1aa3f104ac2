import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagegrain.llm import spelling
from pagegrain.llm.spelling import decomposed, edit_bound, gram_dictionary, list_keys, near_words, signatures, spelling_variants, variants
from tests.llm.brute import ascii_lower


GRAMS = (spelling.SHORTEST, spelling.LONGEST)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_words(docs, least=7, noise=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 2}


def plain(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


def rows(found):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect())


def misspelt(seed, count):
    """Words over few letters with many neighbours, counts from 2 to 5,000."""
    random = np.random.default_rng(seed)
    letters = list("abcdé")
    words = {}
    for _ in range(count):
        word = "".join(random.choice(letters, random.integers(7, 11)))
        words[word] = int(random.integers(100, 5000))
        for _ in range(random.integers(0, 4)):
            at = int(random.integers(0, len(word)))
            kind = random.integers(0, 3)
            other = word[:at] + (str(random.choice(letters)) if kind else "") + word[at + (kind < 2) :]
            if len(other) >= 7:
                words[other] = int(random.integers(2, 60))
                word = other
    return words


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_against_all_pairs(spark, limit):
    words = misspelt(limit, 120)
    found = variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), limit=limit)
    assert rows(found) == plain(words)
    assert any(row[3] for row in plain(words))


def test_whole_documents(spark):
    text = "Éléphant éléphant straße STRASSE straßen" + " elephant" * 40 + " elefant elephent Elephant elephantt elephantts"
    docs = [(k, f"{text} word{k} wordlike wordlikes {'wordlike ' * 9}") for k in range(40)] + [(None, "straßen wordlike"), (3, None), (4, ""), (3, text)]
    words = plain_words(docs)
    found = spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    assert rows(found) == plain(words)
    chains = {row[0]: row for row in plain(words)}
    assert chains["elephantt"][3] == "elephant" and chains["elephantts"][5] == chains["elephantts"][0]


def test_roots_follow_chains_and_ties(spark):
    words = {"aaaaaaaaa": 100_000, "aaaaaaaab": 1_000, "aaaaaaabb": 100, "aaaaaabbb": 10, "aaaaaabbc": 10, "aaaaaaabc": 100}
    found = {r.word: r for r in variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert rows(variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))) == plain(words)
    assert found["aaaaaabbb"].form == "aaaaaaabb" and found["aaaaaabbb"].root == "aaaaaaaaa"
    assert found["aaaaaabbc"].form == "aaaaaaabc"


def test_empty_table_clashing_columns_and_very_long_words(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "few short")], "doc_id bigint, text string")).count() == 0
    long = "ab" * 100_000
    docs = [(1, f"{long} {long} {long}c {long}c", "x", 1), (2, f"{long[1:]} {long[1:]}", "y", 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word string, n int")
    found = {len(r.word): r.n_near for r in spelling_variants(df, noise=0).collect()}
    assert found == {200_000: 2, 200_001: 1, 199_999: 1}


def test_bound_holds_for_every_edit(spark):
    words = list(misspelt(9, 60))
    known = gram_dictionary(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), limit=3)
    assert {len(g) for g in known} == set(GRAMS)
    for a in words[:40]:
        grams = decomposed(a, known, *GRAMS)
        bound = edit_bound(a, grams, known, GRAMS[1])
        assert bound < len(grams)
        edits = {a[:k] + x + a[k + cut :] for k in range(len(a) + 1) for x in ("", "a", "b", "é") for cut in (0, 1)} - {a}
        for b in (e for e in edits if one_edit(a, e) and len(e) >= 7):
            shared = Counter(grams) & Counter(decomposed(b, known, *GRAMS))
            assert shared.total() >= len(grams) - bound
            assert list_keys(a, known) & list_keys(b, known)
            changed = [(x ^ y).bit_count() for x, y in zip(signatures(a), signatures(b), strict=True)]
            assert changed[0] <= 2 and changed[1] <= 4


def test_grams_must_leave_room(spark):
    with pytest.raises(ValueError, match="as long as"):
        near_words(spark.createDataFrame([("abcdefg", 2)], "word string, n bigint"), least_length=6)
    assert spelling.SHORTEST + spelling.LONGEST <= spelling.LEAST_LENGTH


def test_pairs_on_both_sides_of_the_length_of_the_short_way(spark):
    random = np.random.default_rng(3)
    words = {}
    for size in range(spelling._SHORT - 2, spelling._SHORT + 3):
        word = "".join(random.choice(list("abcé"), size))
        for at in (0, size // 2, size - 1):
            words |= {word: 500, word[:at] + word[at + 1 :]: 20, word[:at] + "z" + word[at + 1 :]: 30, word[:at] + "y" + word[at:]: 40}
    found = variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert rows(found) == plain(words) and any(form for _, _, _, form, _, _ in rows(found))
