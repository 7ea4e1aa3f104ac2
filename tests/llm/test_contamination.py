import random

import pytest

from pagegrain.llm.contamination import contamination
from tests.llm import brute


def expected(rows, items, size):
    """Hit words, byte ranges of the maximal runs and item ids for each text."""
    windows = {}
    for name, text in items:
        words = brute.plain_words(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(name)
    out = []
    for text in rows:
        words, hit, names = brute.plain_words(text), set(), set()
        for window, own in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    names |= own
        out.append((len(words), hit, sorted(str(n) for n in names if n is not None)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_like_brute_force(spark, documents, block):
    draw = random.Random(5)
    word = lambda: draw.choice(["Ab", "c", "d2", "é", "Éf", "k", "x_y"])
    items = [(k % 7, " ".join(word() for _ in range(draw.randint(0, 9)))) for k in range(12)] + [(None, "lonely item here"), (3, None), (4, "?!")]
    rows = [(k, "".join(word() + draw.choice([" ", ", ", "\n", "--"]) for _ in range(draw.randint(0, 60)))) for k in range(40)]
    rows += [(1, None), (2, ""), (None, "a LONELY   item: here"), (3, rows[0][1]), (3, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "'x' AS block", "'y' AS id")
    found = contamination(documents(rows), benchmark, words=4, block_bytes=block).select("doc.*", "n_words", "spans", "items").collect()
    found = [r.asDict() for r in found]
    assert len(found) == len(rows)
    for r, (n_words, hit, names) in zip(found, expected([r["text"] for r in found], items, 4), strict=True):
        assert r["n_words"] == n_words
    pairs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = contamination(pairs, benchmark, words=4, block_bytes=block).collect()
    for r, (n_words, hit, names) in zip(plain, expected([r.doc.text for r in plain], items, 4), strict=True):
        assert {k for s in r.spans for k in range(s.first, s.last + 1)} == hit
        assert [s.first for s in r.spans] == sorted(k for k in hit if k - 1 not in hit)
        assert (list(r["items"]), r.n_words) == (names, n_words)
        for s in r.spans:
            cut = r.doc.text.encode()[s.start : s.end].decode()
            assert brute.plain_words(cut) == brute.plain_words(r.doc.text)[s.first : s.last + 1]


def test_empty_sides(spark, documents):
    none = spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert [r.n_words for r in contamination(documents([(1, "a b c d")]), none).select("n_words").collect()] == [4]
    assert contamination(documents([]), some).count() == 0
