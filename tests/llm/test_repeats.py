import hashlib
import random

import numpy as np
import pytest

from pagegrain.llm.queries import op3_suffix_array_dedup
from pagegrain.llm.repeats import Bytes, Words, runs
from pagegrain.llm.substring import levels, remove_repeated_words
from pagegrain.llm.suffix_array import depths, remove_repeated_strings
from tests.llm import brute


def texts(seed):
    """Shared passages, copies, periodic and short texts, with some nulls."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abé ") for _ in range(draw.randint(1, 4)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows = []
    for k in range(40):
        parts = [" ".join(word() for _ in range(draw.randint(0, 30))), draw.choice(passages)[draw.randint(0, 30) :]]
        rows.append((draw.randint(0, 30), "\n".join(parts)))
    rows += [(1, None), (2, ""), (50, rows[0][1]), (51, "ab" * 300), (52, "x" * 500), (53, "a b " * 90), (None, passages[0])]
    return rows


@pytest.mark.parametrize("threshold", [10, 25])
def test_repeated_strings_like_brute_force(documents, threshold):
    rows = texts(3)
    found = remove_repeated_strings(documents(rows), threshold=threshold).select("doc.text", "doc.row", "cut").collect()
    assert len(found) == len(rows) and {r.row for r in found} == {"row"}
    data = [(r.text or "").encode() for r in found]
    for r, units, gone in zip(found, data, brute.removed(data, threshold, False), strict=True):
        kept = bytes(np.frombuffer(units, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.cut.n, r.cut.n_removed, r.cut.n_spans, bytes(r.cut.kept)) == (len(units), gone.sum(), spans, kept)


def test_planted_passages_are_cut_by_their_bytes_not_by_their_words(documents):
    draw = random.Random(12)
    word = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    clean = lambda: " ".join(word(draw.randint(3, 9)) for _ in range(120))
    # 66 words of 329 bytes, 80 words of 399 and of 400 bytes, 51 words of 509 bytes
    passages = [" ".join(word(k) for k in lengths) for lengths in ([4] * 66, [4] * 80, [4] * 79 + [5], [9] * 51)]
    rows, planted = [(k, clean()) for k in range(20)], []
    for k, passage in enumerate(passages):
        for side in (0, 1):
            planted.append((100 + 2 * k + side, len(passage), f"{clean()}{'<>'[side]}{passage}{'[]'[side]}{clean()}"))
    found = remove_repeated_strings(documents(rows + [(d, t) for d, _, t in planted])).select("doc.doc_id", "cut.n_removed").collect()
    assert [len(p) for p in passages] == [329, 399, 400, 509]
    assert {r.doc_id: r.n_removed for r in found} == {d: 0 for d, _ in rows} | {d: n if n >= 400 else 0 for d, n, _ in planted}


@pytest.mark.parametrize("words", [4, 6])
def test_words_of_repeated_passages_like_brute_force(documents, words):
    rows = texts(5) + [(60, "a b c d e f " * 9), (61, "u v w x y z"), (62, "u  v\nw\tx y z")]
    found = remove_repeated_strings(documents(rows), threshold=25, words=words).select("doc.text", "cut", "n_passage_words").collect()
    plain = remove_repeated_strings(documents(rows), threshold=25).select("doc.text", "cut").collect()
    assert [(r.text, r.cut) for r in found] == [(r.text, r.cut) for r in plain]
    marks = brute.removed([brute.spaced_words(r.text) for r in found], words, False)
    assert [r.n_passage_words for r in found] == [int(gone.sum()) for gone in marks]


def test_registered_query_shows_passages_of_over_50_words_below_its_bytes(spark, tmp_path):
    draw = random.Random(13)
    word = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    clean = lambda: " ".join(word(draw.randint(3, 9)) for _ in range(120))
    # 51 words of 254 bytes, 50 words of 249 bytes, 70 words of 489 bytes
    passages = [" ".join(word(k) for _ in range(n)) for k, n in ((4, 51), (4, 50), (6, 70))]
    rows = [(k, clean()) for k in range(20)] + [(20, None), (21, "")]
    rows += [(100 + 2 * k + side, f"{clean()} {passage} {clean()}") for k, passage in enumerate(passages) for side in (0, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    expected = {d: 0 for d, _ in rows} | {100: 51, 101: 51, 104: 70, 105: 70}
    assert {d: r.n_passage_words for d, r in found.items()} == expected
    assert {d for d, r in found.items() if r.n_removed} == {104, 105}
    kept = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in rows if d < 104}
    assert {d: found[d].kept_sha256 for d in kept} == kept


def test_repeated_words_like_brute_force(documents):
    rows = [(k, t) for k, (_, t) in enumerate(texts(4))]
    random.Random(1).shuffle(rows)
    found = remove_repeated_words(documents(rows), words=6).select("doc.doc_id", "doc.text", "cut").orderBy("doc_id").collect()
    data = [brute.spaced_words(r.text) for r in found]
    for r, units, gone in zip(found, data, brute.removed(data, 6, True), strict=True):
        kept = " ".join(u for u, g in zip(units, gone) if not g)
        assert (r.cut.n, r.cut.n_removed, bytes(r.cut.kept).decode()) == (len(units), gone.sum(), kept)


def test_equal_ids_keep_one_of_equal_texts(documents):
    text = " ".join(f"w{k}" for k in range(30))
    found = remove_repeated_words(documents([(1, text), (1, text), (None, text)])).select("doc.doc_id", "cut.n_removed").collect()
    assert sorted(r.n_removed for r in found) == [0, 30, 30]
    assert {r.n_removed for r in found if r.doc_id is None} == {0}


def test_empty_tables(documents):
    assert remove_repeated_words(documents([])).count() == 0
    assert remove_repeated_strings(documents([])).count() == 0


def test_runs_cover_every_window_once_even_in_blocks(monkeypatch):
    import pagegrain.llm.repeats as repeats

    monkeypatch.setattr(repeats, "_BLOCK", 64)
    units = Bytes([bytes(random.Random(2).choices(b"ab", k=k)) for k in (500, 0, 3, 20, 200, 7)])
    for gram in (5, 20):
        parts = list(runs(units.values(), units.sizes, 20, gram))
        covered = [(o, w) for p in parts for o, a, n in zip(*p[:3]) for w in range(a, a + n)]
        assert covered == [*((0, w) for w in range(481)), (3, 503), *((4, w) for w in range(523, 704))]


def test_word_values_do_not_depend_on_their_place(monkeypatch):
    import pagegrain.llm.repeats as repeats

    long = " ".join(["same", "other", "x" * 300, "é"] * 30).encode()
    plain = Words([long]).values()
    monkeypatch.setattr(repeats, "_BLOCK", 100)
    assert (Words([long]).values() == plain).all()
    assert len(set(plain.tolist())) == 4


def test_depths_and_levels():
    assert depths(400) == (200, 360, 400) and levels(20) == (5, 10, 20)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
