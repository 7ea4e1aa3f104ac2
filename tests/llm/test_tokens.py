import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagegrain.llm import tokens as T
from pagegrain.llm.packing import BITS, hilbert, pack
from pagegrain.llm.queries import tokenizer_path

ODD = [
    "", " ", "Hello, World's END don't 'tis I'LL x''s", "été ÀÉ naïve ﬁ ﬀ İstanbul ΣΑΣ ς ß ŉ ſ", "éä ́x Å", "日本語 テスト 12３ ½²",
    "a b c\u0085d​e﻿", "\x1ca\x1fb\x00c", "<|endoftext|> x<|startoftext|>y <|endoftext", "😀👍🏽 mixed😀text", "tab\there\n\n\r\x0b\x0cnew", "_a_b__ --- ...!?",
]


TOKENIZER = Tokenizer.from_file(tokenizer_path())


def whole(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return [*ids, 1]


@pytest.mark.parametrize("cache", [400_000, 5])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, cache):
    monkeypatch.setattr(T, "_CACHE", cache)
    draw = random.Random(6)
    signs = [chr(c) for c in [*range(1, 0x180), 0x301, 0x3A3, 0x130, 0x2028, 0x4E00, 0x1F600, 0xAD]]
    texts = ODD + ["".join(draw.choice(signs) for _ in range(draw.randint(0, 80))) for _ in range(300)]
    encoder = T.Encoder(tokenizer_path())
    for _ in range(2):
        ids, sizes = encoder(pa.array(texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [whole(t) for t in texts]


def test_variable_length_coding_round_trip():
    draw = np.random.default_rng(7)
    for size in (0, 1, 3, 4, 5, 1000):
        values = (draw.integers(0, 1 << 32, size) >> draw.integers(0, 32, size)).astype(np.uint32)
        control, data = T.pack(values)
        assert len(control) == -(-size // 4) and np.array_equal(T.unpack(control, data, np.array([size])), values)
    parts = [T.pack(np.arange(k, dtype=np.uint32) * 99) for k in (3, 0, 9)]
    joined = T.unpack(*(b"".join(p[k] for p in parts) for k in range(2)), np.array([3, 0, 9]))
    assert joined.tolist() == [k * 99 for k in (*range(3), *range(9))]
    edges = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    assert len(T.pack(edges)[1]) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4


ROWS = [(9, "Hello there, hello."), (2, None), (5, ""), (2, "two"), (None, "none"), (4, "word " * 3000), (2, "two")]


def test_files_round_trip(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    T.write_tokens(documents(ROWS), str(tmp_path / "t"), tokenizer_path())
    found = T.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    got = [(r.id, r.n, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    assert [g[0] for g in got] == [None, 2, 2, 2, 4, 5, 9]
    assert sorted((g[0] or 0, g[2]) for g in got) == sorted((r[0] or 0, whole(r[1])) for r in ROWS)
    assert [r.start for r in found] == [sum(r.n for r in found[:k]) for k in range(len(found))]
    ranks = spark.read.parquet(str(tmp_path / "t/vocabulary")).orderBy("n", ascending=False).first()
    assert ranks.n >= 3000


def test_ids_for_files_take_two_bytes_and_are_counted_as_they_are_made(documents):
    tokens, counts = T.counted(documents(ROWS).repartition(3), tokenizer_path())
    found = tokens.collect()
    assert all(len(r.ids) == 2 * r.n for r in found)
    got = sorted((r.id or 0, np.frombuffer(r.ids, "<u2").tolist()) for r in found)
    assert got == sorted((r[0] or 0, whole(r[1])) for r in ROWS)
    flat = [k for _, ids in got for k in ids]
    assert {r.token: r.n for r in counts.collect()} == {k: flat.count(k) for k in set(flat)}


def test_batches_are_tokenized_in_groups(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"text": [f"text {k}", None]}) for k in range(5)]
    assert [b.num_rows for b in T._groups(iter(batches))] == [10]
    monkeypatch.setattr(T, "_GROUP", 2 * batches[0].nbytes)
    assert [b.column("text").to_pylist()[0] for b in T._groups(iter(batches))] == ["text 0", "text 2", "text 4"]
    assert list(T._groups(iter([]))) == []


def test_ids_of_any_width_are_read_back_from_slices():
    for kind in ("<u2", "<u4"):
        ids = pa.array([np.arange(k, k + n, dtype=kind).tobytes() for k, n in ((5, 2), (9, 1), (70, 3))], pa.binary())
        assert T._values(ids[1:], pa.array([1, 3])).tolist() == [9, 70, 71, 72]
        assert T._values(ids[1:].cast(pa.large_binary()), pa.array([1, 3])).tolist() == [9, 70, 71, 72]


def test_blocks_close_within_and_across_batches(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 700)
    draw = random.Random(8)
    rows = [(draw.randrange(4000), draw.choice([None, "", "some words", "more " * draw.randrange(300), "x9 'tis Größe 日本"])) for _ in range(2500)]
    T.write_tokens(documents(rows).coalesce(1), str(tmp_path / "t"), tokenizer_path())
    files = spark.read.parquet(str(tmp_path / "t/blocks")).selectExpr("size(ids) AS n", "aggregate(sizes, 0L, (a, b) -> a + b) AS held").collect()
    assert all(f.held <= 700 or f.n == 1 for f in files) and sum(f.n for f in files) == 2500
    found = T.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.id for r in found] == sorted(r[0] for r in rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n for r in found])[:-1].tolist()]
    known = {text: whole(text) for text in {r[1] for r in rows}}
    assert sorted((r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == sorted((k, known[text]) for k, text in rows)


def test_empty_files(spark, documents, tmp_path):
    T.write_tokens(documents([]), str(tmp_path / "t"), tokenizer_path())
    assert T.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_hilbert_keys_visit_every_cell_by_unit_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        keys = hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    assert hilbert(np.full((1, 4), (1 << BITS) - 1), BITS)[0] < 1 << (4 * BITS)


def test_pieces_fill_the_sequences(documents):
    rows = ROWS + [(100 + k, f"text {k} " * (k * 7 % 40)) for k in range(60)]
    found = pack(documents(rows), tokenizer_path(), length=64).collect()
    by_document = {}
    for r in found:
        assert len(r.ids) == 4 * r.length > 0 and r.offset + r.length <= 64
        by_document.setdefault((r.id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in found) == sum(len(whole(t)) for _, t in rows)
    for k, text in rows[7:]:
        pieces = sorted(by_document[k, len(whole(text))], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == whole(text)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
    sequences = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(sequences[k] == 64 for k in range(len(sequences) - 1))
    assert pack(documents([]), tokenizer_path()).count() == 0
