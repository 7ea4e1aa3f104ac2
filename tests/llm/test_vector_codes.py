import math

import numpy as np
from pyspark.sql import functions as F

from pagegrain.llm import vector_codes
from pagegrain.llm.vector_codes import compress

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale=1024):
    """Codes and errors by id, and the codebooks, with loops over all entries."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows]
    kept.sort()
    width = len(kept[0][1]) // parts
    pieces = [[v[p * width : (p + 1) * width] for _, v in kept] for p in range(parts)]
    books = [[list(v) for v in own[:entries]] for own in pieces]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry, strict=True)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for own, book in zip(pieces, books, strict=True):
            chosen = [nearest(piece, book)[1] for piece in own]
            for k in set(chosen):
                members = [piece for piece, c in zip(own, chosen, strict=True) if c == k]
                book[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [[nearest(piece, book) for piece in own] for own, book in zip(pieces, books, strict=True)]
    codes = [[part[n][1] for part in found] for n in range(len(kept))]
    errors = [sum(part[n][0] for part in found) for n in range(len(kept))]
    return sorted(zip([i for i, _ in kept], codes, errors, strict=True)), books


def coded(found):
    return sorted((r.doc.vec_id, r.codes, int(r.error)) for r in found.collect())


def test_against_loops(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "_CELLS", 200)  # several blocks
    random = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(random.normal(0, 0.2, 8))], int(i) % 3) for i in range(90)]
    rows += [(200 + i, rows[i][1], None) for i in range(5)] + [(300, [0.0] * 8, 1)]
    found, books = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=7)
    assert (coded(found), books.entries) == plain(rows, 4, 7, vector_codes.ROUNDS)
    assert books.numbers() == [x for part in books.entries for entry in part for x in entry]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.5, -0.5], 1), (9, [0.25, 0.75], 1), (None, [0.0, 0.1], None)]
    bad = [(1, None, 1), (2, [nan, 0.0], 1), (3, [inf, 0.0], 1), (4, [None, 1.0], 1), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (8, [0.0] * 4, 1), (10, [1e30, 0.0], 1)]
    found, books = compress(spark.createDataFrame(good + bad, SCHEMA), parts=2, entries=4)
    assert [len(part) for part in books.entries] == [3, 3]
    assert {r.doc.vec_id for r in found.collect()} == {5, 9, None}
    # the id null comes last among the first entries
    assert books.entries[0] == [[512], [256], [0]]


def test_large_numbers_are_exact(spark):
    rows = [(1, [3e12, 0.0], 1), (2, [-3e12, 5.0], 1), (3, [2.9e12, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found, books = compress(df, parts=1, entries=2)
    assert (coded(found), books.entries) == plain(rows, 1, 2, vector_codes.ROUNDS)


def test_ties_repeated_rows_and_columns_of_the_same_names(spark):
    rows = [(1, [0.0, 0.0], 1, "x"), (1, [1.0, 1.0], 1, "y"), (1, [1.0, 1.0], 1, "y"), (2, [0.5, 0.5], 2, "z")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, codes int, doc string")
    found, books = compress(df, parts=1, entries=3, rounds=0)
    assert books.entries == [[[0, 0], [1024, 1024], [1024, 1024]]]
    assert sorted((r.doc.doc, r.codes[0]) for r in found.collect()) == [("x", 0), ("y", 1), ("y", 1), ("z", 0)]


def test_empty_table(spark):
    found, books = compress(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and books.numbers() == []
    assert found.columns == ["doc", "codes", "error"]


def test_long_vectors(spark):
    rows = [(k, [math.sin(k * j) for j in range(4096)], k) for k in range(4)]
    found, books = compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), entries=2)
    assert (coded(found), books.entries) == plain(rows, 4, 2, vector_codes.ROUNDS)
    assert found.agg(F.max(F.size("codes"))).first()[0] == 4
