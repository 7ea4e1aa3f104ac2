import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm.neighbours import distances, nearest


def vectors():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 8))
    points = (centres[draw.integers(0, 6, 700)] + 0.3 * draw.normal(size=(700, 8))).astype(np.float32)
    points[100:400] = points[100]  # one very common vector
    return [(k, [float(x) for x in p]) for k, p in enumerate(points)]


def brute(rows, k):
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(usable):
        if i is None or i % 100:
            continue
        others = [(j, w) for b, (j, w) in enumerate(usable) if b != at and len(w) == len(v)]
        if others:
            apart = distances(np.array([v]), np.array([w for _, w in others]))[0]
            ranked = sorted(zip(apart.tolist(), [-1 if j is None else j for j, _ in others]))
            out.setdefault(i, []).append(ranked[:k])
    return out


@pytest.mark.parametrize("shard", [64, 8192])
def test_factor_one_is_exact(spark, shard):
    rows = vectors() + [(800, None), (900, [0.0] * 8), (1000, [float("nan")] * 8), (1100, [1.0, None] * 4), (1200, []), (1300, [1.0, 2.0]),
                        (1301, [1.0, 2.5]), (1400, [float("inf")] * 8), (0, vectors()[0][1]), (None, vectors()[5][1])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").withColumns({c: F.lit(c) for c in ("row", "id", "v", "query", "size", "shard", "block")})
    found = nearest(df, F.col("vec_id") % 100 == 0, shard_rows=shard, query_rows=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, -1 if r.id is None else r.id))
    for i, lists in brute(rows, 10).items():
        assert sorted(got[i]) == sorted(x for part in lists for x in part)
    assert set(got) == set(brute(rows, 10))


def test_smaller_factors_keep_most_neighbours(spark):
    df = spark.createDataFrame(vectors(), "vec_id int, embedding array<float>")
    exact, found = (
        {(r.query_id, r.score) for r in nearest(df, F.col("vec_id") % 50 == 0, factor=f, shard_rows=256).collect()} for f in (1.0, 0.5)
    )
    assert len(exact & found) >= 0.9 * len(exact)


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], "vec_id int, embedding array<float>")
    one = spark.createDataFrame([(0, [1.0])], "vec_id int, embedding array<float>")
    assert nearest(none, F.lit(True)).count() == nearest(one, F.lit(True)).count() == 0
