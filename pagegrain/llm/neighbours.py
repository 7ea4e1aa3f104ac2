"""Nearest neighbours over vantage-point trees.

Vectors are dealt into shards of bounded size by a hash of their row, and every shard gets a tree of its own: a node holds
a vantage point and the median distance to it, which parts the rest into an inner and an outer half. A query descends into
its own half first and into the other one only if the triangle inequality lets a point there be nearer than the
worst kept: ``|d - median| <= factor * worst``. With factor one the search is exact; smaller factors prune more. Queries run
through a tree in blocks, all that are still interested in a node at once.

Distances are summed in double precision dimension by dimension, so equal vectors have exactly equal distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import keyed, python_workers

NEIGHBOURS = 10
FACTOR = 1.0
SHARD = 8192
QUERIES = 4096
_LEAF = 64
_CHUNK = 1 << 20  # distances computed at a time


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, all rows of one to all of the other; squares are added in the order of the dimensions."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        apart = a[:, k, None] - b[None, :, k]
        total += apart * apart
    return np.sqrt(total)


class Tree:
    """A vantage-point tree over the rows of a matrix; leaves are plain lists."""

    def __init__(self, points: np.ndarray, seed: int = 0):
        self.points, self.random = points, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        if len(members) <= _LEAF:
            return members
        at = int(self.random.integers(len(members)))
        vantage, rest = members[at], np.delete(members, at)
        apart = distances(self.points[vantage : vantage + 1], self.points[rest])[0]
        middle = np.median(apart)
        inner = apart <= middle
        if inner.all():  # more than half lie at the largest distance: no split
            return members
        return vantage, middle, self._build(rest[inner]), self._build(rest[~inner])


class Search:
    """The nearest of a tree's points for a block of queries."""

    def __init__(self, tree: Tree, order: np.ndarray, own: np.ndarray, queries: np.ndarray, skip: np.ndarray, k: int, factor: float):
        """order: rank of each point among equal distances; own: its row, which a query with the same ``skip`` leaves out."""
        self.tree, self.order, self.own, self.queries, self.skip, self.k, self.factor = tree, order, own, queries, skip, k, factor
        self.near = np.full((len(queries), k), np.inf)
        self.index = np.full((len(queries), k), -1)
        self.rank = np.full((len(queries), k), np.iinfo(np.int64).max)
        if len(queries):
            self._visit(tree.root, np.arange(len(queries)))

    def _offer(self, who: np.ndarray, members: np.ndarray) -> None:
        step = max(1, _CHUNK // max(1, len(who)))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            self._merge(who, some, distances(self.queries[who], self.tree.points[some]))

    def _merge(self, who: np.ndarray, members: np.ndarray, apart: np.ndarray) -> None:
        apart = np.where(self.own[members][None, :] == self.skip[who][:, None], np.inf, apart)
        closer = (apart <= self.near[who][:, -1:]) & np.isfinite(apart)
        some = closer.any(1)
        who, apart, closer = who[some], apart[some], closer[some]
        if not len(who):
            return
        columns = closer.any(0)
        apart, members = apart[:, columns], members[columns]
        near = np.concatenate([self.near[who], apart], axis=1)
        index = np.concatenate([self.index[who], np.broadcast_to(members, apart.shape)], axis=1)
        rank = np.concatenate([self.rank[who], np.broadcast_to(self.order[members], apart.shape)], axis=1)
        best = np.lexsort((rank, near), axis=1)[:, : self.k]
        for name, values in (("near", near), ("index", index), ("rank", rank)):
            getattr(self, name)[who] = np.take_along_axis(values, best, axis=1)

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._offer(who, node)
            return
        vantage, middle, inner, outer = node
        apart = distances(self.queries[who], self.tree.points[vantage : vantage + 1])
        self._merge(who, np.array([vantage]), apart)
        apart = apart[:, 0]
        inside = apart <= middle
        self._visit(inner, who[inside])
        self._visit(outer, who[~inside])
        # a little slack for rounding keeps factor one exact
        reach = self.near[who][:, -1] * self.factor * (1 + 1e-9) + 1e-12
        other = np.abs(apart - middle) <= reach
        self._visit(outer, who[inside & other])
        self._visit(inner, who[~inside & other])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def nearest(
    vectors: DataFrame, is_query: Column, vector: str = "embedding", id: str = "vec_id", k: int = NEIGHBOURS, factor: float = FACTOR,
    shard_rows: int = SHARD, query_rows: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the neighbour's id as ``id``, ``score``: for each query row its k nearest other rows.

    Ties go to the smaller id (null first). Null and zero vectors and those with null or non-finite parts take no part;
    vectors are compared with those of the same length; repeated rows are candidates of each other. A query without
    candidates, like an empty table, gives no rows.
    """
    python_workers(vectors.sparkSession)
    chosen = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = keyed(chosen.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), "__query").filter(_usable(F.col("v"))), "vectors")
    rows = rows.select("row", "doc.id", "doc.v", F.col("doc.__query").alias("query"), F.size("doc.v").alias("size"))
    total, asked = rows.agg(F.count("*"), F.count_if("query")).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // query_rows))

    def dealt(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(parts)), F.lit(parts)).cast("int").alias(column)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = rows.select("row", "id", "v", "size", dealt("shard", shards), every(blocks).alias("block"))
    asking = rows.filter("query").select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("w"), "size", "row")
    queries = asking.select("q", "query_id", "w", F.col("size").alias("q_size"), every(shards).alias("q_shard"), dealt("q_block", blocks))
    kind = rows.schema["id"].dataType.simpleString()

    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["q", "query_id", "row", "id", "score"]
        if not points.num_rows or not queries.num_rows:
            # the side that is missing comes without columns
            kind = points.schema.field("id").type if points.num_rows else queries.schema.field("query_id").type if queries.num_rows else pa.null()
            types = [pa.int64(), kind, pa.int64(), kind, pa.float64()]
            return pa.table([pa.array([], t) for t in types], names=names)
        points = points.sort_by([("row", "ascending")])
        ranked = pc.sort_indices(points, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()
        order = np.empty(len(ranked), np.int64)
        order[ranked] = np.arange(len(ranked))
        own, skip = points["row"].to_numpy(), queries["q"].to_numpy()
        found = Search(Tree(_matrix(points["v"])), order, own, _matrix(queries["w"]), skip, k, factor)
        q, at = np.nonzero(found.index >= 0)
        hit = pa.array(found.index[q, at])
        q = pa.array(q)
        columns = [queries["q"].take(q), queries["query_id"].take(q), points["row"].take(hit), points["id"].take(hit), pa.array(found.near[q.to_numpy(), at])]
        return pa.table(columns, names=names)

    found = points.groupBy("size", "shard", "block").cogroup(queries.groupBy("q_size", "q_shard", "q_block")).applyInArrow(search, f"q bigint, query_id {kind}, row bigint, id {kind}, score double")
    place = F.row_number().over(W.partitionBy("q").orderBy("score", F.asc_nulls_first("id"), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
