"""Positions, pages and previous rows over a whole table without gathering a group in one task.

A global order is cut into *buckets* at split points, taken from a bounded sample of the keys. The bucket of a row
is a column, computed from the row and the split points alone, so it comes out the same whenever a task is repeated and
nothing has to be written. Split points only decide how even the buckets are, never what the result is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..functions.text import bound

# Sampled keys for each bucket, and the most buckets.
SAMPLE = 64
MOST = 512


@dataclass(frozen=True)
class Key:
    """A column of a sort order; NULL comes first in ascending order and last in descending."""

    name: str
    ascending: bool = True

    def sort(self) -> Column:
        column = F.col(f"`{self.name}`")
        return column.asc() if self.ascending else column.desc()


def sorts(order: list[Key]) -> list[Column]:
    return [key.sort() for key in order]


def split_points(df: DataFrame, order: list[Key]) -> list[tuple]:
    """Keys at which the order is cut, distinct and ascending in it: at most one less than there are buckets."""
    parts = min(MOST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*[F.col(f"`{key.name}`") for key in order])
    # a task keeps no more than the sample
    sample = keys.orderBy(F.rand(len(order))).limit(SAMPLE * parts)
    rows = [tuple(row) for row in sample.orderBy(*sorts(order)).collect()]
    return list(dict.fromkeys(rows[len(rows) * n // parts] for n in range(1, parts) if rows))


def _by_direction(order: list[Key]) -> list[list[Key]]:
    """Neighbouring keys of one direction together."""
    return [list(same) for _, same in groupby(order, lambda key: key.ascending)]


def _lexical(order: list[Key], values: Callable[[Key], Column]) -> Column:
    """A row's values as one struct for each direction. Structs compare as sorting does: one value after another, NULL first."""
    return F.struct(*[F.struct(*[values(key).alias(f"k{n}") for n, key in enumerate(same)]) for same in _by_direction(order)])


def _reaches(order: list[Key], row: Column, split: Column) -> Column:
    """True where a row is not before a split point."""
    out = None
    for n, same in reversed(list(enumerate(_by_direction(order), 1))):
        mine, other = row.getField(f"col{n}"), split.getField(f"col{n}")
        if out is None:
            out = mine >= other if same[0].ascending else mine <= other
        else:
            out = (mine > other if same[0].ascending else mine < other) | ((mine == other) & out)
    return out


def bucket_column(df: DataFrame, order: list[Key], splits: list[tuple]) -> Column:
    """How many split points a row reaches, found by halving.

    The split points are one literal array and every step of the search is the same expression, so the plan does not
    grow with their number. The row's keys are put together once; a step is one comparison of them with one split point.
    """
    if not splits:
        return F.lit(0)
    types = [df.schema[key.name].dataType for key in order]
    literals = [{key: F.lit(v).cast(t) for key, v, t in zip(order, split, types, strict=True)} for split in splits]
    known = F.array(*[_lexical(order, one.__getitem__) for one in literals])
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(splits).bit_length()))])

    def search(row: Column) -> Column:
        def reached(low: Column, step: Column) -> Column:
            split = F.get(known, low + step - 1)
            return F.when((low + step <= len(splits)) & _reaches(order, row, split), low + step).otherwise(low)

        return F.aggregate(steps, F.lit(0), reached)

    return bound(_lexical(order, lambda key: F.col(f"`{key.name}`")), search)


def numbered(df: DataFrame, order: list[Key], name: str = "position", start: int = 1) -> DataFrame:
    """Add the exact position of every row in a global order.

    A row's position is the number of rows in earlier buckets and its place within its own. ``order`` has to be total (end it
    with a key), which also lets a hot sort value spread over buckets.
    """
    bucketed = df.withColumn("_bucket", bucket_column(df, order, split_points(df, order)))
    counts = bucketed.groupBy(F.col("_bucket").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row for each bucket
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_of", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*sorts(order)))
    placed = bucketed.withColumn("_inside", inside).join(offsets, F.col("_bucket") == F.col("_of"))
    position = (F.col("_before") + F.col("_inside") + (start - 1)).cast("bigint")
    return placed.withColumn(name, position).select(*quoted(df.columns), name)


def positions_between(df: DataFrame, order: list[Key], offset: int, limit: int = 0) -> DataFrame:
    """The rows at positions ``offset`` (from 0) to ``offset + limit``, or to the end without a limit, in no particular order.

    The rows of each bucket are counted (one number for each bucket reaches the driver). Buckets outside are filtered
    away, buckets wholly inside are kept as they are; only the one or two at the ends are sorted.
    """
    bucketed = df.withColumn("_bucket", bucket_column(df, order, split_points(df, order)))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    end = offset + limit if limit else None
    whole, cut, before = [], {}, 0
    for row in sorted(counts, key=lambda row: row["_bucket"]):
        low, high = offset - before, (row["n"] if end is None else end - before)
        before += row["n"]
        if low >= row["n"] or high <= 0:
            continue
        if low <= 0 and high >= row["n"]:
            whole.append(row["_bucket"])
        else:
            cut[row["_bucket"]] = (max(low, 0), min(high, row["n"]))
    out = bucketed.filter(F.col("_bucket").between(min(whole), max(whole)) if whole else F.lit(False))
    if cut:
        inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*sorts(order)))
        edges = bucketed.filter(F.col("_bucket").isin(list(cut))).withColumn("_inside", inside)
        wanted = F.lit(False)
        for number, (low, high) in cut.items():
            wanted = wanted | ((F.col("_bucket") == number) & (F.col("_inside") > low) & (F.col("_inside") <= high))
        out = out.unionByName(edges.filter(wanted).drop("_inside"))
    return out.select(*quoted(df.columns))


def with_previous(df: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """Add the row before in the order of ``by`` within ``keys``, as a struct; NULL for a first row.

    Keys and order together have to be unique, so a key with very many rows spreads over many buckets. Only the last
    row of each bucket is carried on to the next one that has rows.
    """
    names, row = [*keys, by], F.struct(*quoted(df.columns))
    order = [Key(n) for n in names]
    bucketed = df.withColumn("_bucket", bucket_column(df, order, split_points(df, order)))
    tails = bucketed.groupBy(F.col("_bucket").alias("_of")).agg(F.max_by(row, F.struct(*names)).alias("_tail"))
    # one row for each bucket
    carried = tails.select("_of", F.lag("_tail").over(Window.orderBy("_of")).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy(*names)
    pairs = bucketed.withColumn("_inside", F.lag(row).over(inside))
    pairs = pairs.join(carried, F.col("_bucket") == F.col("_of"))
    before = pairs.withColumn(name, F.coalesce("_inside", "_carried"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"{name}.{key}").eqNullSafe(F.col(key))
    return before.withColumn(name, F.when(same, F.col(name))).select(*quoted(df.columns), name)
