"""Nested lists and alphabetical indexes.

A tree is kept flat: every leaf row carries the path of its node. Nodes are never gathered, so a node
may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..plans.search import Search
from ..plans.spec import SearchSpec
from ..store import Store
from .numbering import Key, numbered, sorts


def _first(cell: Column, multi: bool) -> Column:
    return F.coalesce(F.get(cell, F.lit(0)), F.lit("")) if multi else cell


def _level(depth: int) -> list[Column]:
    """Sibling order: blanks last, then by compare value, then by what is shown."""
    item, value = F.get("path", F.lit(depth)), F.get("_compare", F.lit(depth))
    return [item == "", F.lower(value), value, item]


def nested(
    store: Store,
    spec: SearchSpec,
    levels: int,
    index: int = 0,
    keep_order: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Leaf rows of the tree over the first ``levels`` columns.

    Gives ``path`` (one text per level, empty for a missing value), ``depth`` and the remaining
    columns. A record with several values in a level appears under each. Equal rows of a node appear
    once. ``index`` adds a top level with the first letters of the first column.

    Siblings are sorted by compare value with blanks last (the collation is the cluster's); with ``keep_order`` they come in the order in which the
    search first meets them, which costs a numbering of the whole result. With ``position`` the place of each row in this
    order is a column of that name, and the rows come in no particular order.
    """
    found = Search(store, spec)
    levels = min(levels, len(found.columns))
    split = [i for i in range(levels) if found.columns[i].multi]
    rows, order = found.ordered_cells(*split)
    path = [F.col(f"c{i}_display") for i in range(levels)]
    places = [F.col(f"c{i}_compare") for i in range(levels)]
    if index:
        whole_list = found.columns[0].multi and 0 not in split
        first = _first(F.col("c0_display"), whole_list)
        letters = F.upper(F.substring(first, 1, index))
        path, places = [letters, *path], [letters, *places]
    names = [found.output_names[i] for i in range(levels, len(found.columns))]
    rest = [F.col(f"c{levels + n}_display").alias(name) for n, name in enumerate(names)]
    # values that look alike but differ when raw (pages of one title) stay apart
    raw = [F.col(f"c{i}_raw") for i, c in enumerate(found.columns) if not c.type.plain]
    if keep_order:
        rows = numbered(rows, [*order, *[Key(f"c{i}_row") for i in split]], "_at")
    else:
        rows = rows.withColumn("_at", F.lit(None).cast("bigint"))
    leaves = rows.select(
        (F.array(*path) if path else F.array().cast("array<string>")).alias("path"),
        F.lit(len(path)).alias("depth"),
        *rest,
        (F.array(*places) if places else F.array().cast("array<string>")).alias("_compare"),
        F.struct(F.lit(0).alias("none"), *raw).alias("_raw"),
        "_at",
    )
    shown = ["path", "depth", *quoted(names)]
    unique = leaves.groupBy(*shown, "_raw", "_compare").agg(F.min("_at").alias("_at"))
    if keep_order:
        unique, order = _first_seen(unique, len(path))
    else:
        siblings = [key for depth in range(len(path)) for key in _level(depth)]
        unique = unique.withColumns({f"_key{n}": key for n, key in enumerate(siblings)})
        order = [Key(f"_key{n}") for n in range(len(siblings))] + [Key(name) for name in names]
    if position is None:
        return unique.orderBy(*sorts(order)).select(*shown)
    return numbered(unique, order, position).select(*shown, F.col(f"`{position}`"))


def _first_seen(leaves: DataFrame, depth: int) -> tuple[DataFrame, list[Key]]:
    order = []
    for level in range(1, depth + 1):
        prefix = F.slice("path", 1, level)
        seen = leaves.groupBy(prefix.alias("_prefix")).agg(F.min("_at").alias(f"_seen{level}"))
        leaves = leaves.join(seen, prefix == F.col("_prefix")).drop("_prefix")
        order.append(Key(f"_seen{level}"))
    return leaves, [*order, Key("_at")]


def nodes(leaves: DataFrame) -> DataFrame:
    """Nodes of a nested list: ``path``, ``depth`` and the number of ``leaf_rows`` below."""
    level = F.explode(F.sequence(F.lit(1), F.size("path"))).alias("level")
    below = leaves.filter(F.size("path") > 0).select("path", level)
    prefixes = below.select(F.expr("slice(path, 1, level)").alias("path"), "level")
    return prefixes.groupBy("path", F.col("level").alias("depth")).agg(
        F.count(F.lit(1)).alias("leaf_rows")
    )
