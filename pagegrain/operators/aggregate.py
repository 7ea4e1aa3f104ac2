"""Aggregations over a search: sums, counts, facets, a single value, row numbers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import Cell, Lookup, Page
from ..functions.names import quoted
from ..functions.text import is_number, trimmed
from ..plans.folding import single_forms, value_rows
from ..plans.relation import Relation
from ..plans.search import ROW_KEYS, Search
from ..plans.spec import SearchSpec
from ..store import DATA_KEYS, Store
from .numbering import numbered, sorts


def sums(store: Store, spec: SearchSpec) -> DataFrame:
    """One row with the sum of every column over the shown page of rows.

    Only numeric texts of single-valued columns count; references and titled pages hold no numbers. A
    sum of zero shows as NULL.
    """
    found = Search(store, spec)
    totals = []
    for i, name in enumerate(found.output_names):
        column = found.columns[i]
        composite = isinstance(column.type, Lookup) or (
            isinstance(column.type, Page) and column.type.config["usetitles"]
        )
        if column.multi or composite:
            totals.append(F.lit(None).cast("double").alias(name))
            continue
        cell = trimmed(F.col(f"c{i}_raw"))
        total = F.sum(F.when(is_number(cell), cell.try_cast("double")))
        totals.append(F.nullif(total, F.lit(0.0)).alias(name))
    return found.raw_cells.agg(*totals)


def cloud(store: Store, spec: SearchSpec, minimum: int = 0, limit: int = 0) -> DataFrame:
    """Value counts of the first column: ``tag``, ``display``, ``count``, ``weight``, ``sort_key``.

    Reader's filters and paging are ignored. Weights run from 70 to 150 between the lowest and the
    highest kept count; the empty tag takes part in that range but is not returned.
    """
    plain = replace(spec, dynamic_filters=(), sorts=(), limit=0, offset=0)
    found = Search(store, plain)
    column = found.columns[0]
    rows = found.source_rows()
    prefix = found.prefix_of(column)
    if column.multi:
        values = value_rows(store, column.table, [column.colref], found.current_only)
        # equal values of a long record are counted before they travel to the join
        values = values.groupBy(*DATA_KEYS, "value").agg(F.count("value").alias("times"))
        values = values.withColumnsRenamed({key: f"v_{key}" for key in DATA_KEYS})
        same = [F.col(prefix + key) == F.col(f"v_{key}") for key in DATA_KEYS]
        rows = rows.join(values, same, "left")
        cell, times = Cell(F.col("value"), "value", ""), F.coalesce("times", F.lit(0))
    else:
        name = prefix + column.physical
        cell = Cell(F.col(name), name, prefix)
        times = cell.value.isNotNull().cast("bigint")
    relation = Relation(store, rows)
    raw, display, _ = single_forms(column.type.forms(relation, cell))
    tagged = relation.df.select(
        cell.value.isNull().alias("missing"),
        raw.cast("string").alias("tag"),
        display.cast("string").alias("display"),
        times.alias("times"),
    )
    counts = tagged.groupBy("missing", "tag", "display").agg(F.sum("times").alias("count"))
    if minimum:
        counts = counts.filter(F.col("count") >= minimum)
    if limit:
        counts = counts.orderBy(F.desc("count"), "tag", "missing").limit(limit)
    ends = F.struct(F.min("count").alias("low"), F.max("count").alias("high"))
    span = counts.agg(ends).scalar()
    low, high = span["low"], span["high"]
    share = F.try_divide(F.col("count") - low, high - low)
    weight = F.when(low == high, F.lit(100)).otherwise(F.round(share * 80 + 70).cast("int"))
    shown = counts.filter(F.col("tag") != "")
    return shown.select(
        "tag",
        "display",
        "count",
        weight.alias("weight"),
        column.type.cloud_key(F.col("display")).alias("sort_key"),
    )


def facets(store: Store, spec: SearchSpec) -> DataFrame:
    """Distinct values per column of a result: ``column``, ``value``, ``display``; blanks left out."""
    found = Search(store, spec)
    names = F.array(*[F.lit(name) for name in found.output_names])
    values = found.values().filter(F.col("display") != "")
    # the position of a column is shorter than its name
    distinct = values.distinct()
    return distinct.select(names[F.col("slot")].alias("column"), F.col("raw").alias("value"), "display").distinct()


def single_value(store: Store, spec: SearchSpec) -> DataFrame:
    """Non-empty cells of the first row: ``position``, ``column``, ``values``."""
    found = Search(store, replace(spec, limit=1, offset=0))
    cells = []
    for i, name in enumerate(found.output_names):
        cell = F.col(f"c{i}_display")
        listed = cell if found.columns[i].multi else F.filter(F.array(cell), lambda v: v != "")
        cells.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), listed.alias("values")))
    rows = found.cells.select(F.inline(F.array(*cells)))
    return rows.filter(F.size("values") > 0)


def with_row_numbers(store: Store, spec: SearchSpec, *forms: str) -> DataFrame:
    """The result with ``row_number``, counted on from the offset."""
    found = Search(store, spec)
    rows, order = found.ordered_cells()
    if spec.limit:
        # a page holds at most ``limit`` rows
        number = F.row_number().over(Window.orderBy(*sorts(order))) + F.lit(spec.offset)
        rows = rows.withColumn("row_number", number.cast("bigint"))
    else:
        rows = numbered(rows, order, "row_number", start=spec.offset + 1)
    shown = found.shown(rows, forms or ("display",), extra=["row_number"])
    return shown.select("row_number", *quoted(c for c in shown.columns if c != "row_number"))


def text_rows(store: Store, spec: SearchSpec) -> DataFrame:
    """Rendered text per cell: formatted numbers and dates, affixes, lists joined with ``, ``."""
    found = Search(store, spec)
    rows, order = found.ordered_cells()
    out = [F.col(key) for key in ROW_KEYS]
    for i, name in enumerate(found.output_names):
        column, cell = found.columns[i], F.col(f"c{i}_display")
        kind = found.shown_type(column)
        if column.multi:
            text = F.array_join(F.transform(cell, kind.shown), ", ")
        else:
            text = F.when(cell == "", F.lit("")).otherwise(kind.shown(cell))
        out.append(text.alias(name))
    return (rows.orderBy(*sorts(order)) if found.sorted else rows).select(*out)
