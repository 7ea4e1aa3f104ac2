"""Multi-valued columns: from one row per value to lists, and any-match flags.

Lists are built in two steps. Step one groups by record *and value*, so equal values of a very long
record are merged before the shuffle and spread over all tasks. Only the distinct values, which are
the cell to be returned, meet in step two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Cell
from ..functions.text import is_blank, or_empty
from ..schema import SchemaColumn
from ..store import DATA_KEYS, Store
from .relation import Relation

FORMS = ("raw", "display", "compare")


def value_rows(store: Store, table: str, colrefs: list[int], current_only: bool) -> DataFrame:
    """Stored values of some columns, one per row."""
    rows = store.multi(table).filter(F.col("colref").isin(colrefs))
    if current_only:
        # values carry the flags of their record, so history is skipped at the scan
        rows = rows.filter(F.col("latest") == 1)
    return rows.select("colref", *DATA_KEYS, "row", "value")


def value_forms(
    store: Store, rows: DataFrame, columns: list[tuple[int, SchemaColumn]]
) -> tuple[DataFrame, list[str]]:
    """Add ``slot`` (position in the select list) and the forms of each value; drop blanks.

    Plain values have the same text in all forms and carry ``raw`` only; the forms present are
    returned as well. One stored column may be selected more than once, hence the slots.
    """
    relation = Relation(store, rows)
    cell = Cell(F.col("value"), "value", "")
    per_slot = [(slot, column.type.forms(relation, cell)) for slot, column in columns]
    plain = all(form.display is cell.value for _, form in per_slot)
    forms = ["raw"] if plain else list(FORMS)

    def choose(form: str) -> Column:
        if all(getattr(have, form) is cell.value for _, have in per_slot):
            return cell.value
        chosen = F.lit("")
        for slot, have in per_slot:
            chosen = F.when(F.col("slot") == slot, getattr(have, form)).otherwise(chosen)
        # what a reference to a missing row shows is empty
        return F.coalesce(chosen, F.lit(""))

    if len({column.colref for _, column in columns}) == len(columns):
        slots = F.lit(None).cast("int")
        for slot, column in columns:
            slots = F.when(F.col("colref") == column.colref, F.lit(slot)).otherwise(slots)
    else:
        wanted = [F.when(F.col("colref") == c.colref, F.lit(slot)) for slot, c in columns]
        slots = F.explode(F.array_compact(F.array(*wanted)))
    keep = [c for c in rows.columns if c not in ("colref", "value")]
    df = relation.df.withColumn("slot", slots)
    out = df.select(*keep, "slot", *[choose(form).alias(form) for form in forms])
    return out.filter(~is_blank(F.col("raw"))), forms


def distinct_values(values: DataFrame, keys: list[str], forms: list[str]) -> DataFrame:
    """Each value of a cell once, at its first position."""
    return values.groupBy(*keys, "slot", *forms).agg(F.min("row").alias("row"))


def folded(
    values: DataFrame, keys: list[str], columns: list[tuple[int, SchemaColumn]], forms: list[str]
) -> DataFrame:
    """One row per key with the lists ``c<slot>_<form>``."""
    item = F.struct("row", *forms)
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("slot") == slot, item))).alias(f"c{slot}")
        for slot, _ in columns
    ]
    grouped = distinct_values(values, keys, forms).groupBy(*keys).agg(*lists)
    shown = [
        F.col(f"c{slot}.{form if form in forms else 'raw'}").alias(f"c{slot}_{form}")
        for slot, _ in columns
        for form in FORMS
    ]
    return grouped.select(*keys, *shown)


def match_flags(store: Store, rows: DataFrame, tests: list) -> DataFrame:
    """One row per record with ``flag<n>``: does any of its values pass test ``n``?

    ``tests`` holds ``(n, column, predicate)`` with ``predicate(relation, cell)``. Values that pass no
    test are dropped before the shuffle.
    """
    relation = Relation(store, rows)
    cell = Cell(F.col("value"), "value", "")
    passed = []
    for number, column, predicate in tests:
        hit = (F.col("colref") == column.colref) & predicate(relation, cell)
        passed.append(F.coalesce(hit, F.lit(False)).alias(f"flag{number}"))
    names = [f"flag{number}" for number, _, _ in tests]
    hits = relation.df.select(*DATA_KEYS, *passed)
    hits = hits.filter(reduce(lambda a, b: a | b, [F.col(name) for name in names]))
    return hits.groupBy(*DATA_KEYS).agg(*[F.max(name).alias(name) for name in names])


def single_forms(forms) -> list[Column]:
    """The forms of a single cell; blank cells show as empty text."""
    raw = or_empty(forms.raw)
    out = [raw]
    for form in (forms.display, forms.compare):
        if form is forms.raw:
            out.append(raw)
        else:
            out.append(F.when(is_blank(forms.raw), F.lit("")).otherwise(F.coalesce(form, F.lit(""))))
    return out
