"""Upkeep over whole tables: renames, type changes, repair of old references, page metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Lookup, Media, Page
from ..functions.ids import page_name
from ..functions.refs import json_text, referenced_page
from ..functions.text import is_blank, is_number
from ..schema import Schema, SchemaColumn
from ..store import MULTI_COLUMNS, Store
from .assignment import Patterns, reevaluate

# ---- renames ---------------------------------------------------------------------------------------


def renamed_pages(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Any table with ``pid``, with the ids of ``renames`` (``old``, ``new``) exchanged."""
    moved = rows.join(renames, F.col("pid") == F.col("old"), "left")
    return moved.withColumn("pid", F.coalesce("new", "pid")).select(*rows.columns)


def _page_part(value: Column) -> Column:
    return F.regexp_extract(value, r"^([^#]*)", 1)


def _with_page(value: Column, new: Column) -> Column:
    return F.concat(new, F.regexp_extract(value, r"^[^#]*(#.*)?$", 1))


def _with_reference(value: Column, new: Column) -> Column:
    rest = F.regexp_extract(value, r'^\[\s*"(?:[^"\\]|\\.)*"\s*(,.*\])\s*$', 1)
    return F.concat(F.lit("["), json_text(new), rest)


def _points_to_pages(store: Store, column: SchemaColumn) -> bool:
    """References into schemas that exist may name pages."""
    return isinstance(column.type, Lookup) and column.type.config["schema"] in store.schemas


def renamed_values(
    store: Store, schema_name: str, renames: DataFrame, media: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Follow renames inside the latest values of page, reference or (``media``) media columns.

    A page value may carry ``#fragment``, which stays. The id is matched as a whole by an equi-join.
    """
    schema, data, multi = store.schema(schema_name), store.data(schema_name), store.multi(schema_name)

    def kind(column: SchemaColumn) -> str | None:
        if media:
            return "exact" if isinstance(column.type, Media) else None
        if type(column.type) is Page:
            return "page"
        return "reference" if _points_to_pages(store, column) else None

    def old_id(how: str, value: Column) -> Column:
        return {"exact": value, "page": _page_part(value), "reference": referenced_page(value)}[how]

    def changed(how: str, value: Column, new: Column) -> Column:
        if how == "exact":
            return new
        return _with_page(value, new) if how == "page" else _with_reference(value, new)

    latest = F.col("latest") == 1
    for column in schema.columns:
        how = kind(column)
        if how is None or column.multi:
            continue
        value = F.col(column.physical)
        ids = renames.select(F.col("old").alias("r_old"), F.col("new").alias("r_new"))
        hit = latest & (old_id(how, value) == F.col("r_old"))
        joined = data.join(ids, hit, "left")
        new = F.when(F.col("r_new").isNotNull(), changed(how, value, F.col("r_new"))).otherwise(value)
        data = joined.withColumn(column.physical, new).select(*data.columns)

    wanted = [(c, kind(c)) for c in schema.columns if c.multi and kind(c)]
    if wanted:
        value = F.col("value")
        ident, result = F.lit(None).cast("string"), value
        for column, how in wanted:
            mine = F.col("colref") == column.colref
            ident = F.when(mine, old_id(how, value)).otherwise(ident)
            result = F.when(mine, changed(how, value, F.col("r_new"))).otherwise(result)
        ids = renames.select(F.col("old").alias("r_old"), F.col("new").alias("r_new"))
        joined = multi.join(ids, latest & (ident == F.col("r_old")), "left")
        new = F.when(F.col("r_new").isNotNull(), result).otherwise(value)
        multi = joined.withColumn("value", new).select(*multi.columns)
    return data, multi


def _checked(store: Store, renames: DataFrame) -> DataFrame:
    """Renames with one new id for each old one, none of them taken."""

    def unless(wrong: Column, what: str) -> Column:
        failure = F.raise_error(F.concat(F.lit(what), F.col("old"))).cast("string")
        return F.when(wrong, failure).otherwise(F.col("new"))

    once = renames.groupBy("old").agg(F.min("new").alias("new"), F.count(F.lit(1)).alias("_times"))
    once = once.select("old", unless(F.col("_times") > 1, "renamed twice: ").alias("new"))
    targets = once.groupBy("new").agg(F.min("old").alias("old"), F.count(F.lit(1)).alias("_times"))
    taken = None
    for table in (store.titles, store.pages, store.assignments, *[store.data(n) for n in store.schemas]):
        if table is not None:
            part = table.select(F.col("pid").alias("_pid"))
            taken = part if taken is None else taken.unionByName(part)
    left = taken.join(renames, F.col("_pid") == F.col("old"), "left_anti").join(
        targets, F.col("_pid") == F.col("new"), "left_semi"
    )
    known = left.distinct()
    out = once.join(known, F.col("new") == F.col("_pid"), "left")
    out = out.select("old", unless(F.col("_pid").isNotNull(), "the new id is taken: ").alias("new"))
    twice = targets.filter("_times > 1").select(F.col("new").alias("_pid"))
    out = out.join(twice, F.col("new") == F.col("_pid"), "left")
    return out.select("old", unless(F.col("_pid").isNotNull(), "the new id is given twice: ").alias("new"))


def rename_pages(store: Store, renames: DataFrame, patterns: Patterns | None = None) -> Store:
    """A store in which pages are renamed everywhere: keys, values, assignments, metadata.

    An id renamed twice, or onto an id that is known already and not renamed itself, is refused when
    the result is computed.
    """
    renames = _checked(store, renames)
    out = Store(
        store.spark,
        dict(store.schemas),
        dict(store.data_tables),
        dict(store.multi_tables),
        store.titles,
        store.pages,
        store.assignments,
        store.users,
        store.language,
    )
    for name in store.schemas:
        data, multi = renamed_values(store, name, renames)
        out.data_tables[name] = renamed_pages(data, renames)
        out.multi_tables[name] = renamed_pages(multi, renames)
    if out.titles is not None:
        out.titles = renamed_pages(out.titles, renames)
    if out.pages is not None:
        out.pages = renamed_pages(out.pages, renames)
    if out.assignments is not None:
        out.assignments = renamed_pages(out.assignments, renames)
        if patterns is not None:
            moved = renames.select(F.col("new").alias("pid"))
            out.assignments = reevaluate(out.assignments, patterns, moved)
    return out


# ---- type changes ----------------------------------------------------------------------------------


def single_to_multi(store: Store, schema_name: str, colrefs: list[int]) -> DataFrame:
    """Value table after columns became multi-valued: latest non-blank cells are their row 1."""
    schema, multi = store.schema(schema_name), store.multi(schema_name)
    physical = {c.colref: c.physical for c in schema.columns}
    cells = [
        F.struct(F.lit(ref).alias("colref"), F.col(physical[ref]).alias("value")) for ref in colrefs
    ]
    current = store.data(schema_name).filter(F.col("latest") == 1)
    rows = current.select(
        "pid", "rid", "rev", "latest", "published", F.inline(F.array(*cells))
    ).withColumn("row", F.lit(1).cast("bigint"))
    rows = rows.filter(~is_blank(F.col("value"))).select(*MULTI_COLUMNS)
    keys = ["colref", "pid", "rid", "rev", "row"]
    kept = multi.join(rows.select(*keys), keys, "left_anti").select(*MULTI_COLUMNS)
    return kept.unionByName(rows)


# ---- references of older versions ------------------------------------------------------------------


def upgraded_reference(value: Column) -> Column:
    """``id`` to ``["id",0]``, ``7`` to ``["",7]`` and the wrongly built ``["",id]`` to ``["id",0]``."""
    inner = F.regexp_extract(value, r'^\["",(.*)\]$', 1)
    wrong = value.rlike(r'^\["",.*\D.*\]$')
    return (
        F.when(is_blank(value), value)
        .when(wrong, F.concat(F.lit('["'), inner, F.lit('",0]')))
        .when(F.startswith(value, F.lit("[")), value)
        .when(is_number(value), F.concat(F.lit('["",'), value, F.lit("]")))
        .otherwise(F.concat(F.lit('["'), value, F.lit('",0]')))
    )


def upgrade_references(store: Store, schema_name: str) -> tuple[DataFrame, DataFrame]:
    """Repair all reference columns of a schema; running it again changes nothing."""
    schema, data, multi = store.schema(schema_name), store.data(schema_name), store.multi(schema_name)
    refs = [c for c in schema.columns if isinstance(c.type, Lookup)]
    singles = {c.physical: upgraded_reference(F.col(c.physical)) for c in refs}
    colrefs = [c.colref for c in refs if c.multi]
    if singles:
        data = data.withColumns(singles)
    if colrefs:
        mine = F.col("colref").isin(colrefs)
        fixed = F.when(mine, upgraded_reference(F.col("value"))).otherwise(F.col("value"))
        multi = multi.withColumn("value", fixed)
    return data, multi


# ---- page metadata ---------------------------------------------------------------------------------


def update_titles(titles: DataFrame, changes: DataFrame) -> DataFrame:
    """Page metadata after a batch of page changes.

    ``changes`` has ``pid``, ``title``, ``date``, ``user``, ``ip`` and ``summary``; of several changes
    of a page the last by ``date`` counts (ties are settled by the other columns). A page whose stored revision equals the date is left alone.
    """
    keyed = changes.withColumn("_at", F.coalesce(F.col("date").cast("bigint"), F.lit(0).cast("bigint")))
    rest = F.struct("_at", *[c for c in changes.columns if c != "pid"])
    last = keyed.groupBy("pid").agg(F.max(rest).alias("c")).select("pid", "c.*")
    known = titles.select(F.col("pid").alias("k_pid"), F.col("lastrev").alias("k_rev"))
    same = F.col("date").isNotNull() & F.coalesce(F.col("k_rev") == F.col("_at"), F.lit(False))
    fresh = last.join(known, F.col("pid") == F.col("k_pid"), "left").filter(~same)
    new = fresh.select(
        "pid",
        F.when(is_blank(F.col("title")), page_name(F.col("pid"))).otherwise(F.col("title")).alias("title"),
        F.when(~is_blank(F.col("user")), F.col("user"))
        .when(~is_blank(F.col("ip")), F.col("ip"))
        .otherwise(F.lit(""))
        .alias("lasteditor"),
        F.col("_at").alias("lastrev"),
        F.coalesce("summary", F.lit("")).alias("lastsummary"),
    )
    kept = titles.join(new.select("pid"), "pid", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def added_columns(data: DataFrame, schema: Schema) -> DataFrame:
    """The data table with empty columns for what the schema has gained."""
    missing = [c.physical for c in schema.columns if c.physical not in data.columns]
    return data.withColumns({name: F.lit("") for name in missing}) if missing else data
