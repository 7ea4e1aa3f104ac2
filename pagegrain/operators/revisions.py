"""Page revisions: as-of reads, saving, clearing, reverting and comparing.

Nothing is updated in place. Every write gives new ``data`` and ``multi`` DataFrames, to be written as
a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import Cell
from ..errors import StructureError
from ..functions.names import quoted
from ..plans.folding import FORMS, folded, single_forms, value_forms
from ..plans.relation import Relation
from ..schema import Schema
from ..store import DATA_KEYS, MULTI_COLUMNS, Store
from .numbering import with_previous


def newest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the greatest ``by`` per key. Partial maxima are formed before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*quoted(rest)), F.col(by)).alias("_best"))
    return best.select(*keys, "_best.*").select(*quoted(rows.columns))


def as_of(data: DataFrame, ts) -> DataFrame:
    """Per page, the revision that was current at a time."""
    seen = data.filter((F.col("rev") > 0) & (F.col("rev") <= F.lit(ts)))
    return newest(seen, ["pid"], "rev")


def with_latest(data: DataFrame) -> DataFrame:
    """Set ``latest`` from the revisions: 1 for the newest of each page, 0 for the others.

    The join key holds the revision, so a page with very many revisions spreads over all tasks.
    """
    top = data.filter(F.col("rev") > 0).groupBy("pid").agg(F.max("rev").alias("n_rev"))
    top = top.withColumnRenamed("pid", "n_pid")
    same = (F.col("pid") == F.col("n_pid")) & (F.col("rev") == F.col("n_rev"))
    flag = F.when(F.col("rev") == 0, F.col("latest")).otherwise(F.col("n_pid").isNotNull().cast("int"))
    return data.join(top, same, "left").withColumn("latest", flag).select(*data.columns)


# ---- records ---------------------------------------------------------------------------------------


def record_cells(store: Store, schema: Schema, rows: DataFrame) -> DataFrame:
    """All enabled columns of some data rows: keys and ``c<i>_raw/_display/_compare``."""
    relation = Relation(store, rows)
    columns = list(enumerate(schema.enabled))
    out = [F.col(key) for key in DATA_KEYS]
    for i, column in columns:
        if not column.multi:
            cell = Cell(F.col(column.physical), column.physical, "")
            forms = single_forms(column.type.forms(relation, cell))
            out += [form.alias(f"c{i}_{name}") for name, form in zip(FORMS, forms)]
    cells = relation.df.select(*out)
    multi = [(i, c) for i, c in columns if c.multi]
    if not multi:
        return cells
    values = store.multi(schema.name).filter(F.col("colref").isin([c.colref for _, c in multi]))
    values = values.select("colref", *DATA_KEYS, "row", "value")
    values = values.join(rows.select(*DATA_KEYS), DATA_KEYS, "left_semi")
    values, forms = value_forms(store, values, multi)
    lists = folded(values, DATA_KEYS, multi, forms)
    none = F.array().cast("array<string>")
    names = [f"c{i}_{form}" for i, _ in multi for form in FORMS]
    joined = cells.join(lists, DATA_KEYS, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), none) for name in names})


def labelled(schema: Schema, cells: DataFrame, form: str = "raw") -> DataFrame:
    """Cells under their labels."""
    shown = [F.col(f"c{i}_{form}").alias(c.label) for i, c in enumerate(schema.enabled)]
    return cells.select(*DATA_KEYS, *shown)


def records(
    store: Store,
    schema_name: str,
    ts: int | None = None,
    pages: DataFrame | None = None,
    form: str = "raw",
    fill: bool = True,
) -> DataFrame:
    """The record of each page at a time (default: now), all columns, lists folded.

    With ``pages`` (a DataFrame with ``pid``) exactly these pages are returned; those without data get
    empty cells, or are left out without ``fill``.
    """
    schema = store.schema(schema_name)
    data = store.data(schema_name)
    if pages is not None:
        pages = pages.select("pid").distinct()
        data = data.join(pages, "pid", "left_semi")
    if ts is None:
        # the flag spares the history
        rows = data.filter((F.col("latest") == 1) & (F.col("rid") == 0) & (F.col("rev") > 0))
    else:
        rows = as_of(data, ts)
    found = labelled(schema, record_cells(store, schema, rows), form)
    if pages is None or not fill:
        return found
    none = F.array().cast("array<string>")
    filled = {
        c.label: F.coalesce(F.col(f"`{c.label}`"), none if c.multi else F.lit(""))
        for c in schema.enabled
    }
    return pages.join(found, "pid", "left").withColumns(filled)


def rows_by_id(
    store: Store, schema_name: str, rid: int | None = None, pid: str = "", form: str = "raw"
) -> DataFrame:
    """Global rows (``pid`` empty) or serial rows of a page, one of them with ``rid``."""
    schema = store.schema(schema_name)
    rows = store.data(schema_name).filter((F.col("rev") == 0) & (F.col("pid") == pid))
    if rid is not None:
        rows = rows.filter(F.col("rid") == rid)
    return labelled(schema, record_cells(store, schema, rows), form)


def page_data(
    store: Store, pages: DataFrame, ts: int | None = None, skip_empty: bool = False
) -> DataFrame:
    """Records of all schemas assigned to some pages: ``pid``, ``schema``, ``label``, ``values``."""
    parts = []
    for schema in store.schemas.values():
        wanted = pages.select("pid")
        if store.assignments is not None:
            own = store.assignments.filter((F.col("tbl") == schema.name) & (F.col("assigned") == 1))
            wanted = wanted.join(own.select("pid"), "pid", "left_semi")
        found = records(store, schema.name, ts, wanted)
        cells = []
        for column in schema.enabled:
            if skip_empty and not column.type.config.get("visibility", {}).get("inpage", True):
                continue
            cell = F.col(f"`{column.label}`")
            listed = cell if column.multi else F.filter(F.array(cell), lambda v: v != "")
            cells.append(F.struct(F.lit(column.label).alias("label"), listed.alias("values")))
        if cells:
            part = found.select("pid", F.lit(schema.name).alias("schema"), F.inline(F.array(*cells)))
            parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.size("values") > 0) if skip_empty else out


def record_text(store: Store, schema_name: str, rows: DataFrame) -> DataFrame:
    """One text per record, a ``label : value`` line per column: ``pid``, ``rid``, ``rev``, ``text``."""
    schema = store.schema(schema_name)
    cells = record_cells(store, schema, rows)
    lines = []
    for i, column in enumerate(schema.enabled):
        shown = F.col(f"c{i}_display")
        text = F.array_join(shown, ", ") if column.multi else shown
        lines += [F.lit(f"{column.qualified:<20} : "), text, F.lit("\n")]
    return cells.select(*DATA_KEYS, F.concat(*lines).alias("text"))


# ---- writing ---------------------------------------------------------------------------------------


def given_columns(schema: Schema, incoming: DataFrame, keys: list[str]):
    """Schema columns an incoming DataFrame names; an unknown one is an error."""
    by_label = {c.label: c for c in schema.columns}
    given = [name for name in incoming.columns if name not in keys]
    unknown = [name for name in given if name not in by_label]
    if unknown:
        raise StructureError(f"unknown columns in {schema.name}: {', '.join(unknown)}")
    return [by_label[name] for name in given]


def _is_list(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def value_list(df: DataFrame, name: str) -> Column:
    """A cell as a list, whether it came as one or not."""
    cell = F.col(f"`{name}`")
    if _is_list(df, name):
        return F.coalesce(cell, F.array().cast("array<string>"))
    return F.array(F.coalesce(cell, F.lit("")))


def single_cell(df: DataFrame, name: str) -> Column:
    """The stored single cell; of a list its first value."""
    cell = F.col(f"`{name}`")
    if _is_list(df, name):
        return F.get(cell, F.lit(0))
    return F.coalesce(cell, F.lit(""))


def stored_rows(
    schema: Schema, incoming: DataFrame, columns, data: DataFrame, latest: Column
) -> DataFrame:
    """Incoming rows in the layout of the data table."""
    given = {c.colref: c for c in columns}
    out = {
        "pid": F.col("pid"),
        "rid": F.col("rid").cast("bigint"),
        "rev": F.col("rev").cast("bigint"),
        "latest": latest,
        "published": F.lit(None).cast("int"),
    }
    for column in schema.columns:
        cell = single_cell(incoming, column.label) if column.colref in given else F.lit("")
        out[column.physical] = cell
    # a table may hold more columns than the schema still has
    return incoming.select([out.get(name, F.lit("")).alias(name) for name in data.columns])


def stored_values(schema: Schema, incoming: DataFrame, columns, latest: Column) -> DataFrame | None:
    """Multi-valued cells in the layout of the value table, numbered from 1."""
    multi = [c for c in columns if c.multi]
    if not multi:
        return None
    lists = [
        F.struct(F.lit(c.colref).alias("colref"), value_list(incoming, c.label).alias("values"))
        for c in multi
    ]
    cells = incoming.select("pid", "rid", "rev", latest.alias("latest"), F.inline(F.array(*lists)))
    rows = cells.select(
        "colref",
        "pid",
        F.col("rid").cast("bigint").alias("rid"),
        F.col("rev").cast("bigint").alias("rev"),
        "latest",
        F.lit(None).cast("int").alias("published"),
        F.posexplode("values").alias("row", "value"),
    )
    return rows.withColumn("row", (F.col("row") + 1).cast("bigint")).select(*MULTI_COLUMNS)


def save_revisions(store: Store, schema_name: str, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add page revisions; returns the new ``data`` and ``multi`` tables.

    ``incoming`` has ``pid``, ``rev`` and any columns of the schema by label (lists for multi-valued
    ones). Columns not given are empty. A revision that is already stored is not stored again, so a
    repeated batch changes nothing. ``latest`` goes to the highest revision of a page.
    """
    schema, data = store.schema(schema_name), store.data(schema_name)
    multi = store.multi(schema_name)
    columns = given_columns(schema, incoming, ["pid", "rev"])
    zero = F.raise_error(F.lit("saving needs a revision time above zero")).cast("bigint")
    rev = F.when(F.col("rev") > 0, F.col("rev").cast("bigint")).otherwise(zero)
    fresh = incoming.withColumns({"rev": rev, "rid": F.lit(0).cast("bigint")})
    # of several records for one revision the largest stays, whole
    rest = F.struct(*quoted([c for c in fresh.columns if c not in DATA_KEYS]))
    fresh = fresh.groupBy(*DATA_KEYS).agg(F.max(rest).alias("_one")).select(*DATA_KEYS, "_one.*")
    fresh = fresh.join(data.select(*DATA_KEYS), DATA_KEYS, "left_anti")

    added = fresh.groupBy("pid").agg(F.max("rev").alias("a_rev")).withColumnRenamed("pid", "a_pid")
    on_page = (F.col("pid") == F.col("a_pid")) & (F.col("rid") == 0)

    def outdated(rows: DataFrame) -> DataFrame:
        # history cannot change: only latest page rows are joined
        current = F.coalesce((F.col("latest") == 1) & (F.col("rid") == 0), F.lit(False))
        beaten = F.coalesce(F.col("rev") < F.col("a_rev"), F.lit(False))
        flag = F.when(beaten, F.lit(0)).otherwise(F.col("latest"))
        changed = rows.filter(current).join(added, on_page, "left").withColumn("latest", flag)
        return rows.filter(~current).unionByName(changed.select(*rows.columns))

    current = data.filter((F.col("latest") == 1) & (F.col("rid") == 0) & (F.col("rev") > 0))
    top = added.join(
        current.select(F.col("pid").alias("a_pid"), F.col("rev").alias("c_rev")), "a_pid", "left"
    )
    top = top.select("a_pid", F.greatest("a_rev", "c_rev").alias("t_rev"))
    same = (F.col("pid") == F.col("a_pid")) & (F.col("rev") == F.col("t_rev"))
    flagged = fresh.join(top, same, "left")
    latest = F.col("a_pid").isNotNull().cast("int")
    new_data = outdated(data).unionByName(stored_rows(schema, flagged, columns, data, latest))
    new_values = stored_values(schema, flagged, columns, latest)
    if new_values is None:
        return new_data, outdated(multi)
    return new_data, outdated(multi).unionByName(new_values)


def clear_pages(store: Store, schema_name: str, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Save an empty revision for each page of ``pages`` (``pid``, ``rev``)."""
    schema = store.schema(schema_name)
    empty = [
        (F.array().cast("array<string>") if c.multi else F.lit("")).alias(c.label)
        for c in schema.columns
    ]
    return save_revisions(store, schema_name, pages.select("pid", "rev", *empty))


def revert_pages(store: Store, schema_name: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Save the record each page had at ``at`` again as revision ``rev``.

    ``targets`` has ``pid``, ``at`` and ``rev``.
    """
    schema, data = store.schema(schema_name), store.data(schema_name)
    wanted = targets.select(
        "pid", F.col("at").alias("t_at"), F.col("rev").cast("bigint").alias("t_rev")
    )
    seen = data.join(wanted, "pid").filter((F.col("rev") > 0) & (F.col("rev") <= F.col("t_at")))
    chosen = newest(seen, ["pid", "t_rev"], "rev")
    back = chosen.select(F.col("pid").alias("b_pid"), F.col("rev").alias("b_rev"), "t_rev")
    cells = record_cells(store, schema, chosen.select(*data.columns))
    found = labelled(schema, cells)
    same = (F.col("pid") == F.col("b_pid")) & (F.col("rev") == F.col("b_rev"))
    again = found.join(back, same).drop("rev", "rid", "b_pid", "b_rev")
    return save_revisions(store, schema_name, again.withColumnRenamed("t_rev", "rev"))


# ---- comparing -------------------------------------------------------------------------------------


def revision_changes(store: Store, schema_name: str) -> DataFrame:
    """What each revision changed: ``pid``, ``rev``, ``previous``, ``label``, ``before``, ``after``.

    First revisions have nothing to differ from.
    """
    schema = store.schema(schema_name)
    rows = store.data(schema_name).filter((F.col("rev") > 0) & (F.col("rid") == 0))
    cells = record_cells(store, schema, rows)
    shown = []
    for i, column in enumerate(schema.enabled):
        cell = F.col(f"c{i}_display")
        shown.append((F.array_join(cell, ", ") if column.multi else cell).alias(f"v{i}"))
    pairs = with_previous(cells.select("pid", "rev", *shown), ["pid"], "rev", "old")
    changes = [
        F.struct(
            F.lit(column.label).alias("label"),
            F.col(f"old.v{i}").alias("before"),
            F.col(f"v{i}").alias("after"),
        )
        for i, column in enumerate(schema.enabled)
    ]
    changed = pairs.filter(F.col("old").isNotNull())
    listed = changed.select("pid", "rev", F.col("old.rev").alias("previous"), F.inline(F.array(*changes)))
    return listed.filter(~F.col("before").eqNullSafe(F.col("after")))
