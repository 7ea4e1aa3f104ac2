"""Global and serial rows: insert, replace, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..functions.text import all_of
from ..store import MULTI_COLUMNS, Store
from .numbering import Key, numbered
from .revisions import given_columns, newest, stored_rows, stored_values, value_list

ROW = ["pid", "rid"]


def all_blank(incoming: DataFrame, columns) -> Column:
    """True where no named column holds a value."""
    tests = []
    for column in columns:
        items = value_list(incoming, column.label)
        tests.append(F.forall(items, lambda v: F.coalesce(v, F.lit("")) == ""))
    return all_of(tests)


def with_row_ids(data: DataFrame, incoming: DataFrame) -> DataFrame:
    """Give rows with ``rid`` 0 the next free ids of the table, in ``line`` order."""
    known = incoming.filter(F.col("rid") != 0).withColumn("rid", F.col("rid").cast("bigint"))
    fresh = incoming.filter(F.col("rid") == 0)
    numbers = numbered(fresh, [Key("line")], "_number")
    highest = data.agg(F.coalesce(F.max("rid"), F.lit(0)).alias("rid")).scalar()
    fresh = numbers.withColumn("rid", (F.col("_number") + highest).cast("bigint")).drop("_number")
    return known.unionByName(fresh.select(*quoted(known.columns)))


def save_rows(store: Store, schema_name: str, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert or replace rows; returns the new ``data`` and ``multi`` tables.

    ``incoming`` has ``pid`` (empty for global rows), ``rid`` (0 for a new row), a unique ``line`` and
    columns of the schema by label. Rows without any value are left out. A later line replaces an
    earlier one with the same row id. Named multi-valued columns are replaced, a blank one is cleared,
    others keep their values; single columns not named become empty.
    """
    schema, data, multi = store.schema(schema_name), store.data(schema_name), store.multi(schema_name)
    columns = given_columns(schema, incoming, ["pid", "rid", "line"])
    filled = with_row_ids(data, incoming.filter(~all_blank(incoming, columns)))
    fresh = newest(filled, ROW, "line").withColumn("rev", F.lit(0).cast("bigint"))

    replaced = fresh.select(*ROW)
    not_row = data.filter(F.col("rev") != 0)
    kept = data.filter(F.col("rev") == 0).join(replaced, ROW, "left_anti").select(*data.columns)
    one = F.lit(1)
    added = stored_rows(schema, fresh, columns, data, one)
    new_data = not_row.unionByName(kept).unionByName(added)

    named = [c.colref for c in columns if c.multi]
    if not named:
        return new_data, multi
    touched = (F.col("rev") == 0) & F.col("colref").isin(named)
    stale = multi.filter(touched).join(replaced, ROW, "left_anti").select(*MULTI_COLUMNS)
    values = stored_values(schema, fresh, columns, one).filter(F.col("value") != "")
    new_multi = multi.filter(~touched).select(*MULTI_COLUMNS).unionByName(stale)
    return new_data, new_multi.unionByName(values)


def delete_rows(store: Store, schema_name: str, rids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove rows by ``rid``; returns the new ``data`` and ``multi`` tables."""
    wanted = rids.select("rid").filter(F.col("rid") != 0).distinct()
    data, multi = store.data(schema_name), store.multi(schema_name)
    return (
        data.join(wanted, "rid", "left_anti").select(*data.columns),
        multi.join(wanted, "rid", "left_anti").select(*multi.columns),
    )
