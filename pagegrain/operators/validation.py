"""Checking incoming records against a schema."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import User
from ..functions.names import quoted
from ..functions.text import is_blank
from ..schema import Schema, SchemaColumn
from ..store import Store
from .revisions import given_columns, records


def _read(column: SchemaColumn, given: Column) -> Column:
    return F.struct(given.alias("given"), column.type.parsed(given).alias("parsed"))


def _single(column: SchemaColumn, cell: Column) -> tuple[Column, Column]:
    """Cleaned value and list of errors; blank values and those with an error stay as they came."""
    given = cell["given"]
    clean, error = column.type.checked(cell["parsed"])
    blank = is_blank(given)
    message = F.when(~blank, F.concat(F.lit(f"{column.label}: "), error))
    kept = F.when(blank | error.isNotNull(), given).otherwise(clean)
    return kept, F.array_compact(F.array(message))


def _several(column: SchemaColumn, cells: Column) -> tuple[Column, Column]:
    """Cleaned list and list of errors; an empty list keeps one blank, so that saving clears."""
    clean = F.transform(cells, lambda v: _single(column, v)[0])
    errors = F.flatten(F.transform(cells, lambda v: _single(column, v)[1]))
    return F.when(F.size(cells) == 0, F.array(F.lit(""))).otherwise(clean), errors


def validated(
    incoming: DataFrame, schema: Schema, keys: list[str], users: DataFrame | None = None
) -> DataFrame:
    """Cleaned cells and ``errors``, a list of ``label: message``; empty for a good record.

    ``keys`` names the columns that identify a record. Multi-valued cells may come as lists or as
    comma-separated text. All columns are checked, so a record reports all its errors.
    """
    columns = given_columns(schema, incoming, keys)
    staged = [F.col(key) for key in keys]
    for i, column in enumerate(columns):
        cell = F.col(f"`{column.label}`")

        if not column.multi:
            staged.append(_read(column, F.coalesce(cell, F.lit(""))).alias(f"cell{i}"))
            continue
        if incoming.schema[column.label].dataType.typeName() != "array":
            cell = column.type.split(F.coalesce(cell, F.lit("")))
        filled = F.filter(F.coalesce(cell, F.array().cast("array<string>")), lambda v: ~is_blank(v))
        staged.append(F.transform(filled, partial(_read, column)).alias(f"cell{i}"))
    out, errors = [F.col(key) for key in keys], []
    for i, column in enumerate(columns):
        clean, messages = (_several if column.multi else _single)(column, F.col(f"cell{i}"))
        out.append(clean.alias(column.label))
        errors.append(messages)
    checked = incoming.select(*staged).select(*out, F.concat(*errors).alias("errors"))
    if users is None:
        return checked
    for column in columns:
        if isinstance(column.type, User) and column.type.config["existingonly"]:
            checked = _check_users(checked, column, keys, users)
    return checked


def _check_users(checked: DataFrame, column: SchemaColumn, keys: list[str], users: DataFrame):
    cell = F.col(f"`{column.label}`")
    named = checked.select(*keys, F.explode(cell if column.multi else F.array(cell)).alias("login"))
    unknown = named.filter(F.col("login") != "").join(users.select("login"), "login", "left_anti")
    message = F.concat(F.lit(f"{column.label}: unknown user "), F.col("login"))
    # unknown names of one record, each once
    found = unknown.select(*keys, message.alias("_m")).distinct()
    found = found.groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_unknown"))
    joined = checked.join(found, keys, "left")
    none = F.array().cast("array<string>")
    errors = F.concat("errors", F.coalesce("_unknown", none))
    return joined.withColumn("errors", errors).select(*quoted(checked.columns))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records (without ``errors``) and rejected ones."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def pages_without_errors(checked: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Records of several schemas, without those of pages that have an error in any schema."""
    bad = None
    for frame in checked.values():
        part = frame.filter(F.size("errors") > 0).select("pid")
        bad = part if bad is None else bad.unionByName(part)
    bad = bad.distinct()
    return {
        name: frame.join(bad, "pid", "left_anti").drop("errors") for name, frame in checked.items()
    }


def changed_only(store: Store, schema: Schema, incoming: DataFrame) -> DataFrame:
    """Page records that differ from the stored ones.

    ``incoming`` has ``pid`` and cleaned cells by label.
    """
    columns = given_columns(schema, incoming, ["pid", "rev"])
    # only what can differ is read: the latest records of the incoming pages
    stored = records(store, schema.name, pages=incoming, fill=False)
    renamed = stored.select(
        F.col("pid").alias("s_pid"),
        *[F.col(f"`{c.label}`").alias(f"s{i}") for i, c in enumerate(schema.enabled)],
    )
    slots = {c.label: i for i, c in enumerate(schema.enabled)}
    joined = incoming.join(renamed, F.col("pid") == F.col("s_pid"), "left")
    same = F.lit(True)
    for column in columns:
        if column.label not in slots:
            continue
        new, old = F.col(f"`{column.label}`"), F.col(f"s{slots[column.label]}")
        if column.multi:
            new = F.filter(new, lambda v: v != "")
            old = F.coalesce(old, F.array().cast("array<string>"))
        else:
            new, old = F.coalesce(new, F.lit("")), F.coalesce(old, F.lit(""))
        same = same & new.eqNullSafe(old)
    return joined.filter(~same).select(*quoted(incoming.columns))
