"""References: the text ``["<page id>",<row id>]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column) -> Column:
    """One JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def reference(pid: Column, rid: Column) -> Column:
    return F.concat(F.lit("["), json_text(pid), F.lit(","), rid.cast("string"), F.lit("]"))


def json_list(*columns: Column) -> Column:
    return F.to_json(F.array(*columns), {"ignoreNullFields": "false"})


def json_item(c: Column, index: int) -> Column:
    """Item of a JSON list; NULL for malformed text."""
    return F.get_json_object(c, f"$[{index}]")


# References as they are written here, with nothing to unescape; others go through the JSON parser.
PLAIN = r'^\["([^"\\]*)",(\d+)\]$'


def referenced_page(c: Column) -> Column:
    return F.when(c.rlike(PLAIN), F.regexp_extract(c, PLAIN, 1)).otherwise(json_item(c, 0))


def referenced_row(c: Column) -> Column:
    plain = F.regexp_extract(c, PLAIN, 2).try_cast("bigint")
    return F.coalesce(plain, json_item(c, 1).try_cast("bigint"))


def decoded(c: Column) -> Column:
    """List behind a JSON value: empty text gives an empty list, other text gives NULL."""
    items = F.from_json(c, "array<string>")
    return F.when(c == "", F.array().cast("array<string>")).when(F.startswith(c, F.lit("[")), items)


def decode_error(c: Column) -> Column:
    bad = (c != "") & ~F.startswith(c, F.lit("["))
    return F.when(bad, F.concat(F.lit("not a JSON list: "), c))
