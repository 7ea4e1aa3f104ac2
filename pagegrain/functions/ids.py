"""Page ids: ``namespace:sub:page``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column) -> Column:
    """Canonical page id.

    Covers the part of the host's rules that data can rely on: lower case, ``/`` and ``;`` as
    separators, other special characters as ``_``, no doubled or dangling separators.
    """
    is_clean = c.rlike(r"^[a-z0-9]+(?:[:_.-][a-z0-9]+)*$")
    out = F.regexp_replace(F.lower(F.trim(c)), r"[/;:]+", ":")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}:.-]+", "_")
    out = F.regexp_replace(out, r"(:[._-]+)|([._-]+:)", ":")
    return F.when(is_clean, c).otherwise(F.regexp_replace(out, r"^[:._-]+|[:._-]+$", ""))


def namespace(c: Column) -> Column:
    """Everything before the last ``:``, empty for a page in the root."""
    return F.regexp_extract(c, r"^(.*):[^:]*$", 1)


def page_name(c: Column) -> Column:
    """Everything after the last ``:``."""
    return F.element_at(F.split(c, ":"), -1)


def namespace_prefixes(ns: Column) -> Column:
    """``a:b:c`` gives ``[a, a:b, a:b:c]``; the root namespace gives an empty list."""
    parts = F.split(ns, ":")
    levels = F.sequence(F.lit(1), F.size(parts))
    prefixes = F.transform(levels, lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    return F.when(ns == "", F.array().cast("array<string>")).otherwise(prefixes)
