"""Suggestions and option lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import Lookup
from ..errors import StructureError
from ..functions.ids import namespace, page_name
from ..functions.refs import reference
from ..functions.text import compare, is_blank
from ..plans.search import Search
from ..plans.spec import SearchSpec
from ..store import DATA_KEYS, Store


def _readable(store: Store, rows: DataFrame) -> DataFrame:
    if store.pages is None:
        return rows
    seen = store.pages.filter((F.col("exists") == 1) & (F.col("access_level") > 0)).select("pid")
    on_pages = rows.filter(F.col("pid") != "").join(seen, "pid", "left_semi")
    return rows.filter(F.col("pid") == "").unionByName(on_pages)


def value_suggestions(
    store: Store, schema: str, label: str, text: str, minimum: int = 2, maximum: int = 5
) -> DataFrame:
    """Distinct current values of a column that contain a text, in order.

    ``maximum`` 0 switches suggestions off; a text shorter than ``minimum`` finds nothing.
    """
    column = store.schema(schema).find(label)
    if column is None:
        raise StructureError(f"no column {label} in {schema}")
    current = store.data(schema).filter(F.col("latest") == 1)
    if column.multi:
        values = store.multi(schema).filter(F.col("colref") == column.colref)
        values = values.select(*DATA_KEYS, "value")
        values = values.join(current.select(*DATA_KEYS), DATA_KEYS, "left_semi")
    else:
        values = current.select(*DATA_KEYS, F.col(column.physical).alias("value"))
    if len(text.strip()) < minimum or maximum <= 0:
        values = values.filter(F.lit(False))
    values = values.filter(compare(F.col("value"), "~", f"*{text.strip()}*"))
    return _readable(store, values).select("value").distinct().orderBy("value")


def reference_options(store: Store, schema: str, label: str) -> DataFrame:
    """What a reference column can point to: ``value`` and ``display``, sorted, a blank one first."""
    column = store.schema(schema).find(label)
    if column is None or not isinstance(column.type, Lookup):
        raise StructureError(f"{schema}.{label} is no reference column")
    target, field = column.type.config["schema"], column.type.config["field"]
    found = Search(store, SearchSpec((target,), (field,), sorts=(field,)))
    rows, order = found.ordered_cells()
    options = rows.select(
        F.lit(1).alias("_group"),
        reference(F.col("pid"), F.col("rid")).alias("value"),
        F.col("c0_display").alias("display"),
        *[key.alias(f"_k{n}") for n, key in enumerate(found.sort_expressions(rows))],
    )
    names = [c for c in options.columns if c.startswith("_k")]
    blank = store.spark.range(1).select(
        F.lit(0).alias("_group"),
        F.lit("").alias("value"),
        F.lit("").alias("display"),
        *[F.lit(None).cast(options.schema[name].dataType).alias(name) for name in names],
    )
    return options.unionByName(blank).orderBy("_group", *names, "value").select("value", "display")


def page_suggestions(
    store: Store,
    text: str,
    usetitles: bool = False,
    pattern: str = "",
    minimum: int = 2,
    maximum: int = 5,
) -> DataFrame:
    """Readable pages whose id (or title) contains a text: ``label`` and ``value``.

    ``pattern`` is matched against ``:`` and the id; one that starts with ``:`` is anchored.
    """
    if store.pages is None:
        raise StructureError("page suggestions need a pages table")
    pages = store.pages.filter((F.col("exists") == 1) & (F.col("access_level") > 0)).select("pid")
    pid, wanted = F.col("pid"), f"*{text.strip()}*"
    if usetitles and store.titles is not None:
        pages = pages.join(store.titles.select("pid", "title"), "pid", "left")
        title = F.when(is_blank(F.col("title")), page_name(pid)).otherwise(F.col("title"))
        fits = compare(pid, "~", wanted) | F.coalesce(compare(title, "~", wanted), F.lit(False))
        label = F.concat(title, F.lit(" ("), pid, F.lit(")"))
    else:
        fits = compare(pid, "~", wanted)
        ns = namespace(pid)
        inside = F.concat(page_name(pid), F.lit(" ("), ns, F.lit(")"))
        label = F.when(ns != "", inside).otherwise(pid)
    if len(text.strip()) < minimum or maximum <= 0:
        fits = F.lit(False)
    pages = pages.filter(fits)
    if pattern:
        anchored = "^" + pattern if pattern.startswith(":") else pattern
        pages = pages.filter(F.concat(F.lit(":"), pid).rlike(anchored))
    found = pages.select(label.alias("label"), pid.alias("value")).orderBy("value")
    return found.limit(max(maximum, 0))
