"""Which schemas belong to which pages.

Patterns are a table ``pattern``, ``tbl`` of any size, or a short list of such pairs:

``**``        every page
``ns:**``     pages in ``ns`` and below
``ns:*``      pages directly in ``ns``
``/regex/``   searched in ``:`` and the page id
``ns:page``   exactly this page

Every step gives the new state as a DataFrame over the old one; write it before the next step reads it,
or the plans of a chain of steps grow with each of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StructureError
from ..functions.ids import clean_id, namespace, namespace_prefixes
from ..functions.regexes import READABLE, grams, java_regex, required_texts, widest_grams
from ..sources.registry import Registry
from ..store import Store

Patterns = list[tuple[str, str]] | DataFrame

PATTERN_TABLE = "pattern string, tbl string"
# Patterns that fit every page, and expressions without a required text, are met under one of so many keys.
SPREAD = 32
# Pages of one gram that are searched together.
PART_PAGES = 1000


def pattern_table(spark: SparkSession, patterns: Patterns) -> DataFrame:
    """Patterns as a table; NULL patterns and schemas are left out."""
    if not isinstance(patterns, DataFrame):
        patterns = spark.createDataFrame(sorted(set(patterns)), PATTERN_TABLE)
    return patterns.select("pattern", "tbl").dropna().distinct()


def _without(patterns: Patterns, tbl: str, pattern: str | None = None) -> Patterns:
    """All but one pattern, or all patterns, of a schema."""
    if isinstance(patterns, DataFrame):
        gone = F.col("tbl") == tbl
        return patterns.filter(~(gone if pattern is None else gone & (F.col("pattern") == pattern)))
    return [(p, t) for p, t in patterns if t != tbl or pattern not in (None, p)]


def _with(spark: SparkSession, patterns: Patterns, more: list[tuple[str, str]]) -> Patterns:
    if isinstance(patterns, DataFrame):
        return pattern_table(spark, pattern_table(spark, patterns).unionByName(pattern_table(spark, more)))
    return sorted({*patterns, *more})


def _kind(pattern: Column) -> Column:
    return (
        F.when(F.btrim(pattern, F.lit(":")) == "**", "all")
        .when(F.startswith(pattern, F.lit("/")), "expression")
        .when(F.endswith(pattern, F.lit("**")), "below")
        .when(F.endswith(pattern, F.lit("*")), "inside")
        .otherwise("page")
    )


def _text(pid: Column) -> Column:
    """What expressions are searched in."""
    return F.concat(F.lit(":"), clean_id(pid))


def _page_grams(pages: DataFrame) -> DataFrame:
    return pages.select("pid", F.explode(grams(_text(F.col("pid")))).alias("key"))


def _expression_keys(pages: DataFrame, expressions: DataFrame) -> DataFrame:
    """The gram under which each expression is found: of the widest in its required texts the one on the fewest pages. The pages of
    a gram on many of them are dealt over ``spread`` parts."""
    held = expressions.select("regex", F.explode("texts").alias("text"))
    held = held.select("regex", F.explode(widest_grams(F.col("text"))).alias("key")).distinct()
    counts = _page_grams(pages).groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    # a gram no page has is the best one: the expression fits nowhere
    known = held.join(counts, "key", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    rarity = F.struct("pages", -F.length("key"), "key")
    best = known.groupBy("regex").agg(F.min_by(F.struct("key", "pages"), rarity).alias("best")).select("regex", "best.*")
    spread = F.least(F.lit(SPREAD), F.floor(F.col("pages") / PART_PAGES) + 1).cast("int")
    return best.filter("pages > 0").select("regex", "key", spread.alias("spread"))


def _fitting_expressions(pages: DataFrame, expressions: DataFrame) -> DataFrame:
    """``pid``, ``tbl`` by expressions. An index of grams leads to the pages that can fit; only they are searched, once for each
    different expression."""
    expressions = expressions.select(java_regex(F.col("pattern")).alias("regex"), "tbl").distinct()
    different = expressions.select("regex").distinct().withColumn("texts", required_texts(F.col("regex")))
    keyed = _expression_keys(pages, different)
    part = F.pmod(F.xxhash64("pid"), F.col("spread")).cast("int")
    found = _page_grams(pages).join(keyed.select("key", "spread").distinct(), "key")
    found = found.select("pid", _text(F.col("pid")).alias("text"), "key", part.alias("part"))
    dealt = keyed.select("regex", "key", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("part"))
    by_gram = found.join(dealt, ["key", "part"]).select("pid", "text", "regex")
    every = _every_page(pages, different.filter(F.size("texts") == 0).select("regex"))
    every = every.select("pid", _text(F.col("pid")).alias("text"), "regex")
    fitting = by_gram.unionByName(every).filter(F.regexp_like("text", F.col("regex"))).select("pid", "regex")
    return fitting.join(expressions, "regex").select("pid", "tbl")


def _every_page(pages: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of ``few`` on every page, as an equi-join whose one key is spread."""
    spread = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64("pid"), F.lit(SPREAD)).cast("int")
    return pages.select("pid", part.alias("part")).join(spread, "part").drop("part")


def matching_schemas(pages: DataFrame, patterns: Patterns) -> DataFrame:
    """Schemas of pages by pattern: distinct ``pid``, ``tbl``.

    Each page lists the keys under which a pattern could know it (its id, its namespace, the namespaces above) and one
    equi-join on that key finds the patterns. Expressions are found by a gram that every text they fit has to hold, as wide
    as the index has them, and then tried. Patterns for all pages, and expressions that require no text, meet every page;
    no other pattern does. No patterns or no pages give no rows; an expression that cannot be read is an error.
    """
    if not isinstance(patterns, DataFrame):
        unreadable = [p for p, _ in patterns if p.startswith("/") and not READABLE.match(p)]
        if unreadable:
            raise StructureError(f"not an expression between slashes with flags of imsx: {', '.join(unreadable)}")
    known = pattern_table(pages.sparkSession, patterns).withColumn("kind", _kind(F.col("pattern")))
    pages = pages.select("pid").distinct()

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    page = clean_id(F.col("pid"))
    ns = namespace(page)
    above = F.when(ns == "", F.array(F.lit(""))).otherwise(namespace_prefixes(ns))
    keys = [
        F.array(key("page", page), key("inside", ns)),
        F.transform(above, lambda prefix: key("below", prefix)),
    ]
    listed = pages.select("pid", F.inline(F.concat(*keys)))
    named = known.filter(F.col("kind").isin("page", "inside", "below"))
    named = named.select("kind", clean_id(F.col("pattern")).alias("key"), "tbl").distinct()
    parts = [
        listed.join(named, ["kind", "key"]).select("pid", "tbl"),
        _every_page(pages, known.filter(F.col("kind") == "all").select("tbl").distinct()),
    ]
    if isinstance(patterns, DataFrame) or any(p.startswith("/") for p, _ in patterns):
        parts.append(_fitting_expressions(pages, known.filter(F.col("kind") == "expression")))
    return reduce(DataFrame.unionByName, parts).distinct()


def assigned_schemas(store: Store, pages: DataFrame | None = None) -> DataFrame:
    """Schemas of pages by stored state: ``pid``, ``tbl``."""
    state = store.assignments.filter(F.col("assigned") == 1)
    if pages is not None:
        state = state.join(pages.select("pid"), "pid", "left_semi")
    return state.select("pid", "tbl").distinct()


def with_assignments(assignments: DataFrame, pairs: DataFrame, assigned: int) -> DataFrame:
    """Set the state of ``(pid, tbl)`` pairs."""
    keys = ["pid", "tbl"]
    fresh = pairs.select(*keys).distinct()
    kept = assignments.join(fresh, keys, "left_anti").select("pid", "tbl", "assigned")
    return kept.unionByName(fresh.withColumn("assigned", F.lit(assigned)))


def propagate(assignments: DataFrame, patterns: Patterns, tbl: str) -> DataFrame:
    """Assign a schema to all known pages its patterns match."""
    known = assignments.filter((F.col("tbl") != tbl) | (F.col("assigned") != 1))
    own = pattern_table(assignments.sparkSession, patterns).filter(F.col("tbl") == tbl)
    return with_assignments(assignments, matching_schemas(known.select("pid").distinct(), own), 1)


def add_pattern(
    assignments: DataFrame, patterns: Patterns, pattern: str, tbl: str
) -> tuple[Patterns, DataFrame]:
    patterns = _with(assignments.sparkSession, patterns, [(pattern, tbl)])
    return patterns, propagate(assignments, patterns, tbl)


def remove_pattern(
    assignments: DataFrame, patterns: Patterns, pattern: str, tbl: str
) -> tuple[Patterns, DataFrame]:
    """Drop a pattern and withdraw the schema from pages no other pattern matches."""
    patterns = _without(patterns, tbl, pattern)
    own = pattern_table(assignments.sparkSession, patterns).filter(F.col("tbl") == tbl)
    known = assignments.filter(F.col("tbl") == tbl).select("pid", "tbl")
    lost = known.join(matching_schemas(known.select("pid"), own), ["pid", "tbl"], "left_anti")
    return patterns, with_assignments(assignments, lost, 0)


def reevaluate(
    assignments: DataFrame, patterns: Patterns, pages: DataFrame | None = None
) -> DataFrame:
    """Set the state of schemas already known to pages (all, or the given ones) from the patterns."""
    touched = assignments
    if pages is not None:
        touched = assignments.join(pages.select("pid").distinct(), "pid", "left_semi")
    found = matching_schemas(touched.select("pid").distinct(), patterns)
    found = found.withColumn("found", F.lit(1))
    state = touched.select("pid", "tbl").join(found, ["pid", "tbl"], "left")
    state = state.select("pid", "tbl", F.coalesce("found", F.lit(0)).alias("assigned"))
    if pages is None:
        return state
    rest = assignments.join(pages.select("pid").distinct(), "pid", "left_anti")
    return rest.select("pid", "tbl", "assigned").unionByName(state)


def page_listing(
    assignments: DataFrame, schema: str | None = None, assigned_only: bool = False
) -> DataFrame:
    out = assignments.select("pid", "tbl", "assigned")
    if schema:
        out = out.filter(F.col("tbl") == schema)
    if assigned_only:
        out = out.filter(F.col("assigned") == 1)
    return out.orderBy("pid", "tbl")


def historic_schemas(
    store: Store, ts: int, pages: DataFrame | None = None, registry: Registry | None = None
) -> DataFrame:
    """Schemas that existed at a time and for which a page had data by then: ``pid``, ``tbl``.

    A schema exists since its first version. The store knows only one version of each; with the
    ``registry`` the first is looked up (one row per schema).
    """
    since = {schema.name: schema.ts for schema in store.schemas.values()}
    if registry is not None:
        first = registry.schemas.groupBy("tbl").agg(F.min("ts").alias("ts"))
        since |= {row["tbl"]: row["ts"] for row in first.collect() if row["tbl"] in since}
    out = None
    for schema in store.schemas.values():
        if since[schema.name] > ts:
            continue
        rows = store.data(schema.name).filter((F.col("pid") != "") & (F.col("rev") <= ts))
        if pages is not None:
            rows = rows.join(pages.select("pid"), "pid", "left_semi")
        part = rows.select("pid").distinct().withColumn("tbl", F.lit(schema.name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return store.spark.createDataFrame([], "pid string, tbl string")
    return out


def replace_patterns(
    assignments: DataFrame, patterns: Patterns, tbl: str, wanted: list[str]
) -> tuple[Patterns, DataFrame]:
    """Exchange all patterns of a schema. Its assignments start anew: pages known through other
    schemas are assigned where a new pattern matches."""
    patterns = _with(assignments.sparkSession, _without(patterns, tbl), [(p, tbl) for p in wanted])
    return patterns, propagate(assignments.filter(F.col("tbl") != tbl), patterns, tbl)


def clear(assignments: DataFrame, full: bool = False) -> tuple[Patterns, DataFrame]:
    """Forget all patterns; pages stay known as withdrawn unless ``full``."""
    if full:
        return [], assignments.filter(F.lit(False))
    return [], assignments.withColumn("assigned", F.lit(0))


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern table from JSON lines of ``pattern`` and ``tbl``."""
    return pattern_table(spark, spark.read.schema(PATTERN_TABLE).json(path))
