"""Registered queries: naming rules, readers' views, own types, versions and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog
from oracle_views import num, sql
from pagegrain import ColumnType, Params, Schema, SearchSpec, Store, bind, column, register_type, search
from pagegrain.functions.text import compare
from pagegrain.operators import assignment, nested, revisions
from pagegrain.session import scratch_folder
from pagegrain.sources import csv_files
from pagegrain.sources.registry import Registry
from pagegrain.streaming.ingest import first_arrived, latest_pages, start_ingest, start_latest
from queries_jobs import FEB_01, JAN_10, JAN_20

QUERIES, ORACLE = {}, {}


def register(name: str, oracle: str):
    def keep(function):
        QUERIES[name], ORACLE[name] = function, oracle
        return function

    return keep


@register(
    "q82_readers_view",
    sql(
        "d_user",
        f"""SELECT pid, action, amount, max(rev) AS rev FROM d_user WHERE published = 1
            GROUP BY pid, action, amount ORDER BY {num("amount")} DESC, action, pid LIMIT 60""",
    ),
)
def readers_view(spark, sf_dir):
    """Readers see all published revisions, equal ones of a page as one row."""
    spec = SearchSpec(("user",), ("action", "amount"), sorts=("^amount", "action"), publisher=False, limit=60)
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid")


# Fixed value: the first whole number whose successor is no double.
EDGE = 2**53


@register(
    "q83_large_row_ids",
    sql(
        "d_order",
        f"""SELECT {EDGE} + rev AS rid, status FROM d_order
            WHERE ({EDGE}::HUGEINT + rev > {EDGE + 101} AND {EDGE}::HUGEINT + rev <> {EDGE + 301})
               OR {EDGE}::HUGEINT + rev = {EDGE + 7}""",
    ),
)
def large_row_ids(spark, sf_dir):
    """Orders as global rows whose ids lie where doubles skip whole numbers."""
    store = catalog.open_store(spark, sf_dir)
    rows = catalog.orders(spark, sf_dir).withColumns({"pid": F.lit(""), "rid": F.col("rev") + EDGE, "rev": F.lit(0).cast("bigint")})
    store.add(Schema("big", (column(1, "status", "Text"),)), rows)
    spec = SearchSpec(
        ("big",),
        ("status",),
        filters=(("%rowid%", ">", str(EDGE + 101)), ("%rowid%", "!=", str(EDGE + 301)), ("%rowid%", "=", str(EDGE + 7), "OR")),
    )
    return search(store, spec).drop("pid", "rev")


@register("q84_historic_evolved", sql("d_user", f"SELECT DISTINCT pid, 'user' AS tbl FROM d_user WHERE rev <= {JAN_20}"))
def historic_evolved(spark, sf_dir):
    """The user schema got a new version later; it existed all the same."""
    store = catalog.open_store(spark, sf_dir)
    only = type(store)(spark).add(Schema("user", catalog.USER.columns, FEB_01), store.data("user"))
    registry = Registry.empty(spark)
    for ts in (JAN_10, FEB_01):
        registry, _ = registry.with_version(Schema("user", catalog.USER.columns, ts))
    return assignment.historic_schemas(only, JAN_20, registry=registry)


@register(
    "q85_conflicting_batch",
    sql("d_user", f"SELECT pid, rev, action, amount||'1' AS amount FROM d_user WHERE rev >= {JAN_20}"),
)
def conflicting_batch(spark, sf_dir):
    """Every incoming revision comes twice, with different amounts; one record stays, whole."""
    store = catalog.open_store(spark, sf_dir)
    history = catalog.user_revisions(spark, sf_dir)
    stored = history.filter(F.col("rev") < JAN_20).withColumn("latest", F.lit(0))
    store.data_tables["user"] = revisions.with_latest(stored.select("pid", "rid", "rev", "latest", "published", "col1", "col2"))
    batch = history.filter(F.col("rev") >= JAN_20).select("pid", "rev", F.col("col1").alias("action"), F.col("col2").alias("amount"))
    batch = batch.unionByName(batch.withColumn("amount", F.concat("amount", F.lit("1"))))
    data, _ = revisions.save_revisions(store, "user", batch)
    return data.filter(F.col("rev") >= JAN_20).select("pid", "rev", F.col("col1").alias("action"), F.col("col2").alias("amount"))


@register(
    "q86_titled_tree",
    sql(
        "d_order titles",
        """SELECT title AS path, status, row_number() OVER (ORDER BY lower(customer), customer, title, status) AS place FROM (
             SELECT DISTINCT CASE WHEN coalesce(t.title,'')='' THEN customer ELSE t.title END AS title, customer, status
             FROM d_order LEFT JOIN titles t ON t.pid = customer)""",
    ),
)
def titled_tree(spark, sf_dir):
    """Siblings are ordered by the page they name, not by its title."""
    spec = SearchSpec(("order",), ("customer", "status"))
    found = nested.nested(catalog.open_store(spark, sf_dir), spec, levels=1, position="place")
    return found.select(F.col("path")[0].alias("path"), "status", "place")


@register("q87_affixed_text", sql("d_doc", "SELECT pid, lang, source FROM d_doc WHERE lang IN ('en', 'es') AND source <> 'src1'"))
def affixed_text(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    columns = (column(1, "lang", "Text", config={"prefix": "in ", "postfix": "!"}), column(2, "source", "Text"))
    store.add(Schema("told", columns), catalog.docs(spark, sf_dir))
    spec = SearchSpec(("told",), ("lang", "source"), filters=(("lang", "~", "in e*!"), ("lang", "!=", "en"), ("source", "!=", "src1")))
    return search(store, spec).drop("rid", "rev")


@register("q88_language_reference", sql("d_supplier d_nation", "SELECT s.rid, lower(n.name) AS home FROM d_supplier s JOIN d_nation n ON n.rid = nation_rid"))
def language_reference(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.language = "de"
    nations = catalog.nations(spark, sf_dir).withColumn("col2", F.lower("col1"))
    store.add(Schema("land", (column(1, "en", "Text"), column(2, "de", "Text"))), nations)
    home = column(2, "home", "Lookup", config={"schema": "land", "field": "$LANG"})
    store.add(Schema("seller", (column(1, "name", "Text"), home)), catalog.suppliers(spark, sf_dir))
    return search(store, SearchSpec(("seller",), ("home",))).select("rid", "home")


@register("q89_unknown_qualifier", sql("d_order", "SELECT pid, status, total FROM d_order WHERE priority = '1-URGENT'"))
def unknown_qualifier(spark, sf_dir):
    spec = SearchSpec(("order",), ("nowhere.status", "total"), filters=(("elsewhere.priority", "=", "1-URGENT"),))
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q90_published_column",
    sql("d_user", """SELECT pid, rev, '1' AS state FROM d_user WHERE published = 1 AND action = 'click'"""),
)
def published_column(spark, sf_dir):
    spec = SearchSpec(("user",), ("%published%", "action", "amount"), filters=(("%published%", "=", "1"), ("action", "=", "click")), latest=False)
    found = search(catalog.open_store(spark, sf_dir), spec, "raw")
    rows = catalog.user_revisions(spark, sf_dir).select("pid", F.col("rev").alias("r"), F.col("col1").alias("a"), F.col("col2").alias("m"))
    # equal revisions are merged; all of them are published
    same = (F.col("a") == F.col("action")) & (F.col("m") == F.col("amount"))
    state = F.col("%published%").cast("string").alias("state")
    every = found.drop("rev").join(rows, "pid").filter(same)
    return every.join(catalog.user_revisions(spark, sf_dir).filter("published = 1").select("pid", F.col("rev").alias("r")), ["pid", "r"], "left_semi").select(
        "pid", F.col("r").alias("rev"), state
    )


@register("q91_namespace_or_id", sql("d_doc", "SELECT pid, size FROM d_doc WHERE starts_with(pid, 'en:src1:')"))
def namespace_or_id(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    spec = SearchSpec(("doc",), ("size",), filters=(("%pageid%", "~", "$NSORID$:*"),))
    return search(store, bind(spec, Params(page="en:src1:start", is_start=True), store)).drop("rid", "rev")


@register("q92_empty_rows", sql("d_order", "SELECT pid, status, priority FROM d_order WHERE (rev - 1) % 3 <> 0 OR (rev - 1) % 6 = 3"))
def empty_rows(spark, sf_dir):
    """Every third order has blank cells, every second of those a priority."""
    store = catalog.open_store(spark, sf_dir)
    key = F.col("rev") - 1
    rows = catalog.orders(spark, sf_dir).withColumns(
        {"col1": F.when(key % 6 == 0, F.lit(" \t")).otherwise(F.col("col1")), "col2": F.when(key % 6 == 0, F.lit(None)).otherwise(F.col("col2"))}
    )
    store.data_tables["order"] = rows
    return search(store, SearchSpec(("order",), ("status", "priority"))).drop("rid", "rev")


@register(
    "q94_sort_replaced",
    sql("d_order", f"SELECT pid, placed, total FROM d_order ORDER BY placed DESC, {num('total')} DESC, pid LIMIT 35"),
)
def sort_replaced(spark, sf_dir):
    spec = SearchSpec(("order",), ("placed", "total"), sorts=("placed", "^total", "^placed"), limit=35)
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


class Mirrored(ColumnType):
    """Text that is compared and sorted from its end."""

    def predicate(self, relation, cell, comparator, value):
        return compare(F.reverse(cell.value), comparator, value)

    def sort_keys(self, relation, cell):
        return [F.reverse(cell.value)]


@register(
    "q95_own_type",
    sql("d_part", "SELECT rid, name FROM d_part WHERE reverse(name) > 'm' ORDER BY reverse(name) DESC, rid LIMIT 45"),
)
def own_type(spark, sf_dir):
    register_type("Mirrored", Mirrored)
    store = catalog.open_store(spark, sf_dir)
    store.add(Schema("mirror", (column(1, "name", "Mirrored"),)), catalog.parts(spark, sf_dir))
    spec = SearchSpec(("mirror",), ("name",), filters=(("name", ">", "m"),), sorts=("^name",), limit=45)
    return search(store, spec).select("rid", "name")


@register(
    "q97_log_first",
    sql(
        "",
        """SELECT user_id AS pid, event_id % 1000 AS rev, min_by(event_type, (event_id % 7, event_type, event_id)) AS action,
           min_by(event_id, (event_id % 7, event_type, event_id)) AS event FROM events GROUP BY ALL""",
    ),
)
def log_first(spark, sf_dir):
    """A log in which revisions come again, in later batches and within one."""
    log = catalog.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pid"), (F.col("event_id") % 1000).alias("rev"), F.col("event_type").alias("action"),
        F.col("event_id").alias("event"), (F.col("event_id") % 7).alias("batch"),
    )
    return first_arrived(log)


@register(
    "q98_versions_at",
    """SELECT p_brand AS tbl, p_partkey AS id, p_size * 10 AS ts FROM part
       QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 10 <= 120 DESC, p_size DESC, p_partkey DESC) = 1""",
)
def versions_at(spark, sf_dir):
    """Parts as versions of their brand: the newest until a time."""
    schemas = catalog.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("tbl"), (F.col("p_size") * 10).alias("ts"),
        F.lit("").alias("user"), F.lit("").alias("comment"), F.lit("{}").alias("config"),
    )
    empty = Registry.empty(spark)
    return Registry(schemas, empty.types, empty.schema_cols).versions_at(120).select("tbl", "id", "ts")


PATTERN_ROWS = """SELECT p_brand AS tbl, CASE p_partkey % 6
    WHEN 0 THEN concat('en:src', p_size % 20, ':doc', p_partkey)
    WHEN 1 THEN concat('de:src', p_partkey % 23, ':*')
    WHEN 2 THEN concat('/doc', p_partkey, '$/')
    WHEN 3 THEN concat('/:SRC', p_partkey % 10, ':doc[0-9]*', p_size, '$/i')
    WHEN 4 THEN concat('/^:(de|fr):.*[', p_partkey % 9, '-9]', p_size, '$/')
    ELSE concat('/(en|es):src(', p_partkey % 20, '|1):doc.?', p_size, '/') END AS pattern FROM part"""


@register(
    "q105_pattern_table",
    sql(
        "d_doc",
        """SELECT DISTINCT pid, tbl FROM d_doc JOIN p ON pattern = pid OR pattern = ns||':*' OR (starts_with(pattern, '/') AND
             regexp_matches(':'||pid, CASE WHEN ends_with(pattern, '/i') THEN '(?i)'||pattern[2:-3] ELSE pattern[2:-2] END))""",
        p=PATTERN_ROWS,
    ),
)
def pattern_table(spark, sf_dir):
    """Patterns of all kinds, as many as there are parts."""
    catalog.table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return assignment.matching_schemas(catalog.docs(spark, sf_dir).select("pid"), spark.sql(PATTERN_ROWS))


# Runs of the streams, one after another.
ARRIVALS = 3


@register(
    "q99_stream_latest",
    f"""WITH came AS (SELECT 'user:'||user_id AS pid, event_id % 1000 AS rev, event_id % {ARRIVALS} AS run, event_type AS action,
            CASE WHEN event_id % 50 = 7 THEN 'none' ELSE printf('%.2f', value) END AS amount FROM events),
        kept AS (SELECT pid, rev, min((run, action, amount)) AS first FROM came WHERE rev > 0 AND amount <> 'none' GROUP BY pid, rev)
        SELECT pid, max(rev) AS rev, max_by(struct_extract(first, 2), rev) AS action, max_by(struct_extract(first, 3), rev) AS amount FROM kept GROUP BY pid""",
)
def stream_latest(spark, sf_dir):
    """Events arrive in three runs of the streams: revisions come late, come again, and every fiftieth event is faulty."""
    folder = scratch_folder(spark, "stream")
    events = catalog.table(spark, sf_dir, "events")
    fields = "pid string, rev bigint, action string, amount string"
    amount = F.when(F.col("event_id") % 50 == 7, F.lit("none")).otherwise(F.expr(catalog.money("value")))
    for run in range(ARRIVALS):
        events.filter(F.col("event_id") % ARRIVALS == run).select(
            F.concat(F.lit("user:"), "user_id").alias("pid"), (F.col("event_id") % 1000).alias("rev"), F.col("event_type").alias("action"), amount.alias("amount")
        ).write.mode("append").parquet(f"{folder}/inbox")
        stream = spark.readStream.schema(fields).parquet(f"{folder}/inbox")
        start_ingest(stream, catalog.USER, f"{folder}/log", f"{folder}/progress").awaitTermination()
        start_latest(spark, catalog.USER, f"{folder}/log", f"{folder}/latest", f"{folder}/latest-progress").awaitTermination()
    return latest_pages(spark, f"{folder}/latest")


@register("q96_deep_page", sql("d_order", f"SELECT pid, status, total FROM d_order ORDER BY {num('total')} DESC, pid OFFSET 777"))
def deep_page(spark, sf_dir):
    """All orders from a place on, without a limit."""
    spec = SearchSpec(("order",), ("status", "total"), sorts=("^total",), offset=777)
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


INBOUND = Schema(
    "inbound",
    (column(1, "status", "Text"), column(2, "total", "Decimal"), column(3, "placed", "Date"), column(4, "flags", "Text", multi=True)),
)


@register(
    "q93_csv_files",
    sql(
        "d_order",
        """SELECT pid, CASE WHEN k % 3 = 0 AND NOT again THEN status ELSE '' END AS status, CASE WHEN k % 3 = 2 THEN '' ELSE total END AS total,
               CASE WHEN k % 3 = 0 AND NOT again THEN '' ELSE placed END AS placed, CASE WHEN k % 3 = 2 THEN status||','||priority ELSE '' END AS flags
           FROM k WHERE k % 10 <> 0
           UNION ALL SELECT 'Page "'||pid||'" already imported', NULL, NULL, NULL, NULL FROM k WHERE k % 33 = 0 AND k % 17 <> 0""",
        k="SELECT *, rev - 1 AS k, (rev - 1) % 33 = 0 AND (rev - 1) % 17 = 0 AS again FROM d_order",
    ),
)
def several_csv_files(spark, sf_dir):
    """Three folders of CSV files with headers of their own. Every 33rd order is in two of them: the first row counts for a page that exists,
    the last for one that the import creates. The readers' view of what was loaded, and the refused rows."""
    folder, orders = scratch_folder(spark, "csv"), catalog.orders(spark, sf_dir)
    key, status, priority, total, placed = F.col("rev") - 1, F.col("col1"), F.col("col2"), F.col("col3"), F.col("col4")
    parts = [
        orders.filter(key % 3 == 0).select("pid", status.alias("status"), total.alias("total")),
        orders.filter((key % 3 == 1) | (key % 33 == 0)).select(total.alias("Total"), "pid", F.lit("x").alias("remark"), placed.alias("placed")),
        orders.filter(key % 3 == 2).select(placed.alias("PLACED"), F.concat_ws(",", status, priority).alias("flags"), "pid"),
    ]
    for number, part in enumerate(parts):
        csv_files.write_rows(part, f"{folder}/{number}")
    store = Store(spark, pages=catalog.order_pages(spark, sf_dir))
    meta = "pid string, rid bigint, rev bigint, latest int, published int"
    data = spark.createDataFrame([], f"{meta}, col1 string, col2 string, col3 string, col4 string")
    store.add(INBOUND, data, spark.createDataFrame([], f"colref int, {meta}, row bigint, value string"))
    rows = csv_files.read_rows(spark, f"{folder}/*")
    grown, bad = csv_files.import_csv(store, "inbound", rows, "page", ts=JAN_10, create_pages=True)
    found = search(grown, SearchSpec(("inbound",), ("status", "total", "placed", "flags"))).withColumn("flags", F.array_join("flags", ","))
    none = [F.lit(None).cast("string").alias(c) for c in ("status", "total", "placed", "flags")]
    return found.drop("rid", "rev").unionByName(bad.select(F.col("errors")[0].alias("pid"), *none))
