"""Registered queries: aggregations, revisions, assignment, validation, exchange and upkeep."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

import catalog
from oracle_views import num, sql
from pagegrain import Schema, SearchSpec, Store, column, search
from pagegrain.functions import display, ids, refs, text
from pagegrain.operators import aggregate, assignment, nested, revisions, rows, suggest, upkeep, validation
from pagegrain.sources import csv_files
from queries_search import listed

QUERIES, ORACLE = {}, {}


def register(name: str, oracle: str | None):
    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return keep


# Microseconds of 2024-01-10, 2024-01-20 and 2024-02-01, UTC.
JAN_10, JAN_20, FEB_01 = 1704844800000000, 1705708800000000, 1706745600000000
DAY = 86400000000


# ---- aggregations ----------------------------------------------------------------------------------


@register(
    "q15_sums",
    sql(
        "d_item",
        f"""SELECT sum({num("qty")}) AS qty, round(sum({num("price")}), 2) AS price,
            CAST(NULL AS DOUBLE) AS part FROM
            (SELECT * FROM d_item ORDER BY {num("price")} DESC, pid, rid LIMIT 500 OFFSET 100)""",
    ),
)
def sums(spark, sf_dir):
    spec = SearchSpec(("item",), ("qty", "price", "part"), sorts=("^price",), limit=500, offset=100)
    found = aggregate.sums(catalog.open_store(spark, sf_dir), spec)
    return found.withColumn("price", F.round("price", 2))


@register(
    "q15_sums_all",
    sql(
        "d_item d_order",
        f"""SELECT o.pid IS NULL AS none, sum({num("qty")}) AS qty, round(sum({num("price")}), 0) AS price
            FROM d_item o GROUP BY 1""",
    ),
)
def sums_all(spark, sf_dir):
    spec = SearchSpec(("item",), ("qty", "price"))
    found = aggregate.sums(catalog.open_store(spark, sf_dir), spec)
    return found.select(F.lit(False).alias("none"), "qty", F.round("price", 0).alias("price"))


WEIGHT = "CASE WHEN lo = hi THEN 100 ELSE round((n - lo) / (hi - lo) * 80 + 70)::INT END"


@register(
    "q16_cloud",
    sql(
        "d_order m_order",
        f"""SELECT tag, tag AS display, n AS count, {WEIGHT} AS weight, tag AS sort_key
            FROM c, (SELECT min(n) AS lo, max(n) AS hi FROM c) WHERE tag <> ''""",
        c=f"""SELECT m.value AS tag, count(m.value) AS n FROM d_order o LEFT JOIN m_order m USING (pid)
              WHERE {num("total")} > 1000 GROUP BY 1""",
    ),
)
def cloud(spark, sf_dir):
    spec = SearchSpec(("order",), ("flags",), filters=(("total", ">", "1000"),))
    return aggregate.cloud(catalog.open_store(spark, sf_dir), spec)


@register(
    "q16_cloud_minimum",
    sql(
        "d_part m_part",
        f"""SELECT tag, tag AS display, n AS count, {WEIGHT} AS weight, tag AS sort_key
            FROM c, (SELECT min(n) AS lo, max(n) AS hi FROM c) WHERE tag <> ''""",
        c="""SELECT value AS tag, count(*) AS n FROM m_part GROUP BY 1 HAVING count(*) >= 20
             ORDER BY n DESC, tag LIMIT 12""",
    ),
)
def cloud_minimum(spark, sf_dir):
    spec = SearchSpec(("part",), ("words",))
    return aggregate.cloud(catalog.open_store(spark, sf_dir), spec, minimum=20, limit=12)


@register(
    "q16_cloud_titles",
    sql(
        "d_order titles",
        f"""SELECT tag, display, n AS count, {WEIGHT} AS weight, display AS sort_key
            FROM c, (SELECT min(n) AS lo, max(n) AS hi FROM c) WHERE tag <> ''""",
        c="""SELECT customer AS tag, CASE WHEN coalesce(title,'')='' THEN customer ELSE title END
             AS display, count(*) AS n FROM d_order o LEFT JOIN titles t ON t.pid = customer
             GROUP BY 1, 2""",
    ),
)
def cloud_titles(spark, sf_dir):
    return aggregate.cloud(catalog.open_store(spark, sf_dir), SearchSpec(("order",), ("customer",)))


def _path(df):
    return df.withColumn("path", F.array_join("path", "/"))


@register(
    "q17_nested2",
    sql("d_part", "SELECT DISTINCT brand||'/'||type AS path, 2 AS depth, name FROM d_part"),
)
def nested_two(spark, sf_dir):
    spec = SearchSpec(("part",), ("brand", "type", "name"))
    return _path(nested.nested(catalog.open_store(spark, sf_dir), spec, levels=2))


@register(
    "q17_nested_nodes",
    sql(
        "d_part",
        """SELECT path, depth, count(*) AS leaf_rows FROM (
             SELECT DISTINCT brand AS path, 1 AS depth, type, name FROM d_part UNION ALL
             SELECT DISTINCT brand||'/'||type, 2, type, name FROM d_part) GROUP BY 1, 2""",
    ),
)
def nested_nodes(spark, sf_dir):
    spec = SearchSpec(("part",), ("brand", "type", "name"))
    return _path(nested.nodes(nested.nested(catalog.open_store(spark, sf_dir), spec, levels=2)))


@register(
    "q18_nested_multi",
    sql(
        "d_order m_order",
        """SELECT DISTINCT coalesce(value, '')||'/'||priority AS path, 2 AS depth, status FROM d_order o
           LEFT JOIN m_order m USING (pid)""",
    ),
)
def nested_multi(spark, sf_dir):
    spec = SearchSpec(("order",), ("flags", "priority", "status"))
    return _path(nested.nested(catalog.open_store(spark, sf_dir), spec, levels=2))


@register(
    "q18_nested_rest_lists",
    sql(
        "d_part m_part words",
        """SELECT DISTINCT brand AS path, 1 AS depth, type, words FROM d_part JOIN words USING (rid)""",
    ),
)
def nested_rest_lists(spark, sf_dir):
    spec = SearchSpec(("part",), ("brand", "type", "words"))
    found = nested.nested(catalog.open_store(spark, sf_dir), spec, levels=1)
    return listed(_path(found), "words")


@register(
    "q19_index",
    sql(
        "d_part",
        """SELECT DISTINCT upper(substr(name, 1, 2))||'/'||name AS path, 2 AS depth, type FROM d_part""",
    ),
)
def index(spark, sf_dir):
    spec = SearchSpec(("part",), ("name", "type"))
    return _path(nested.nested(catalog.open_store(spark, sf_dir), spec, levels=1, index=2))


@register(
    "q19_index_flat",
    sql(
        "d_part m_part words",
        """SELECT DISTINCT upper(substr(value, 1, 1)) AS path, 1 AS depth, words, brand FROM d_part
           JOIN words USING (rid) JOIN m_part m USING (rid) WHERE m.rn = 1""",
    ),
)
def index_flat(spark, sf_dir):
    spec = SearchSpec(("part",), ("words", "brand"))
    found = nested.nested(catalog.open_store(spark, sf_dir), spec, levels=0, index=1)
    return listed(_path(found), "words")


@register(
    "q19_nested_first_seen",
    sql(
        "d_part",
        """SELECT path, depth, name, row_number() OVER (ORDER BY seen, pos) AS place FROM (
             SELECT type AS path, 1 AS depth, name, min(pos) AS pos,
                    min(min(pos)) OVER (PARTITION BY type) AS seen
             FROM (SELECT *, row_number() OVER (ORDER BY lower(name) DESC, rid) AS pos FROM d_part)
             GROUP BY type, name)""",
    ),
)
def nested_first_seen(spark, sf_dir):
    spec = SearchSpec(("part",), ("type", "name"), sorts=("^name",))
    return _path(nested.nested(catalog.open_store(spark, sf_dir), spec, levels=1, keep_order=True, position="place"))


@register(
    "q20_facets",
    sql(
        "d_order m_order titles",
        f"""SELECT 'status' AS "column", status AS value, status AS display FROM o UNION
            SELECT 'customer', customer, CASE WHEN coalesce(title,'')='' THEN customer ELSE title END
              FROM o LEFT JOIN titles t ON t.pid = o.customer UNION
            SELECT 'flags', value, value FROM o JOIN m_order USING (pid)""",
        o=f"SELECT * FROM d_order WHERE {num('total')} > 400000",
    ),
)
def facets(spark, sf_dir):
    spec = SearchSpec(("order",), ("status", "customer", "flags"), filters=(("total", ">", "400000"),))
    return aggregate.facets(catalog.open_store(spark, sf_dir), spec)


@register(
    "q32_hue_order",
    sql(
        "",
        """SELECT tag, display, count, weight, CASE WHEN hi = lo THEN 0 ELSE
             (CASE WHEN h < 0 THEN h + 360 ELSE h END) END AS sort_key FROM (
           SELECT tag, tag AS display, n AS count,
             CASE WHEN mn = mx THEN 100 ELSE round((n-mn)/(mx-mn)*80+70)::INT END AS weight,
             greatest(r,g,b) AS hi, least(r,g,b) AS lo,
             60 * CASE WHEN greatest(r,g,b) = least(r,g,b) THEN 0
                  WHEN b = greatest(r,g,b) THEN 4 + (r-g)/(greatest(r,g,b)-least(r,g,b))
                  WHEN g = greatest(r,g,b) THEN 2 + (b-r)/(greatest(r,g,b)-least(r,g,b))
                  ELSE (g-b)/(greatest(r,g,b)-least(r,g,b)) END AS h
           FROM c, (SELECT min(n) AS mn, max(n) AS mx FROM c))""",
        c="""SELECT '#'||printf('%02x', r)||printf('%02x', g)||printf('%02x', b) AS tag, r, g, b,
               count(*) AS n FROM (SELECT (p_partkey*7) % 256 AS r, (p_size*5) % 256 AS g,
               (p_partkey % 10) * 25 AS b FROM part) GROUP BY ALL""",
    ),
)
def hue_order(spark, sf_dir):
    t = catalog.table(spark, sf_dir, "part")

    def two(c):
        return F.lpad(F.lower(F.hex(c)), 2, "0")

    shade = F.concat(
        F.lit("#"),
        two(F.col("p_partkey") * 7 % 256),
        two((F.col("p_size") * 5 % 256).cast("bigint")),
        two(F.col("p_partkey") % 10 * 25),
    )
    data = catalog.parts(spark, sf_dir).select("pid", "rid", "rev", "latest", "published")
    shades = t.select((F.col("p_partkey") + 1).alias("rid"), shade.alias("col1"))
    store = Store(catalog.tune(spark)).add(
        Schema("paint", (column(1, "shade", "Color"),)), data.join(shades, "rid")
    )
    return aggregate.cloud(store, SearchSpec(("paint",), ("shade",))).orderBy("sort_key", "tag")


@register(
    "q43_single_value",
    sql(
        "d_order m_order flags",
        """SELECT 0 AS position, 'priority' AS "column", priority AS "values" FROM one UNION ALL
           SELECT 1, 'flags', flags FROM one WHERE flags IS NOT NULL UNION ALL
           SELECT 2, 'total', total FROM one""",
        one=f"""SELECT * FROM d_order LEFT JOIN flags USING (pid)
                ORDER BY {num("total")} DESC, pid LIMIT 1""",
    ),
)
def single_value(spark, sf_dir):
    spec = SearchSpec(("order",), ("priority", "flags", "total"), sorts=("^total",), limit=30)
    return listed(aggregate.single_value(catalog.open_store(spark, sf_dir), spec), "values")


@register(
    "q44_row_numbers",
    sql(
        "d_order",
        f"""SELECT row_number() OVER (ORDER BY {num("total")} DESC, pid) AS row_number, pid, total
            FROM d_order ORDER BY 1 LIMIT 60 OFFSET 25""",
    ),
)
def row_numbers(spark, sf_dir):
    spec = SearchSpec(("order",), ("total",), sorts=("^total",), limit=60, offset=25)
    return aggregate.with_row_numbers(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q45_row_numbers_all",
    sql(
        "d_item",
        f"""SELECT row_number() OVER (ORDER BY {num("price")}, pid, rid) AS row_number, pid, rid, price
            FROM d_item""",
    ),
)
def row_numbers_all(spark, sf_dir):
    spec = SearchSpec(("item",), ("price",), sorts=("price",))
    return aggregate.with_row_numbers(catalog.open_store(spark, sf_dir), spec).drop("rev")


@register(
    "q33_suggest",
    sql("d_part", "SELECT DISTINCT name AS value FROM d_part WHERE name ILIKE '%gi%'"),
)
def suggestions(spark, sf_dir):
    return suggest.value_suggestions(catalog.open_store(spark, sf_dir), "part", "name", " Gi ")


@register(
    "q33_suggest_multi",
    sql(
        "m_order opages",
        """SELECT DISTINCT value FROM m_order JOIN opages USING (pid)
           WHERE value ILIKE '%rf%' AND "exists" = 1 AND access_level > 0""",
    ),
)
def suggestions_multi(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.pages = catalog.order_pages(spark, sf_dir)
    return suggest.value_suggestions(store, "order", "flags", "rf")


@register(
    "q55_reference_options",
    sql(
        "d_part",
        """SELECT '["",'||rid||']' AS value, name AS display FROM d_part UNION ALL SELECT '', ''""",
    ),
)
def reference_options(spark, sf_dir):
    return suggest.reference_options(catalog.open_store(spark, sf_dir), "item", "part")


@register(
    "q56_page_suggestions",
    sql(
        "opages",
        """SELECT split_part(pid, ':', 2)||' (order)' AS label, pid AS value FROM opages
           WHERE "exists" = 1 AND access_level > 0 AND pid ILIKE '%11%'
           AND regexp_matches(':'||pid, '^:order:\\d+[13]$') ORDER BY pid LIMIT 5""",
    ),
)
def page_suggestions(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.pages = catalog.order_pages(spark, sf_dir)
    return suggest.page_suggestions(store, "11", pattern=r":order:\d+[13]$")


# ---- revisions -------------------------------------------------------------------------------------


@register(
    "q13_asof",
    sql(
        "d_user",
        f"""SELECT pid, rev, action, amount FROM d_user WHERE rev <= {JAN_10}
            QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rev DESC) = 1""",
    ),
)
def as_of(spark, sf_dir):
    found = revisions.records(catalog.open_store(spark, sf_dir), "user", JAN_10)
    return found.drop("rid")


@register(
    "q13_asof_pages",
    sql(
        "d_user",
        f"""SELECT c.pid, coalesce(action, '') AS action, coalesce(amount, '') AS amount FROM
            (SELECT 'user:'||c_custkey AS pid FROM customer) c LEFT JOIN (
            SELECT * FROM d_user WHERE rev <= {JAN_10}
            QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rev DESC) = 1) u USING (pid)""",
    ),
)
def as_of_pages(spark, sf_dir):
    pages = catalog.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("pid")
    )
    found = revisions.records(catalog.open_store(spark, sf_dir), "user", JAN_10, pages)
    return found.drop("rid", "rev")


def saved_users(spark, sf_dir):
    """The first 20 days as stored revisions, the rest as an incoming batch."""
    store = catalog.open_store(spark, sf_dir)
    history = catalog.user_revisions(spark, sf_dir)
    stored = history.filter(F.col("rev") < JAN_20).withColumn("latest", F.lit(0))
    order = ["pid", "rid", "rev", "latest", "published", "col1", "col2"]
    stored = revisions.with_latest(stored.select(*order))
    incoming = history.filter(F.col("rev") >= JAN_20 - DAY)
    incoming = incoming.select("pid", "rev", F.col("col1").alias("action"), F.col("col2").alias("amount"))
    store.data_tables["user"] = stored
    return store, incoming


@register(
    "q25_latest_upkeep",
    sql(
        "d_user",
        """SELECT pid, rev, CASE WHEN rev = max(rev) OVER (PARTITION BY pid) THEN 1 ELSE 0 END AS latest,
           action, amount FROM d_user""",
    ),
)
def latest_upkeep(spark, sf_dir):
    store, incoming = saved_users(spark, sf_dir)
    data, _ = revisions.save_revisions(store, "user", incoming)
    return data.select(
        "pid", "rev", "latest", F.col("col1").alias("action"), F.col("col2").alias("amount")
    )


@register(
    "q25_save_lists",
    sql(
        "m_order",
        """SELECT 6 AS colref, pid, rev, row_number() OVER (PARTITION BY pid ORDER BY mr, value) AS "row",
           value, 1 AS latest FROM (SELECT pid, rev, value, min(rn) AS mr FROM m_order GROUP BY ALL)
           UNION ALL SELECT 6, pid, rev - 1000000000, rn, value, 0 FROM (
             SELECT pid, rev, rn, value, count(*) AS k FROM m_order GROUP BY ALL), range(k)""",
    ),
)
def save_lists(spark, sf_dir):
    """Older revisions of all orders are stored; today's, with merged flags, are saved."""
    store = catalog.open_store(spark, sf_dir)
    incoming = search(store, SearchSpec(("order",), ("status", "flags"))).drop("rid")
    older = F.col("rev") - 1_000_000_000
    store.data_tables["order"] = store.data("order").withColumn("rev", older)
    store.multi_tables["order"] = store.multi("order").withColumn("rev", older)
    _, multi = revisions.save_revisions(store, "order", incoming)
    return multi.select("colref", "pid", "rev", "row", "value", "latest")


@register(
    "q28_revision_diff",
    sql(
        "d_user",
        """SELECT pid, rev, previous, label, before, after FROM (
             SELECT pid, rev, lag(rev) OVER w AS previous, 'action' AS label, lag(action) OVER w AS before,
                    action AS after FROM d_user WINDOW w AS (PARTITION BY pid ORDER BY rev) UNION ALL
             SELECT pid, rev, lag(rev) OVER w, 'amount', lag(amount) OVER w, amount FROM d_user
             WINDOW w AS (PARTITION BY pid ORDER BY rev))
           WHERE previous IS NOT NULL AND before <> after""",
    ),
)
def revision_diff(spark, sf_dir):
    return revisions.revision_changes(catalog.open_store(spark, sf_dir), "user")


@register(
    "q30_record_text",
    sql(
        "d_order m_order flags titles",
        """SELECT o.pid, rpad('order.status', 20, ' ')||' : '||status||chr(10)
           ||rpad('order.priority', 20, ' ')||' : '||priority||chr(10)
           ||rpad('order.total', 20, ' ')||' : '||total||chr(10)
           ||rpad('order.placed', 20, ' ')||' : '||placed||chr(10)
           ||rpad('order.customer', 20, ' ')||' : '
           ||CASE WHEN coalesce(title,'')='' THEN customer ELSE title END||chr(10)
           ||rpad('order.flags', 20, ' ')||' : '||coalesce(replace(flags, ',', ', '), '')||chr(10) AS text
           FROM d_order o LEFT JOIN flags f USING (pid) LEFT JOIN titles t ON t.pid = o.customer""",
    ),
)
def record_text(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    return revisions.record_text(store, "order", store.data("order")).select("pid", "text")


@register(
    "q47_page_data",
    sql(
        "d_order m_order flags oassign",
        """SELECT pid, 'order' AS schema, label, "values" FROM (
             SELECT o.pid, unnest(['status', 'priority', 'total', 'placed', 'customer', 'flags']) AS label,
             unnest([status, priority, total, placed, customer, coalesce(flags, '')]) AS "values"
             FROM d_order o JOIN oassign a USING (pid) LEFT JOIN flags USING (pid) WHERE assigned = 1)""",
    ),
)
def page_data(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.assignments = catalog.order_assignments(spark, sf_dir)
    pages = store.data("order").select("pid")
    return listed(revisions.page_data(store, pages), "values")


@register(
    "q57_changed_only",
    sql(
        "d_user",
        """SELECT pid, 'view' AS action, amount FROM (SELECT * FROM d_user
           QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rev DESC) = 1) WHERE action <> 'view'""",
    ),
)
def changed_only(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    current = store.data("user").filter(F.col("latest") == 1)
    incoming = current.select("pid", F.lit("view").alias("action"), F.col("col2").alias("amount"))
    return validation.changed_only(store, store.schema("user"), incoming)


@register(
    "q58_revert",
    sql(
        "d_user",
        f"""SELECT pid, {FEB_01} AS rev, action, amount FROM d_user WHERE rev <= {JAN_10}
            QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rev DESC) = 1""",
    ),
)
def revert(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    targets = store.data("user").filter(F.col("latest") == 1)
    targets = targets.select("pid", F.lit(JAN_10).alias("at"), F.lit(FEB_01).alias("rev"))
    data, _ = revisions.revert_pages(store, "user", targets)
    current = data.filter((F.col("latest") == 1) & (F.col("rev") == FEB_01))
    return current.select("pid", "rev", F.col("col1").alias("action"), F.col("col2").alias("amount"))


@register(
    "q59_clear",
    sql(
        "d_user",
        f"""SELECT pid, CASE WHEN action = 'error' THEN {FEB_01} ELSE rev END AS rev,
            CASE WHEN action = 'error' THEN '' ELSE action END AS action FROM (SELECT * FROM d_user
            QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rev DESC) = 1)""",
    ),
)
def clear(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    current = store.data("user").filter((F.col("latest") == 1) & (F.col("col1") == "error"))
    data, _ = revisions.clear_pages(store, "user", current.select("pid", F.lit(FEB_01).alias("rev")))
    return data.filter(F.col("latest") == 1).select("pid", "rev", F.col("col1").alias("action"))


@register(
    "q52_upsert_rows",
    sql(
        "d_part",
        """SELECT rid, CASE WHEN size::INT > 40 THEN 'renewed '||name ELSE name END AS name,
                  CASE WHEN size::INT > 40 THEN '' ELSE brand END AS brand FROM d_part UNION ALL
           SELECT (SELECT max(rid) FROM d_part) + row_number() OVER (ORDER BY s_suppkey), s_name, ''
           FROM supplier""",
    ),
)
def upsert_rows(spark, sf_dir):
    """Renames large parts and adds every supplier as a new row."""
    store = catalog.open_store(spark, sf_dir)
    large = store.data("part").filter(text.number(F.col("col4")) > 40)
    renewed = large.select(
        F.lit("").alias("pid"),
        "rid",
        F.concat(F.lit("renewed "), "col1").alias("name"),
        (-F.col("rid")).alias("line"),
    )
    fresh = catalog.table(spark, sf_dir, "supplier").select(
        F.lit("").alias("pid"),
        F.lit(0).cast("bigint").alias("rid"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") + 1).alias("line"),
    )
    blank = fresh.withColumns({"name": F.lit(""), "line": F.col("line") + 1_000_000_000_000})
    incoming = renewed.unionByName(fresh).unionByName(blank)
    data, _ = rows.save_rows(store, "part", incoming)
    return data.select("rid", F.col("col1").alias("name"), F.col("col2").alias("brand"))


@register(
    "q72_upsert_lists",
    sql(
        "d_part m_part",
        """SELECT rid, rn AS "row", value FROM m_part JOIN d_part USING (rid) WHERE type <> 'PROMO'
           UNION ALL SELECT rid, unnest([1, 2]), unnest([brand, type]) FROM d_part WHERE type = 'PROMO'""",
    ),
)
def upsert_lists(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    promo = store.data("part").filter(F.col("col3") == "PROMO")
    incoming = promo.select(
        "pid", "rid", F.col("rid").alias("line"), F.array("col2", "col3").alias("words")
    )
    _, multi = rows.save_rows(store, "part", incoming)
    return multi.select("rid", "row", "value")


@register(
    "q73_delete_rows",
    sql("d_part", "SELECT rid, name FROM d_part WHERE type <> 'PROMO'"),
)
def delete_rows(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    data, _ = rows.delete_rows(store, "part", store.data("part").filter(F.col("col3") == "PROMO"))
    return data.select("rid", F.col("col1").alias("name"))


# ---- assignment ------------------------------------------------------------------------------------

PATTERNS = [
    ("de:**", "alpha"),
    ("en:src1:*", "alpha"),
    ("en:src0:doc0", "delta"),
    ("fr:src3:doc9", "delta"),
    (r"/:src1\d:/", "beta"),
    ("/DOC7$/i", "beta"),
    ("**", "gamma"),
]

MATCHED = r"""
    SELECT pid, 'alpha' AS tbl FROM d_doc WHERE lang = 'de' OR ns = 'en:src1' UNION ALL
    SELECT pid, 'delta' FROM d_doc WHERE pid IN ('en:src0:doc0', 'fr:src3:doc9') UNION ALL
    SELECT pid, 'beta' FROM d_doc WHERE regexp_matches(':'||pid, ':src1\d:')
      OR regexp_matches(':'||pid, '(?i)DOC7$') UNION ALL
    SELECT pid, 'gamma' FROM d_doc"""


@register("q24_pattern_match", sql("d_doc", MATCHED))
def pattern_match(spark, sf_dir):
    pages = catalog.open_store(spark, sf_dir).data("doc").select("pid")
    return assignment.matching_schemas(pages, PATTERNS)


def known_pages(spark, sf_dir):
    """All documents were once assigned to alpha, the long ones to delta; the English ones withdrawn."""
    docs = catalog.open_store(spark, sf_dir).data("doc")
    alpha = docs.select(
        "pid", F.lit("alpha").alias("tbl"), F.when(F.col("col1") == "en", 0).otherwise(1).alias("assigned")
    )
    long = docs.filter(text.number(F.col("col3")) > 1000)
    return alpha.unionByName(long.select("pid", F.lit("delta").alias("tbl"), F.lit(1).alias("assigned")))


KNOWN = f"""SELECT pid, 'alpha' AS tbl, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS assigned FROM d_doc
    UNION ALL SELECT pid, 'delta', 1 FROM d_doc WHERE {num("size")} > 1000"""


@register(
    "q35_reassign",
    sql(
        "d_doc",
        """SELECT pid, tbl, CASE WHEN (pid, tbl) IN (SELECT (pid, tbl) FROM matched) THEN 1 ELSE 0 END
           AS assigned FROM known""",
        matched=MATCHED,
        known=KNOWN,
    ),
)
def reassign(spark, sf_dir):
    return assignment.reevaluate(known_pages(spark, sf_dir), PATTERNS)


@register(
    "q62_remove_pattern",
    sql(
        "d_doc",
        """SELECT pid, tbl, CASE WHEN tbl = 'alpha' AND lang_ns <> 'en:src1' THEN 0 ELSE assigned END
           AS assigned FROM (SELECT k.*, d.ns AS lang_ns FROM known k JOIN d_doc d USING (pid))""",
        known=KNOWN,
    ),
)
def remove_pattern(spark, sf_dir):
    known = known_pages(spark, sf_dir)
    _, state = assignment.remove_pattern(known, PATTERNS, "de:**", "alpha")
    return state


@register(
    "q63_add_pattern",
    sql(
        "d_doc",
        """SELECT * FROM known UNION ALL SELECT pid, 'omega', 1 FROM d_doc
           WHERE regexp_matches(pid, 'doc\\d*3$')""",
        known=KNOWN,
    ),
)
def add_pattern(spark, sf_dir):
    known = known_pages(spark, sf_dir)
    _, state = assignment.add_pattern(known, PATTERNS, r"/doc\d*3$/", "omega")
    return state


@register(
    "q74_replace_patterns",
    sql(
        "d_doc",
        """SELECT * FROM known WHERE tbl <> 'alpha' UNION ALL SELECT d.pid, 'alpha', 1 FROM d_doc d
           JOIN known k ON k.pid = d.pid AND k.tbl <> 'alpha' WHERE lang = 'fr'""",
        known=KNOWN,
    ),
)
def replace_patterns(spark, sf_dir):
    known = known_pages(spark, sf_dir)
    _, state = assignment.replace_patterns(known, PATTERNS, "alpha", ["fr:**"])
    return state


@register(
    "q75_page_listing",
    sql("d_doc", "SELECT * FROM known WHERE tbl = 'alpha' AND assigned = 1", known=KNOWN),
)
def page_listing(spark, sf_dir):
    return assignment.page_listing(known_pages(spark, sf_dir), "alpha", assigned_only=True)


@register(
    "q36_historic",
    sql(
        "d_user d_doc",
        f"""SELECT DISTINCT pid, 'user' AS tbl FROM d_user WHERE rev <= {JAN_10 - 8 * DAY} UNION ALL
            SELECT pid, 'doc' FROM d_doc""",
    ),
)
def historic(spark, sf_dir):
    full = catalog.open_store(spark, sf_dir)
    store = Store(spark)
    store.add(full.schema("user"), full.data("user")).add(full.schema("doc"), full.data("doc"))
    store.add(replace(full.schema("order"), ts=JAN_20), full.data("order"))
    return assignment.historic_schemas(store, JAN_10 - 8 * DAY)


# ---- validation and exchange -----------------------------------------------------------------------

INTAKE = Schema(
    "intake",
    (
        column(1, "total", "Decimal", config={"min": "1000", "max": "450000"}),
        column(2, "placed", "DateTime"),
        column(3, "day", "Date"),
        column(4, "mail", "Mail", config={"postfix": "@example.com"}),
        column(5, "page", "Page"),
        column(6, "tags", "Decimal", multi=True),
        column(7, "owner", "User"),
    ),
)


def intake_rows(spark, sf_dir):
    t = catalog.table(spark, sf_dir, "orders")
    when = F.col("o_orderdate")
    return t.select(
        F.col("o_orderkey").alias("line"),
        F.concat(F.lit(" "), F.replace(F.expr(catalog.money("o_totalprice")), F.lit("."), F.lit(","))).alias("total"),
        F.concat(F.date_format(when, "yyyy-M-d"), F.lit("T7:"), F.col("o_custkey").cast("string"), F.lit(":59")).alias("placed"),
        F.concat(F.date_format(when, "yyyy-MM-"), (F.dayofmonth(when) + 3).cast("string"), F.lit(" 10:00")).alias("day"),
        F.col("o_orderpriority").alias("mail"),
        F.concat(F.lit("Customer/No "), F.col("o_custkey").cast("string"), F.lit("#Part A")).alias("page"),
        F.concat(F.lit("1, ,"), F.col("o_orderstatus")).alias("tags"),
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("owner"),
    )


@register(
    "q26_validate",
    sql(
        "",
        """SELECT line, CASE WHEN o_totalprice BETWEEN 1000 AND 450000 THEN total
               ELSE ' '||replace(total, '.', ',') END AS total,
             CASE WHEN o_custkey > 59 THEN strftime(o_orderdate, '%Y-%-m-%-d')||'T7:'||o_custkey||':59'
               ELSE strftime(o_orderdate, '%Y-%m-%d')||' 07:'||lpad(o_custkey::VARCHAR, 2, '0') END AS placed,
             strftime(o_orderdate, '%Y-%m-')||CASE WHEN dd > day(last_day(o_orderdate::DATE))
               THEN dd||' 10:00' ELSE lpad(dd::VARCHAR, 2, '0') END AS day, o_orderpriority AS mail,
             'customer:no_'||o_custkey||'#part_a' AS page, '1,'||o_orderstatus AS tags,
             concat_ws('; ',
               CASE WHEN o_totalprice < 1000 THEN 'total: must not be below 1000'
                    WHEN o_totalprice > 450000 THEN 'total: must not be above 450000' END,
               CASE WHEN o_custkey > 59 THEN 'placed: not a valid date and time' END,
               CASE WHEN dd > day(last_day(o_orderdate::DATE)) THEN 'day: not a valid date' END,
               CASE WHEN o_orderpriority LIKE '% %'
                    THEN 'mail: not a valid mail address: '||o_orderpriority||'@example.com' END,
               'tags: a decimal number is needed',
               CASE WHEN c_custkey IS NULL THEN 'owner: unknown user customer:'||o_custkey END) AS errors
           FROM (SELECT *, o_orderkey AS line, printf('%.2f', o_totalprice) AS total,
                 day(o_orderdate) + 3 AS dd FROM orders) o
           LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') c
             ON c_custkey = o_custkey""",
    ),
)
def validate(spark, sf_dir):
    catalog.tune(spark)
    customers = catalog.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    users = customers.select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("login")
    )
    checked = validation.validated(intake_rows(spark, sf_dir), INTAKE, ["line"], users)
    out = listed(checked, "tags").withColumn("errors", F.array_join("errors", "; "))
    return out.drop("owner")


@register(
    "q60_whole_text_cleaning",
    """SELECT doc_id, length(t) AS length, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(
       rtrim(text||chr(13)||chr(10)||'  ', ' '||chr(9)||chr(10)||chr(13)), '\\r\\n?', chr(10), 'g') AS t
       FROM documents)""",
)
def whole_text_cleaning(spark, sf_dir):
    catalog.tune(spark)
    t = catalog.table(spark, sf_dir, "documents")
    raw = t.select("doc_id", F.concat("text", F.lit("\r\n  ")).alias("body"))
    schema = Schema("note", (column(1, "body", "LongText"),))
    clean = validation.validated(raw, schema, ["doc_id"])
    return clean.select("doc_id", F.length("body").alias("length"), F.md5("body").alias("digest"))


def raw_csv(spark, sf_dir):
    """Orders as they come out of a CSV file: text cells, an unknown header, repeated pages."""
    t = catalog.table(spark, sf_dir, "lineitem")
    return t.select(
        F.concat(F.lit("Order:"), F.col("l_orderkey").cast("string")).alias("pid"),
        F.concat(F.col("l_returnflag"), F.lit(" , "), F.col("l_linestatus")).alias("FLAGS"),
        F.col("l_shipdate").cast("string").alias("shipped"),
        F.col("l_linestatus").alias("status"),
        F.expr(catalog.ITEM_ROW).alias("line"),
    )


@register(
    "q49_csv_rows",
    sql(
        "opages",
        """SELECT line, 'order:'||l_orderkey AS pid, l_returnflag||','||l_linestatus AS flags,
             l_linestatus AS status, CASE WHEN "exists" = 0 THEN
               'Page "order:'||l_orderkey||'" does not exist'
               WHEN line > min(line) OVER (PARTITION BY l_orderkey) THEN
               'Page "order:'||l_orderkey||'" already imported' END AS error
           FROM (SELECT *, l_partkey*17179869184 + l_suppkey*8 + l_linenumber AS line FROM lineitem) l
           JOIN opages p ON p.pid = 'order:'||l_orderkey""",
    ),
)
def csv_rows(spark, sf_dir):
    """``line`` repeats across orders here, which the rules only compare within a page."""
    store = catalog.open_store(spark, sf_dir)
    cells = csv_files.import_columns(store, "order", raw_csv(spark, sf_dir), "page").drop("missing")
    judged = csv_files.page_row_errors(cells, catalog.order_pages(spark, sf_dir))
    return listed(judged, "flags")


@register(
    "q50_export_rows",
    sql(
        "d_order m_order flags",
        """SELECT pid, status, priority, total, placed, customer, coalesce(flags, '') AS flags
           FROM d_order LEFT JOIN flags USING (pid)""",
    ),
)
def export_rows(spark, sf_dir):
    return csv_files.schema_rows(catalog.open_store(spark, sf_dir), "order", "page")


@register(
    "q51_shown_table",
    sql(
        "d_order m_order flags titles",
        f"""SELECT pid, priority, placed, total, CASE WHEN coalesce(title,'')='' THEN customer ELSE title
            END AS customer, flags FROM (SELECT o.pid, priority, replace(placed, '-', '/') AS placed,
            replace(format('{{:,}}', split_part(total, '.', 1)::BIGINT), ',', '\u202f') ||
            rtrim(rtrim('.' || split_part(total, '.', 2), '0'), '.') AS total, customer, title,
            coalesce(replace(flags, ',', ', '), '') AS flags
            FROM d_order o LEFT JOIN flags f USING (pid) LEFT JOIN titles t ON t.pid = o.customer)""",
    ),
)
def shown_table(spark, sf_dir):
    spec = SearchSpec(("order",), ("priority", "placed", "total", "customer", "flags"))
    return aggregate.text_rows(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q31_number_display",
    sql(
        "d_order",
        """SELECT pid,
             'EUR '||replace(format('{:,}', round(total::DECIMAL(12,2), 0)::BIGINT), ',', ' ') AS none,
             (round(total::DECIMAL(12,2), 0)::BIGINT // 1000)||'.'||
               lpad((round(total::DECIMAL(12,2), 0)::BIGINT % 1000)::VARCHAR, 3, '0') AS thousands,
             k AS engineering FROM (
             SELECT *, CASE WHEN total::DOUBLE >= 1000 THEN
               regexp_replace(round(total::DOUBLE / 1000, 12)::VARCHAR, '\\.0$', '') || '\u202f' || 'k'
               ELSE regexp_replace(total::DOUBLE::VARCHAR, '\\.0$', '') || '\u202f' END AS k FROM d_order)""",
    ),
)
def number_display(spark, sf_dir):
    orders = catalog.open_store(spark, sf_dir).data("order")
    total = F.col("col3")
    return orders.select(
        "pid",
        display.number_display(total, roundto=0, thousands=" ", prefix="EUR ").alias("none"),
        display.number_display(
            (total.cast("double") / 1000).cast("string"), roundto=3, thousands="", trimzeros=False
        ).alias("thousands"),
        display.engineering(total).alias("engineering"),
    )


@register(
    "q61_url_titles",
    r"""SELECT page_id, CASE WHEN tail IN ('', '/') THEN host ELSE host||'/…' END AS title,
        CASE WHEN url LIKE 'http:%' THEN 'url: not a valid address: '||replace(url, 'http:', 'gem:')
        ELSE '' END AS error FROM (SELECT page_id, url,
        regexp_replace(regexp_extract(url, '^\w+://([^/?#]+)', 1), '^(?i)www\.', '') AS host,
        regexp_replace(url, '^\w+://[^/?#]+', '') AS tail FROM pages)""",
)
def url_titles(spark, sf_dir):
    catalog.tune(spark)
    t = catalog.table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^http:", "gem:"), "^https://", "")
    schema = Schema("link", (column(1, "url", "Url"),))
    checked = validation.validated(t.select("page_id", bare.alias("url")), schema, ["page_id"])
    title = display.url_title(display.url_of(F.col("url")))
    return checked.select("page_id", title.alias("title"), F.array_join("errors", ";").alias("error"))


@register(
    "q66_references_as_text",
    sql(
        "titles",
        r"""SELECT pid, '["'||replace(title||' "x" '||pid, '"', '\"')||'",'||lastrev||']' AS ref,
            title||' "x" '||pid AS page, lastrev AS "row", 2 AS items,
            'not a JSON list: '||pid AS error FROM titles""",
    ),
)
def references_as_text(spark, sf_dir):
    titles = catalog.open_store(spark, sf_dir).titles
    named = F.concat("title", F.lit(' "x" '), "pid")
    built = titles.select("pid", refs.reference(named, F.col("lastrev")).alias("ref"))
    return built.select(
        "pid",
        "ref",
        refs.referenced_page(F.col("ref")).alias("page"),
        refs.referenced_row(F.col("ref")).alias("row"),
        F.size(refs.decoded(F.col("ref"))).alias("items"),
        refs.decode_error(F.col("pid")).alias("error"),
    )


@register(
    "q67_page_ids",
    r"""SELECT page_id, id, CASE WHEN id LIKE '%:%' THEN regexp_extract(id, '^(.*):[^:]*$', 1) ELSE '' END
        AS ns, regexp_extract(id, '([^:]*)$', 1) AS name FROM (SELECT page_id,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url, ' ')),
        '[/;]+', ':', 'g'), '[^\p{L}\p{N}:._-]+', '_', 'g'), '_{2,}', '_', 'g'), ':{2,}', ':', 'g'),
        '(:[._-]+)|([._-]+:)', ':', 'g'), '^[:._-]+|[:._-]+$', '', 'g') AS id FROM pages)""",
)
def page_ids(spark, sf_dir):
    catalog.tune(spark)
    named = catalog.table(spark, sf_dir, "pages").select("page_id", ids.clean_id(F.col("url")).alias("id"))
    return named.select(
        "page_id", "id", ids.namespace(F.col("id")).alias("ns"), ids.page_name(F.col("id")).alias("name")
    )


# ---- upkeep ----------------------------------------------------------------------------------------


def customer_renames(spark, sf_dir):
    t = catalog.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY")
    key = F.col("c_custkey").cast("string")
    return t.select(
        F.concat(F.lit("customer:"), key).alias("old"), F.concat(F.lit("client:"), key).alias("new")
    )


RENAMED = "SELECT 'customer:'||c_custkey AS old, 'client:'||c_custkey AS new FROM customer WHERE c_mktsegment = 'MACHINERY'"


@register(
    "q29_rename",
    sql(
        "d_order",
        """SELECT o.pid, CASE WHEN placed > '2000' THEN coalesce(new, customer)||'#top'
           ELSE coalesce(new, customer) END AS customer FROM d_order o LEFT JOIN r ON old = customer""",
        r=RENAMED,
    ),
)
def rename(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    fragment = F.when(F.col("col4") > "2000", F.concat("col5", F.lit("#top"))).otherwise(F.col("col5"))
    store.data_tables["order"] = store.data("order").withColumn("col5", fragment)
    data, _ = upkeep.renamed_values(store, "order", customer_renames(spark, sf_dir))
    return data.select("pid", F.col("col5").alias("customer"))


@register(
    "q29_rename_store",
    sql(
        "d_item d_order titles",
        """SELECT 'data' AS part, coalesce(new, customer) AS pid, part_ref AS value FROM (
             SELECT customer, '["'||coalesce(new, customer)||'",0]' AS part_ref, new FROM d_order
             LEFT JOIN r ON old = customer) UNION ALL
           SELECT 'title', coalesce(new, pid), lasteditor FROM titles LEFT JOIN r ON old = pid""",
        r=RENAMED,
    ),
)
def rename_store(spark, sf_dir):
    """One page per order named after its customer, with a reference to it in a list."""
    full = catalog.open_store(spark, sf_dir)
    ref = Schema("visit", (column(1, "of", "Lookup", multi=True, config={"schema": "visit", "field": "%pageid%"}),))
    rows_ = full.data("order").select(
        F.col("col5").alias("pid"), "rid", "rev", "latest", "published", F.lit("").alias("col1")
    )
    values = rows_.select(
        F.lit(1).alias("colref"), "pid", "rid", "rev", "latest", "published",
        F.lit(1).cast("bigint").alias("row"),
        refs.reference(F.col("pid"), F.lit(0)).alias("value"),
    )
    store = Store(spark, titles=full.titles).add(ref, rows_, values)
    moved = upkeep.rename_pages(store, customer_renames(spark, sf_dir))
    named = moved.multi("visit").select(F.lit("data").alias("part"), "pid", "value")
    titles = moved.titles.select(F.lit("title").alias("part"), "pid", F.col("lasteditor").alias("value"))
    return named.unionByName(titles)




@register(
    "q34_legacy_refs",
    """SELECT 'order:'||l_orderkey AS pid, CASE WHEN l_linenumber < 3 OR l_linenumber = 7 THEN
       '["",'||l_partkey||']' WHEN l_linenumber = 6 THEN '' ELSE '["part:'||l_partkey||'",0]' END AS part
       FROM lineitem""",
)
def legacy_refs(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    key, line = F.regexp_extract("col3", r"(\d+)", 1), F.col("rid") % 8
    key = (key.cast("bigint") - 1).cast("string")
    old = (
        F.when(line < 3, key)
        .when(line < 5, F.concat(F.lit("part:"), key))
        .when(line == 5, F.concat(F.lit('["",part:'), key, F.lit("]")))
        .when(line == 6, F.lit(""))
        .otherwise(F.concat(F.lit('["",'), key, F.lit("]")))
    )
    store.data_tables["item"] = store.data("item").withColumn("col3", old)
    data, _ = upkeep.upgrade_references(store, "item")
    return data.select("pid", F.col("col3").alias("part"))


@register(
    "q53_single_to_multi",
    sql(
        "d_user",
        """SELECT 1 AS colref, pid, rev, 1 AS "row", action AS value FROM d_user
           QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rev DESC) = 1""",
    ),
)
def single_to_multi(spark, sf_dir):
    values = upkeep.single_to_multi(catalog.open_store(spark, sf_dir), "user", [1])
    return values.select("colref", "pid", "rev", "row", "value")


@register(
    "q54_update_titles",
    sql(
        "titles d_order",
        """SELECT coalesce(c.pid, t.pid) AS pid, coalesce(c.title, t.title) AS title,
             coalesce(c.editor, t.lasteditor) AS lasteditor, coalesce(c.date, t.lastrev) AS lastrev,
             coalesce(c.summary, t.lastsummary) AS lastsummary
           FROM titles t FULL JOIN c ON c.pid = t.pid""",
        c="""SELECT customer AS pid, CASE WHEN status = 'F' THEN split_part(customer, ':', 2)
               ELSE 'Order '||status END AS title, date, CASE WHEN priority < '3' THEN '10.0.0.1'
               ELSE priority END AS editor, summary FROM (
             SELECT *, epoch(placed::DATE)::BIGINT AS date, total AS summary FROM d_order
             QUALIFY row_number() OVER (PARTITION BY customer ORDER BY placed DESC,
               CASE WHEN status = 'F' THEN '' ELSE 'Order '||status END DESC,
               CASE WHEN priority < '3' THEN '' ELSE priority END DESC, total DESC) = 1)""",
    ),
)
def update_titles(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    changes = store.data("order").select(
        F.col("col5").alias("pid"),
        F.when(F.col("col1") == "F", F.lit("")).otherwise(F.concat(F.lit("Order "), "col1")).alias("title"),
        F.unix_timestamp(F.to_date("col4").cast("timestamp")).alias("date"),
        F.when(F.col("col2") < "3", F.lit("")).otherwise(F.col("col2")).alias("user"),
        F.lit("10.0.0.1").alias("ip"),
        F.col("col3").alias("summary"),
    )
    return upkeep.update_titles(store.titles, changes)


@register(
    "q78_rows_by_id",
    sql("d_part m_part words", "SELECT rid, name, brand, words FROM d_part JOIN words USING (rid)"),
)
def rows_by_id(spark, sf_dir):
    found = revisions.rows_by_id(catalog.open_store(spark, sf_dir), "part")
    return listed(found.select("rid", "name", "brand", "words"), "words")


@register(
    "q79_blocked_pages",
    sql(
        "d_order m_order flags",
        f"""SELECT o.pid, total FROM d_order o WHERE {num("total")} BETWEEN 5000 AND 400000
            AND priority NOT LIKE '% %'""",
    ),
)
def blocked_pages(spark, sf_dir):
    """An error in one schema blocks the page's records in the other."""
    stored = catalog.open_store(spark, sf_dir).data("order")
    money = Schema("money", (column(1, "total", "Decimal", config={"min": "5000", "max": "400000"}),))
    post = Schema("post", (column(1, "mail", "Mail", config={"postfix": "@example.com"}),))
    checked = {
        "money": validation.validated(stored.select("pid", F.col("col3").alias("total")), money, ["pid"]),
        "post": validation.validated(stored.select("pid", F.col("col2").alias("mail")), post, ["pid"]),
    }
    return validation.pages_without_errors(checked)["money"]


@register(
    "q80_page_data_filled",
    sql(
        "d_order m_order flags oassign",
        """SELECT pid, 'order' AS schema, label, "values" FROM (
             SELECT o.pid, unnest(['status', 'priority', 'total', 'placed', 'customer', 'flags']) AS label,
             unnest([status, priority, total, placed, customer, flags]) AS "values"
             FROM d_order o JOIN oassign a USING (pid) LEFT JOIN flags USING (pid) WHERE assigned = 1)
           WHERE "values" IS NOT NULL""",
    ),
)
def page_data_filled(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.assignments = catalog.order_assignments(spark, sf_dir)
    pages = store.data("order").select("pid")
    return listed(revisions.page_data(store, pages, skip_empty=True), "values")
