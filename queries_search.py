"""Registered queries: search, joins, paging and reader-dependent values."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

import catalog
from oracle_views import num, sql
from pagegrain import Filter, PageValue, Params, Schema, Search, SearchSpec, bind, column, search

QUERIES, ORACLE = {}, {}


def register(name: str, oracle: str | None):
    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return keep


def listed(df, *names):
    """Lists as comma-separated text, so that results compare across engines."""
    return df.withColumns({name: F.array_join(F.col(name), ",") for name in names})


@register(
    "q00_flagship",
    sql(
        "d_order m_order flags titles",
        f"""SELECT o.pid, status, total, CASE WHEN coalesce(t.title,'')='' THEN customer ELSE t.title END
            AS customer, f.flags FROM d_order o JOIN flags f USING (pid)
            LEFT JOIN titles t ON t.pid = o.customer
            WHERE status = 'F' AND {num("total")} > 300000
            AND EXISTS (SELECT 1 FROM m_order m WHERE m.pid = o.pid AND m.value = 'RF')
            ORDER BY {num("total")} DESC, o.pid LIMIT 20""",
    ),
)
def flagship(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("status", "total", "customer", "flags"),
        filters=(("flags", "=", "RF"), ("status", "=", "F"), ("total", ">", "300000")),
        sorts=("^total",),
        limit=20,
    )
    found = search(catalog.open_store(spark, sf_dir), spec)
    return listed(found.drop("rid", "rev"), "flags")


@register(
    "q01_search_basic",
    sql(
        "d_order",
        """SELECT pid, status, priority, total, placed FROM d_order
           WHERE status = 'F' AND priority = '1-URGENT' AND placed >= '1998-01-01'
           ORDER BY placed DESC, pid LIMIT 50 OFFSET 10""",
    ),
)
def basic(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("status", "priority", "total", "placed"),
        filters=(
            ("status", "=", "F"),
            ("priority", "=", "1-URGENT"),
            ("placed", ">=", "1998-01-01"),
        ),
        sorts=("^placed",),
        limit=50,
        offset=10,
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q02_decimal_filter",
    sql(
        "d_order",
        f"""SELECT pid, total FROM d_order
            WHERE {num("total")} > 250000 AND {num("total")} <= 260000.5 AND {num("total")} <> 255000""",
    ),
)
def decimal_filter(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("total",),
        filters=(("total", ">", "250000"), ("total", "<=", "260000.5 EUR"), ("total", "<>", "255000")),
        sorts=("total",),
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q03_wildcard_like",
    sql(
        "d_part",
        """SELECT rid, name, brand FROM d_part
           WHERE name ILIKE '%WIDGET' AND name NOT ILIKE 'small%' AND brand ILIKE '%and#1%'""",
    ),
)
def wildcard(spark, sf_dir):
    spec = SearchSpec(
        ("part",),
        ("name", "brand"),
        filters=(("name", "~", "*WIDGET"), ("name", "!~", "small*"), ("brand", "*~", "and#1")),
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("pid", "rev")


@register(
    "q04_regex",
    sql("d_part", "SELECT rid, name FROM d_part WHERE regexp_matches(name, '^(red|blue) .*[et]$')"),
)
def regex(spark, sf_dir):
    spec = SearchSpec(("part",), ("name",), filters=(("name", "=*", "^(red|blue) .*[et]$"),))
    return search(catalog.open_store(spark, sf_dir), spec).drop("pid", "rev")


@register(
    "q05_in_list",
    sql(
        "d_order",
        """SELECT pid, status, priority FROM d_order WHERE priority IN ('1-URGENT', '5-LOW')
           AND (status NOT ILIKE 'F' OR status NOT ILIKE 'O')
           AND (status <> 'P' OR status <> 'F')""",
    ),
)
def in_list(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("status", "priority"),
        filters=(
            ("priority", "IN", ["1-URGENT", "5-LOW"]),
            ("status", "!~", ["F", "O"]),
            ("status", "!=", ["P", "F"]),
        ),
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q06_logic_chain",
    sql(
        "d_order",
        f"""SELECT pid, status, priority, total FROM d_order
            WHERE status = 'P' OR (priority = '2-HIGH' AND {num("total")} < 20000)""",
    ),
)
def logic_chain(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("status", "priority", "total"),
        filters=(
            ("status", "=", "P", "AND"),
            ("priority", "=", "2-HIGH", "OR"),
            ("total", "<", "20000", "AND"),
        ),
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q07_multi_fold",
    sql(
        "d_order m_order flags",
        """SELECT pid, rev, status, coalesce(flags, '') AS flags
           FROM d_order LEFT JOIN flags USING (pid, rev)""",
    ),
)
def multi_fold(spark, sf_dir):
    spec = SearchSpec(("order",), ("status", "flags"))
    return listed(search(catalog.open_store(spark, sf_dir), spec).drop("rid"), "flags")


@register(
    "q08_multi_any",
    sql(
        "d_order m_order flags",
        """SELECT o.pid, priority, flags FROM d_order o JOIN flags f USING (pid, rev)
           WHERE EXISTS (SELECT 1 FROM m_order m WHERE m.pid = o.pid AND m.value = 'RF')
           AND EXISTS (SELECT 1 FROM m_order m WHERE m.pid = o.pid AND m.value NOT ILIKE 'n%')
           AND (priority = '3-MEDIUM' OR
                EXISTS (SELECT 1 FROM m_order m WHERE m.pid = o.pid AND m.value > 'R'))""",
    ),
)
def multi_any(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("priority", "flags"),
        filters=(("flags", "=", "RF"), ("flags", "!~", "n*")),
    )
    store = catalog.open_store(spark, sf_dir)
    medium_or_late = replace(spec, filters=(("priority", "=", "3-MEDIUM"), ("flags", ">", "R", "OR")))
    wanted = search(store, medium_or_late).select("pid")
    found = search(store, spec).join(wanted, "pid", "left_semi")
    return listed(found.drop("rid", "rev"), "flags")


@register(
    "q09_multi_schema",
    sql(
        "d_order d_item",
        f"""SELECT DISTINCT o.pid, o.status, i.qty, i.price FROM d_order o JOIN d_item i USING (pid)
            WHERE {num("i.qty")} > 45 AND o.priority = '1-URGENT'""",
    ),
)
def multi_schema(spark, sf_dir):
    spec = SearchSpec(
        ("order", ("item", "i")),
        ("order.status", "i.qty", "price"),
        filters=(("i.qty", ">", "45"), ("priority", "=", "1-URGENT")),
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q10_titles",
    sql(
        "d_order titles",
        """SELECT o.pid, CASE WHEN coalesce(title,'')='' THEN customer ELSE title END AS customer
           FROM d_order o LEFT JOIN titles t ON t.pid = o.customer
           WHERE customer ILIKE '%00001%' OR title ILIKE '%00001%'""",
    ),
)
def titled(spark, sf_dir):
    spec = SearchSpec(
        ("order",), ("customer",), filters=(("customer", "~", "*00001*"),), sorts=("customer",)
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


METADATA = ("%pageid%", "%title%", "%lastupdate%", "%lasteditor%", "%lastsummary%", "status")


@register(
    "q11_metadata",
    sql(
        "d_order otitles",
        """SELECT o.pid AS page, title, strftime(make_timestamp(lastrev*1000000), '%Y-%m-%d %H:%M:%S')
           AS lastupdate, lasteditor, lastsummary, status
           FROM d_order o LEFT JOIN otitles t USING (pid)
           WHERE lasteditor = 'editor3' AND lastsummary <> 'Summary 5' AND
           strftime(make_timestamp(lastrev*1000000), '%Y-%m-%d %H:%M:%S') > '2021-03-01'
           ORDER BY lastrev DESC, o.pid LIMIT 200""",
    ),
)
def metadata(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.titles = catalog.order_titles(spark, sf_dir)
    spec = SearchSpec(
        ("order",),
        METADATA,
        filters=(
            ("%lasteditor%", "=", "editor3"),
            ("%lastsummary%", "!=", "Summary 5"),
            ("%lastupdate%", ">", "2021-03-01"),
        ),
        sorts=("^%lastupdate%",),
        limit=200,
    )
    found = search(store, spec)
    return found.select(
        F.col("%pageid%").alias("page"),
        F.col("%title%").alias("title"),
        F.col("%lastupdate%").alias("lastupdate"),
        F.col("%lasteditor%").alias("lasteditor"),
        F.col("%lastsummary%").alias("lastsummary"),
        "status",
    )


@register(
    "q12_reference",
    sql(
        "d_item d_part",
        """SELECT i.pid, i.rid, qty, i.part AS part__raw, p.name AS part
           FROM d_item i LEFT JOIN d_part p ON p.rid = i.part_rid""",
    ),
)
def reference(spark, sf_dir):
    spec = SearchSpec(("item",), ("qty", "part"))
    found = search(catalog.open_store(spark, sf_dir), spec, "display", "raw")
    return found.select("pid", "rid", "qty", "part", "part__raw")


@register(
    "q14_access",
    sql(
        "d_order opages oassign",
        """SELECT o.pid, status FROM d_order o LEFT JOIN opages p USING (pid)
           LEFT JOIN oassign a USING (pid)
           WHERE access_level > 0 AND "exists" = 1 AND (assigned = 1 OR assigned IS NULL)""",
    ),
)
def access(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.pages = catalog.order_pages(spark, sf_dir)
    store.assignments = catalog.order_assignments(spark, sf_dir)
    return search(store, SearchSpec(("order",), ("status",))).drop("rid", "rev")


@register(
    "q14_access_serial",
    sql(
        "d_item opages",
        f"""SELECT i.pid, i.rid, qty FROM d_item i LEFT JOIN opages p USING (pid)
            WHERE access_level > 0 AND "exists" = 1 AND {num("qty")} >= 49""",
    ),
)
def access_serial(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.pages = catalog.order_pages(spark, sf_dir)
    store.assignments = catalog.order_assignments(spark, sf_dir)
    spec = SearchSpec(("item",), ("qty",), filters=(("qty", ">=", "49"),))
    return search(store, spec).drop("rev")


@register(
    "q21_struct_param",
    sql(
        "d_order m_order",
        """SELECT pid, priority FROM d_order o
           WHERE priority IN (SELECT priority FROM d_order WHERE pid = 'order:7')
           AND EXISTS (SELECT 1 FROM m_order m WHERE m.pid = o.pid AND m.value IN
                       (SELECT value FROM m_order WHERE pid = 'order:7'))""",
    ),
)
def struct_param(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    spec = SearchSpec(
        ("order",),
        ("priority",),
        filters=(("priority", "=", "$STRUCT.order.priority$"), ("flags", "=", "$STRUCT.flags$")),
    )
    return search(store, bind(spec, Params(page="order:7"), store)).drop("rid", "rev")


@register(
    "q21_struct_param_affix",
    sql(
        "d_order",
        """SELECT pid, placed FROM d_order o
           WHERE placed > (SELECT placed FROM d_order WHERE pid = 'order:7')
           AND priority ILIKE (SELECT '%' || status || '%' FROM d_order WHERE pid = 'order:7')""",
    ),
)
def struct_param_affix(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    own = PageValue("order", "status", "order:7")
    spec = SearchSpec(
        ("order",),
        ("placed",),
        filters=(("placed", ">", "$STRUCT.order.placed$"), ("priority", "*~", own)),
    )
    return search(store, bind(spec, Params(page="order:7"), store)).drop("rid", "rev")


@register(
    "q22_tag_filter",
    sql(
        "d_part",
        """SELECT rid, type FROM d_part WHERE lower(replace(type,' ','')) = 'promo'
           OR lower(replace(type,' ','')) ILIKE 'eco%'""",
    ),
)
def tag_filter(spark, sf_dir):
    spec = SearchSpec(
        ("part",), ("type",), filters=(("type", "=", "pro MO"), ("type", "~", "E c o*", "OR"))
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("pid", "rev")


@register(
    "q23_reference_filter_sort",
    sql(
        "d_item d_part d_supplier d_nation",
        """SELECT i.pid, i.rid, p.name AS part, n.name AS origin FROM d_item i
           LEFT JOIN d_part p ON p.rid = i.part_rid LEFT JOIN d_supplier s ON s.rid = i.supp_rid
           LEFT JOIN d_nation n ON n.rid = s.nation_rid
           WHERE n.name ILIKE 'nation_1%' AND p.name <> 'red rod'
           ORDER BY lower(n.name), lower(p.name) DESC, i.pid, i.rid LIMIT 300""",
    ),
)
def reference_filter_sort(spark, sf_dir):
    spec = SearchSpec(
        ("item",),
        ("part", "origin"),
        filters=(("origin", "~", "nation_1*"), ("part", "!=", "red rod")),
        sorts=("origin", "^part"),
        limit=300,
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rev")


@register(
    "q27_all_revisions",
    sql(
        "d_user",
        f"""SELECT pid, action, max(rev) AS rev FROM d_user WHERE {num("amount")} > 20 GROUP BY ALL""",
    ),
)
def all_revisions(spark, sf_dir):
    spec = SearchSpec(("user",), ("action",), filters=(("amount", ">", "20"),), latest=False)
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid")


@register(
    "q37_published",
    sql(
        "d_user",
        "SELECT pid, action, amount, max(rev) AS rev FROM d_user WHERE published = 1 GROUP BY ALL",
    ),
)
def published(spark, sf_dir):
    spec = SearchSpec(("user",), ("action", "amount"), publisher=False, latest=False)
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid")


@register(
    "q38_publisher_by_page",
    sql(
        "d_order opages",
        """SELECT o.pid, status, publisher FROM
           (SELECT *, CASE WHEN status = 'P' THEN 1 END AS published FROM d_order) o
           JOIN (SELECT *, CASE WHEN access_level = 1 AND pid LIKE '%1' THEN 1 ELSE 0 END AS publisher
                 FROM opages) p USING (pid)
           WHERE access_level > 0 AND "exists" = 1 AND (publisher = 1 OR published = 1)""",
    ),
)
def publisher_by_page(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    pages = catalog.order_pages(spark, sf_dir)
    rights = (F.col("access_level") == 1) & F.endswith(F.col("pid"), F.lit("1"))
    store.pages = pages.withColumn("publisher", rights.cast("int"))
    state = F.when(F.col("col1") == "P", 1)
    store.data_tables["order"] = store.data("order").withColumn("published", state)
    found = search(store, SearchSpec(("order",), ("status",), publisher="publisher"))
    return found.join(store.pages.select("pid", "publisher"), "pid").drop("rid", "rev")


@register(
    "q39_dynamic_filters",
    sql(
        "d_order",
        f"""SELECT pid, status, total FROM d_order WHERE (status = 'F' OR status = 'O')
            AND (priority = '2-HIGH' AND {num("total")} > 100000)
            ORDER BY {num("total")}, pid LIMIT 40 OFFSET 20""",
    ),
)
def dynamic_filters(spark, sf_dir):
    fixed = SearchSpec(
        ("order",),
        ("status", "total"),
        filters=(("status", "=", "F"), ("status", "=", "O", "OR")),
        sorts=("^placed",),
        limit=40,
    )
    spec = fixed.with_dynamic(
        filters=[
            ("priority", "=", "1-URGENT"),
            ("priority", "=", "2-HIGH"),
            ("total", ">", "100000"),
            ("placed", ">", "2000-01-01"),
            ("placed", ">", " "),
        ],
        sort="total",
        offset=20,
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q40_reader_values",
    sql(
        "d_order",
        """SELECT pid, placed FROM d_order WHERE placed > '2000-05-31' AND placed <= '2001-03-03'
           AND pid ILIKE 'order:%' AND pid <> 'order:12' AND status IN ('F', 'P')""",
    ),
)
def reader_values(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    spec = SearchSpec(
        ("order",),
        ("placed",),
        filters=(
            ("placed", ">", "$DATE(2001-01-31 -8 months)$"),
            ("placed", "<=", "$DATE(+1 month)$"),
            ("%pageid%", "~", "$NS$:*"),
            ("%pageid%", "!=", "$ID$"),
            ("status", "=", "$USER.grps$"),
        ),
    )
    here = Params(page="order:12", today=date(2001, 1, 31), user_info={"grps": ["F", "P"]})
    return search(store, bind(spec, here, store)).drop("rid", "rev")


@register(
    "q41_global_rows",
    sql("d_nation", "SELECT '' AS pid, rid, rid::VARCHAR AS rowid, name FROM d_nation"),
)
def global_rows(spark, sf_dir):
    spec = SearchSpec(("nation",), ("%rowid%", "name"), kind="global")
    found = search(catalog.open_store(spark, sf_dir), spec)
    return found.select("pid", "rid", F.col("%rowid%").alias("rowid"), "name")


@register(
    "q42_serial_rows",
    sql("d_item", "SELECT pid, rid, qty, price FROM d_item WHERE pid = 'order:7'"),
)
def serial_rows(spark, sf_dir):
    spec = SearchSpec(("item",), ("qty", "price"), kind="serial", page="order:7")
    return search(catalog.open_store(spark, sf_dir), spec).drop("rev")


@register(
    "q46_count",
    sql(
        "d_order m_order",
        f"""SELECT count(*) AS count FROM d_order o WHERE {num("total")} > 100000
            AND EXISTS (SELECT 1 FROM m_order m WHERE m.pid = o.pid AND m.value = 'AF')""",
    ),
)
def count(spark, sf_dir):
    spec = SearchSpec(
        ("order",),
        ("status", "flags"),
        filters=(("total", ">", "100000"), ("flags", "=", "AF")),
        limit=10,
    )
    return Search(catalog.open_store(spark, sf_dir), spec).count()


@register(
    "q70_wildcard_columns",
    sql(
        "d_order d_item",
        """SELECT DISTINCT o.pid, o.status, o.priority, o.total, o.customer, i.qty FROM d_order o
           JOIN d_item i USING (pid) WHERE o.status = 'P'""",
    ),
)
def wildcard_columns(spark, sf_dir):
    store = catalog.open_store(spark, sf_dir)
    store.titles = None
    spec = SearchSpec(
        (("order", "o"), "item"),
        ("*", "-placed", "-flags", "item.qty", "o.unknown"),
        filters=(("status", "=", "P"), ("nothing", "=", "x")),
    )
    return search(store, spec).drop("rid", "rev")


@register(
    "q71_first_value_sort",
    sql(
        "d_part m_part words",
        """SELECT p.rid, name, w.words FROM d_part p JOIN words w USING (rid)
           ORDER BY split_part(name, ' ', 1) DESC, lower(brand), p.rid LIMIT 100""",
    ),
)
def first_value_sort(spark, sf_dir):
    spec = SearchSpec(("part",), ("name", "words"), sorts=("^words", "brand"), limit=100)
    found = search(catalog.open_store(spark, sf_dir), spec)
    return listed(found.drop("pid", "rev"), "words")


BASKET = Schema(
    "basket",
    (
        column(1, "status", "Text"),
        column(2, "parts", "Lookup", multi=True, config={"schema": "part", "field": "name"}),
    ),
)


def basket_store(spark, sf_dir):
    """Orders with the list of their parts as references."""
    store = catalog.open_store(spark, sf_dir)
    data = catalog.orders(spark, sf_dir).drop("col2", "col3", "col4", "col5", "col6")
    data = data.withColumn("col2", F.lit(""))
    multi = catalog.table(spark, sf_dir, "lineitem").selectExpr(
        "2 AS colref",
        "CONCAT('order:', l_orderkey) AS pid",
        "0L AS rid",
        "l_orderkey + 1 AS rev",
        *catalog.CURRENT,
        "CAST(l_linenumber AS BIGINT) AS row",
        """CONCAT('["",', l_partkey + 1, ']') AS value""",
    )
    return store.add(BASKET, data, multi)


@register(
    "q64_reference_lists",
    sql(
        "d_order d_item d_part",
        """SELECT pid, status, coalesce(parts, '') AS parts, coalesce(refs, '') AS parts__raw
           FROM d_order LEFT JOIN (
             SELECT pid, string_agg(name, ',' ORDER BY mr, part) AS parts,
                    string_agg(part, ',' ORDER BY mr, part) AS refs FROM (
               SELECT i.pid, i.part, p.name, min(i.line) AS mr FROM d_item i
               LEFT JOIN d_part p ON p.rid = i.part_rid GROUP BY ALL) GROUP BY pid) USING (pid)""",
    ),
)
def reference_lists(spark, sf_dir):
    spec = SearchSpec(("basket",), ("status", "parts"))
    found = search(basket_store(spark, sf_dir), spec, "display", "raw")
    out = listed(found, "parts", "parts__raw")
    return out.select("pid", "status", "parts", "parts__raw")


@register(
    "q65_reference_list_filter",
    sql(
        "d_order d_item d_part",
        """SELECT pid, status FROM d_order o WHERE status = 'F' AND EXISTS (
           SELECT 1 FROM d_item i JOIN d_part p ON p.rid = i.part_rid
           WHERE i.pid = o.pid AND p.name ILIKE 'red g%')""",
    ),
)
def reference_list_filter(spark, sf_dir):
    spec = SearchSpec(
        ("basket",), ("status",), filters=(("parts", "~", "red g*"), ("status", "=", "F"))
    )
    return search(basket_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q76_text_search",
    sql(
        "d_doc",
        f"""SELECT pid, lang, size FROM d_doc WHERE (body ILIKE '%license%' OR body ILIKE '%password%')
            AND {num("size")} > 100""",
    ),
)
def text_search(spark, sf_dir):
    spec = SearchSpec(
        ("doc",),
        ("lang", "size"),
        filters=(Filter("body", "*~", ["license", "password"]), Filter("size", ">", "100")),
    )
    return search(catalog.open_store(spark, sf_dir), spec).drop("rid", "rev")


@register(
    "q77_later_schema_lists",
    sql(
        "d_item d_order m_order flags",
        f"""SELECT DISTINCT i.pid, i.rid, i.qty, o.status, f.flags FROM d_item i
            JOIN d_order o USING (pid) JOIN flags f USING (pid) WHERE {num("i.qty")} = 50""",
    ),
)
def later_schema_lists(spark, sf_dir):
    spec = SearchSpec(
        ("item", "order"), ("qty", "status", "flags"), filters=(("qty", "=", "50"),)
    )
    found = search(catalog.open_store(spark, sf_dir), spec)
    return listed(found.drop("rev"), "flags")
