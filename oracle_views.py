"""The page-data views of ``catalog.py`` in SQL, for the side-by-side check."""

from __future__ import annotations

NUMERIC_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

VIEWS = {
    "d_order": """SELECT 'order:'||o_orderkey AS pid, o_orderkey+1 AS rev, o_orderstatus AS status,
        o_orderpriority AS priority, printf('%.2f', o_totalprice) AS total,
        strftime(o_orderdate, '%Y-%m-%d') AS placed, 'customer:'||o_custkey AS customer FROM orders""",
    "m_order": """SELECT 'order:'||l_orderkey AS pid, l_orderkey+1 AS rev, l_linenumber AS rn,
        l_returnflag||l_linestatus AS value FROM lineitem""",
    "flags": """SELECT pid, rev, string_agg(value, ',' ORDER BY mr, value) AS flags FROM
        (SELECT pid, rev, value, min(rn) AS mr FROM m_order GROUP BY ALL) GROUP BY pid, rev""",
    "d_item": """SELECT 'order:'||l_orderkey AS pid, l_linenumber AS line,
        (l_partkey%536870912)*17179869184 + (l_suppkey%2147483648)*8 + l_linenumber%8 AS rid,
        printf('%.2f', l_quantity) AS qty, printf('%.2f', l_extendedprice) AS price,
        '["",'||(l_partkey+1)||']' AS part, '["",'||(l_suppkey+1)||']' AS origin,
        l_partkey+1 AS part_rid, l_suppkey+1 AS supp_rid FROM lineitem""",
    "d_part": """SELECT p_partkey+1 AS rid, p_name AS name, p_brand AS brand, p_type AS type,
        p_size::VARCHAR AS size FROM part""",
    "m_part": """SELECT p_partkey+1 AS rid, unnest(string_split(p_name,' ')) AS value,
        generate_subscripts(string_split(p_name,' '), 1) AS rn FROM part""",
    "words": """SELECT rid, string_agg(value, ',' ORDER BY mr, value) AS words FROM
        (SELECT rid, value, min(rn) AS mr FROM m_part GROUP BY ALL) GROUP BY rid""",
    "d_supplier": "SELECT s_suppkey+1 AS rid, s_name AS name, s_nationkey+1 AS nation_rid FROM supplier",
    "d_nation": "SELECT n_nationkey+1 AS rid, n_name AS name, n_regionkey+1 AS region_rid FROM nation",
    "d_user": """SELECT 'user:'||user_id AS pid, epoch_us(ts) AS rev, event_type AS action,
        printf('%.2f', value) AS amount, CASE WHEN event_id % 3 = 0 THEN 1 END AS published FROM events""",
    "d_doc": """SELECT lang||':'||source||':doc'||doc_id AS pid, doc_id+1 AS rev, lang, source,
        n_chars::VARCHAR AS size, text AS body, lang||':'||source AS ns FROM documents""",
    "titles": """SELECT 'customer:'||c_custkey AS pid, CASE WHEN c_custkey % 11 = 0 THEN ''
        ELSE c_name END AS title, 'editor'||(c_custkey % 7) AS lasteditor,
        1600000000 + c_custkey*86399 AS lastrev, 'Summary '||(c_custkey % 13) AS lastsummary
        FROM customer""",
    "otitles": """SELECT 'order:'||o_orderkey AS pid, 'Order '||o_orderkey AS title,
        'editor'||(o_orderkey % 7) AS lasteditor, 1600000000 + o_orderkey*86399 AS lastrev,
        'Summary '||(o_orderkey % 13) AS lastsummary FROM orders""",
    "opages": """SELECT 'order:'||o_orderkey AS pid,
        CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS "exists",
        CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS access_level FROM orders""",
    "oassign": """SELECT 'order:'||o_orderkey AS pid, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END
        AS assigned FROM orders WHERE o_orderkey % 5 <> 0""",
}


def num(text: str) -> str:
    """Numeric value of a text, 0 without a numeric prefix."""
    return f"coalesce(try_cast(regexp_extract({text}, '{NUMERIC_PREFIX}', 1) AS DOUBLE), 0)"


def sql(views: str, body: str, **extra: str) -> str:
    """A statement over the named views and further ones."""
    parts = {name: VIEWS[name] for name in views.split()}
    parts.update(extra)
    heads = ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
    return f"WITH {heads}\n{body}" if parts else body
