from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagegrain import StructureError
from pagegrain.functions.ids import clean_id
from pagegrain.functions.regexes import java_regex, required_texts
from pagegrain.operators import assignment as a
from pagegrain.sources.registry import Registry


@pytest.fixture
def frame(make):
    return make.frame


PATTERNS = ["zoo:birds:owl", "zoo:birds:*", "zoo:*", "zoo:**", "*", "**", "/^zoo:/", "/BIRD/", "/BIRD/i", "/owl$/"]
FITTING = {
    "zoo:birds:owl": {"zoo:birds:owl", "zoo:birds:*", "zoo:**", "/BIRD/i", "/owl$/"},
    "zoo:birds:rails:coot": {"zoo:**", "/BIRD/i"},
    "zoo:gate": {"zoo:*", "zoo:**"},
    "zoo": {"*"},
    "owl": {"*", "/owl$/"},
    "park:birds": {"/BIRD/i"},
}


def test_patterns(frame):
    """One level, all levels below a namespace, exact ids and expressions (which see a leading colon)."""
    pages = frame("pid string", *[(page,) for page in FITTING])

    def found(*patterns):
        pairs = a.matching_schemas(pages, [(p, p) for p in patterns]).collect()
        return {page: {r["tbl"] for r in pairs if r["pid"] == page} for page in FITTING}

    by_page = found(*PATTERNS, "/^:?zoo:/")
    for page, others in FITTING.items():
        inside = {"/^:?zoo:/"} if page.startswith("zoo:") else set()
        assert by_page[page] == others | inside | {"**"}, page
    assert not any(found().values())


# Expression and the texts every match has to hold.
REQUIRED = {
    "/abc/": {"abc"}, "/ab?c+d/": {"a", "d"}, "/^zoo:.*owl$/": {"zoo:", "owl"}, "/a(bc)?d(?:ef)g/": {"a", "d", "g"},
    "/ab|cd/": set(), "/(ab|cd)ef/": {"ef"}, "/[a-c]x{0,2}yz/": {"yz"}, r"/a\.b\dc/": {"a", "b", "c"}, "/a((b(c)d)e)f/": {"a", "f"},
    r"/\Qa*\Eb/": set(), "/OWL/i": {"owl"}, "/OWL/": {"OWL"}, "/(?x)a b/": set(), "/a b/x": set(), "/(?i)Ab/": {"ab"}, "/a(?i)B/": set(),
    r"/\x41b/": set(), "/[a[b]]c/": set(), "/.+/": set(), "/x*+y*?z/": {"z"}, "/Kb/i": {"b"}, "/a/b/c/": {"a", "b", "c"},
}


def test_required_texts(evaluate):
    found = evaluate(lambda c: required_texts(java_regex(c)), *REQUIRED)
    assert dict(zip(REQUIRED, map(set, found))) == REQUIRED


def test_pattern_tables_against_every_pair(frame):
    """A table of patterns finds what trying every expression on every page finds."""
    pids = ["zoo:birds:owl", "zoo:gate", "x41b", "a:b", "abcd", "ad", "adefg", "owl:9", "ab.b7c", "Zoo:Birds:Owl", "xyz", "ä:b", "z"]
    bodies = [p for p in REQUIRED if p != "/a b/x"] + ["/:a/", "/b$/", "/^:z$/", "/w:9|d$/", "/o{2}/", "/z?/", "/no such text/"]
    pages = frame("pid string", *[(p,) for p in pids], (None,), ("",))
    table = frame("pattern string, tbl string, n int", *[(p, f"t{n % 4}", n) for n, p in enumerate(bodies)], (None, "t", 0), ("/a/", None, 0))
    found = {(r["pid"], r["tbl"]) for r in a.matching_schemas(pages, table).collect()}
    each = pages.crossJoin(table.dropna().select("tbl", java_regex(F.col("pattern")).alias("regex")))
    fits = each.filter(F.regexp_like(F.concat(F.lit(":"), clean_id(F.col("pid"))), F.col("regex")))
    assert found == {(r["pid"], r["tbl"]) for r in fits.collect()}
    assert a.matching_schemas(pages.limit(0), table).count() == 0 == a.matching_schemas(pages, table.limit(0)).count()


def test_unreadable_expressions(frame):
    pages = frame("pid string", ("a",))
    for pattern in ("/a", "/a/q", "/"):
        with pytest.raises(StructureError):
            a.matching_schemas(pages, [(pattern, "t")])
    with pytest.raises(Exception, match="between slashes"):
        a.matching_schemas(pages, frame("pattern string, tbl string", ("/a/q", "t"))).collect()


def settled(df):
    """A step's result as its caller would read it back after writing it."""
    return df.sparkSession.createDataFrame([tuple(r) for r in df.collect()], df.schema)


def state(df):
    return {(r["pid"], r["tbl"]): r["assigned"] for r in df.collect()}


def test_patterns_as_a_table(frame, tmp_path):
    (tmp_path / "patterns.json").write_text('{"pattern": "a:*", "tbl": "foo"}\n{"pattern": "/b$/", "tbl": "bar"}\n')
    patterns = a.load_patterns(frame("x int", (1,)).sparkSession, str(tmp_path / "patterns.json"))
    known = frame("pid string, tbl string, assigned int", ("a:b", "bar", 0), ("c", "bar", 1))
    patterns, known = map(settled, a.add_pattern(known, patterns, "**", "foo"))
    assert state(known) == {("a:b", "bar"): 0, ("c", "bar"): 1, ("a:b", "foo"): 1, ("c", "foo"): 1}
    patterns, known = map(settled, a.remove_pattern(known, patterns, "**", "foo"))
    assert state(known)["a:b", "foo"] == 1 and state(known)["c", "foo"] == 0
    patterns, known = map(settled, a.replace_patterns(known, patterns, "bar", ["c"]))
    assert {tuple(r) for r in patterns.collect()} == {("a:*", "foo"), ("c", "bar")}
    assert state(known) == {("a:b", "foo"): 1, ("c", "foo"): 0, ("c", "bar"): 1}


def test_life_of_assignments(frame):
    known = frame("pid string, tbl string, assigned int", ("a:b:c", "x", 1), ("a:d", "x", 1), ("e", "y", 0))
    patterns, known = a.add_pattern(known, [], "a:**", "foo")
    known = settled(known)
    assert state(known) == {("a:b:c", "x"): 1, ("a:d", "x"): 1, ("e", "y"): 0, ("a:b:c", "foo"): 1, ("a:d", "foo"): 1}
    patterns, known = a.add_pattern(known, patterns, "a:b:*", "foo")
    known = settled(known)
    patterns, known = a.remove_pattern(known, patterns, "a:**", "foo")
    known = settled(known)
    assert state(known)[("a:b:c", "foo")] == 1 and state(known)[("a:d", "foo")] == 0
    assert [tuple(r) for r in a.page_listing(known, "foo").collect()] == [("a:b:c", "foo", 1), ("a:d", "foo", 0)]
    assert a.page_listing(known, "foo", assigned_only=True).count() == 1

    only = a.reevaluate(known, patterns, frame("pid string", ("a:b:c",)))
    assert state(only) == {**state(known), ("a:b:c", "x"): 0}
    patterns, known = a.replace_patterns(known, patterns, "foo", ["e"])
    known = settled(known)
    assert patterns == [("e", "foo")]
    assert {k: v for k, v in state(known).items() if k[1] == "foo"} == {("e", "foo"): 1}
    _, soft = a.clear(known)
    assert set(state(soft).values()) == {0}
    _, gone = a.clear(known, full=True)
    assert gone.count() == 0


def test_historic(make):
    make.add(make.schema("birds", "f", ts=20), [("owl", 0, 30, 1, None, "x"), ("coot", 0, 75, 1, None, "x")])
    store = make.add(make.schema("rails", "f", ts=100), [("coot", 0, 45, 1, None, "x"), ("owl", 0, 110, 1, None, "x")])

    def found(ts, registry=None):
        return sorted(tuple(r) for r in a.historic_schemas(store, ts, registry=registry).collect())

    assert found(50) == [("owl", "birds")] and found(10) == []
    # the store holds the second version of one schema; its first one is older
    registry = Registry.empty(store.spark)
    for version in (replace(store.schema("rails"), ts=40), store.schema("rails"), store.schema("birds")):
        registry, _ = registry.with_version(version)
    assert found(50, registry) == [("coot", "rails"), ("owl", "birds")]
    assert found(39, registry) == [("owl", "birds")]


def test_expressions_with_numbers_meet_few_pages(spark):
    """Grams of three signs would lead each of these expressions to some tens of pages, the more the more pages there are."""
    pages = spark.range(2000).selectExpr("concat('en:src:doc', id) AS pid")
    regexes = spark.range(100).selectExpr("concat('doc', 1000 + 7 * id, '$') AS regex")
    keyed = a._expression_keys(pages, regexes.withColumn("texts", required_texts(F.col("regex"))))
    found = a._page_grams(pages).join(keyed, "key")
    assert found.count() == keyed.count() == 100
    table = spark.range(100).selectExpr("concat('/doc', 1000 + 7 * id, '$/') AS pattern", "concat('t', id % 3) AS tbl")
    pairs = a.matching_schemas(pages, table.unionByName(table.withColumn("tbl", F.lit("u")))).collect()
    assert {(r.pid, r.tbl) for r in pairs} == {(f"en:src:doc{1000 + 7 * n}", t) for n in range(100) for t in (f"t{n % 3}", "u")}


def test_a_gram_on_many_pages_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(a, "PART_PAGES", 10)
    pages = spark.range(500).selectExpr("concat('n', id % 3, ':p', id) AS pid")
    pairs = a.matching_schemas(pages, spark.createDataFrame([("/n1:p.*[05]$/", "five"), ("/^:n2/", "two"), ("/zebra/", "none")], "pattern string, tbl string")).collect()
    wanted = {(f"n1:p{n}", "five") for n in range(500) if n % 3 == 1 and n % 5 == 0} | {(f"n2:p{n}", "two") for n in range(500) if n % 3 == 2}
    assert len(pairs) == len(wanted) and {(r.pid, r.tbl) for r in pairs} == wanted
