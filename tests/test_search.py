from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import functions as F

from pagegrain import (
    ColumnType, Filter, PageValue, Params, Search, SearchSpec, Store, StructureError, bind,
    register_type, search,
)
from pagegrain.functions.text import compare
from pagegrain.plans.params import bound_value
from pagegrain.plans.names import Names


@pytest.fixture
def two_schemas(make):
    """Two plots described in both schemas, and seven beds in the second only."""
    plots = make.schema("plots", "name", "crops[]", "soil", "remark")
    harvest = make.schema("harvest", "crop", "tools[]", "weather", ("weight", "Decimal"))
    make.pages(
        plots,
        orchard=("Old orchard", ["apple", "wild apple", "pear"], "loam", "mow twice"),
        **{"farm:north": ("North field", ["rye", "oat"], "", "stony")},
    )
    rows = {
        "orchard": ("apple", ["ladder", "wild apple"], "dry", "0"),
        "farm:north": ("rye", ["rye", "sickle"], "dry", "4"),
    }
    for n in range(3, 10):
        rows[f"bed{n}"] = (f"bean {n}", [f"hoe {n}"], f"rain {n}", str(4 * n))
    return make.pages(harvest, **rows)


def pids(df):
    return [row["pid"] for row in df.collect()]


def test_simple(two_schemas):
    found = search(two_schemas, SearchSpec(("plots",), ("%pageid%", "crops", "name"))).collect()
    assert {row["%pageid%"]: (row["crops"], row["name"]) for row in found} == {
        "farm:north": (["rye", "oat"], "North field"),
        "orchard": (["apple", "wild apple", "pear"], "Old orchard"),
    }


def test_unknown_names(two_schemas):
    for wrong in (
        SearchSpec(("woods",), ("name",)),
        SearchSpec(("plots",), ("owner",)),
        SearchSpec(("plots",), ("name",), filters=(("name", "<>?", "x"),)),
    ):
        with pytest.raises(StructureError):
            search(two_schemas, wrong)
    ignored = SearchSpec(("plots",), ("owner", "soil", "name"), filters=(("owner", "!=", "x"),), sorts=("^owner",))
    assert search(two_schemas, ignored).count() == 2


def test_two_schemas_and_paging(two_schemas):
    joined = SearchSpec(
        (("harvest", "h"), "plots"), ("%pageid%", "name", "h.crop"), filters=(("plots.soil", "!=", ""), ("h.tools", "=", "ladder"))
    )
    assert [(r["%pageid%"], r["crop"]) for r in search(two_schemas, joined).collect()] == [("orchard", "apple")]
    either = SearchSpec(
        ("plots", "harvest"), ("remark",), filters=(("crops", "~", "*wild*"), ("weight", ">", "3", "OR"), ("crop", "=", "none", "OR"))
    )
    assert sorted(pids(search(two_schemas, either))) == ["farm:north", "orchard"]

    paged = SearchSpec(("harvest",), ("crop",), filters=(("%pageid%", "~", "bed*"),), sorts=("^weight",), limit=3)
    assert Search(two_schemas, paged).count().first()[0] == 7
    pages = [pids(search(two_schemas, paged.with_dynamic(offset=n))) for n in (0, 3, 6, 9)]
    assert pages == [["bed9", "bed8", "bed7"], ["bed6", "bed5", "bed4"], ["bed3"], []]


def test_global_rows_of_two_schemas_make_no_pairs(make):
    make.add(make.schema("a", "x"), [("", n, 0, 1, None, f"a{n}") for n in range(1, 6)])
    store = make.add(make.schema("b", "y"), [("", n, 0, 1, None, f"b{n}") for n in range(1, 6)] + [("p", 0, 5, 1, None, "b")])
    assert search(store, SearchSpec(("a", "b"), ("x", "y"))).count() == 0
    with pytest.raises(StructureError):
        search(store, SearchSpec(("a", "b"), ("x", "y"), kind="global"))


def test_wildcards_and_exclusion(two_schemas):
    def labels(*columns):
        return Search(two_schemas, SearchSpec(("harvest", ("plots", "p")), columns)).output_names

    assert labels("*") == ["crop", "tools", "weather", "weight"]
    assert labels("weather", "p.*", "-crops", "-name") == ["weather", "soil", "remark"]
    assert labels("nothing.soil") == ["soil"]


def test_decimals_sort_and_filter_by_number(make):
    schema = make.schema("scales", ("weight", "Decimal"))
    cells = dict(a="20", b="3", c="-4.25", d="3.0001", e="", f="1e2", g="007")
    store = make.pages(schema, **{page: (cell,) for page, cell in cells.items()})
    assert pids(search(store, SearchSpec(("scales",), ("weight",), sorts=("weight",)))) == ["c", "b", "d", "g", "a", "f"]

    def found(comparator, value):
        spec = SearchSpec(("scales",), ("%pageid%",), filters=(("weight", comparator, value),))
        return "".join(sorted(pids(search(store, spec))))

    assert [found(c, "7") for c in ("<", "<=", "=", "!=", ">=", ">")] == ["bcd", "bcdg", "g", "abcdf", "afg", "af"]


def test_whole_numbers_beyond_doubles(make):
    schema = make.schema("scales", ("weight", "Decimal"))
    base = 2**53
    store = make.pages(schema, a=(str(base + 1),), b=(str(base),), c=(f"-{base + 1}",), d=(f"{base}.5",), e=("9.1e15",))

    def found(comparator, value):
        spec = SearchSpec(("scales",), ("%pageid%",), filters=(("weight", comparator, value),))
        return "".join(sorted(pids(search(store, spec))))

    assert found("=", str(base)) in ("b", "bd") and found("=", str(base + 1)) == "a"
    assert "a" in found(">", str(base)) and "b" not in found(">", str(base))
    assert found("<", f"-{base}") == "c"
    order = pids(search(store, SearchSpec(("scales",), ("weight",), sorts=("weight",))))
    assert order[0] == "c" and order.index("b") < order.index("a") and order[-1] == "e"


def test_dates_compare_as_text(make):
    store = make.pages(make.schema("log", ("at", "DateTime")), a=("1999-12-31 23:59",), b=("2000-01-01 00:00",), c=("2000-01-01 00:01",))

    def found(comparator, value):
        return pids(search(store, SearchSpec(("log",), ("at",), filters=(("at", comparator, value),), sorts=("at",))))

    assert found(">=", "2000-01-01") == ["b", "c"] and found("<", "2000") == ["a"]
    assert found(">", "2000-01-01 00:00") == ["c"] and found("=", "1999-12-31") == []


def test_text_affixes(make):
    schema = make.schema("t", ("field", "Text", {"prefix": "before", "postfix": "after"}))
    store = make.pages(schema, a=("x",), b=("y",))

    def found(comparator, value):
        spec = SearchSpec(("t",), ("field",), filters=(("field", comparator, value),))
        return sorted(pids(search(store, spec)))

    assert found("=", "beforexafter") == ["a"]
    assert found("=", "x") == []
    assert found("~", "before*") == ["a", "b"]
    assert found("!~", ["beforex*", "beforey*"]) == ["a", "b"]


def kinds_store(make):
    """Three hives, each with a page row and two serial rows."""
    schema = make.schema("hives", "note", "seen[]", ("mites", "Decimal"))
    rows = []
    for n, seen in enumerate((["brood", "queen"], ["honey"], ["honey", "queen"])):
        rows.append((f"hive{n}", 0, 40, 1, None, f"page {n}", seen, "2"))
        rows += [(f"hive{n}", 2 * n + k, 0, 1, None, f"visit {n}.{k}", seen[:k], "0") for k in (1, 2)]
    return make.add(schema, rows)


def test_kinds_and_assignments(make):
    store = kinds_store(make)
    everything = SearchSpec(("hives",), ("note", "seen"))
    assert search(store, everything).count() == 9
    queens = SearchSpec(("hives",), ("note", "seen"), filters=(("seen", "=", "queen"),))
    rows = {row["note"]: row["seen"] for row in search(store, queens).collect()}
    assert rows == {note: ["brood", "queen"] for note in ("page 0", "visit 0.2")} | {note: ["honey", "queen"] for note in ("page 2", "visit 2.2")}
    other = SearchSpec(("hives",), ("note",), filters=(("seen", "!=", "honey"),))
    assert {row["note"] for row in search(store, other).collect()} == {"page 0", "visit 0.1", "visit 0.2", "page 2", "visit 2.2"}
    visits = SearchSpec(("hives",), ("note",), kind="serial", page="hive1")
    assert sorted(row["note"] for row in search(store, visits).collect()) == ["visit 1.1", "visit 1.2"]

    # page rows need their assignment, serial rows do not
    store.assignments = make.frame("pid string, tbl string, assigned int", ("hive2", "hives", 0), ("hive1", "sheds", 0))
    assert search(store, everything).count() == 8
    store.pages = make.frame("pid string, exists int, access_level int", ("hive0", 1, 0), ("hive1", 1, 2), ("hive2", 1, 1))
    assert search(store, everything).count() == 5


def test_publishing(make):
    schema = make.schema("s", "a")
    store = make.add(
        schema,
        [
            ("p", 0, 1, 0, 1, "published"),
            ("p", 0, 2, 1, None, "latest"),
            ("q", 0, 3, 1, None, "draft"),
        ],
    )
    spec = SearchSpec(("s",), ("a",))

    def cells(**changes):
        return sorted(row["a"] for row in search(store, replace(spec, **changes)).collect())

    assert cells() == ["draft", "latest"]
    assert cells(publisher=False) == ["published"]
    assert cells(latest=False) == ["draft", "latest", "published"]


def test_readers_see_equal_revisions_once(make):
    schema = make.schema("s", "a", "b[]")
    rows = [(p, 0, rev, int(rev == 3), int(rev < 3), cell, [f"{p}{rev}"]) for p in "pq" for rev, cell in ((1, "same"), (2, "same"), (3, "new"))]
    store = make.add(schema, rows)
    spec = SearchSpec(("s",), ("a", "b"), publisher=False, sorts=("%pageid%",))
    for limit in (0, 2):
        found = search(store, replace(spec, limit=limit)).collect()
        assert [(r["pid"], r["rev"], r["a"], sorted(r["b"])) for r in found] == [("p", 2, "same", ["p1", "p2"]), ("q", 2, "same", ["q1", "q2"])]


def test_titles(make):
    schema = make.schema("routes", ("goal", "Page", {"usetitles": True}))
    make.titles(("hut:a", "Mill", "", 1, ""), ("hut:b", "Barn", "", 1, ""), ("hut:c", "Mill", "", 1, ""), ("hut:d", "", "", 1, ""))
    store = make.pages(schema, r1=("hut:c",), r2=("hut:b",), r3=("attic",), r4=("hut:a",), r5=("",))
    rows = search(store, SearchSpec(("routes",), ("goal",), sorts=("^goal",)), "display", "raw").collect()
    assert [(r["goal"], r["goal__raw"]) for r in rows] == [("Mill", "hut:c"), ("Mill", "hut:a"), ("Barn", "hut:b"), ("attic", "attic")]

    def found(comparator, value):
        return sorted(pids(search(store, SearchSpec(("routes",), ("goal",), filters=(("goal", comparator, value),)))))

    assert found("~", "mil*") == ["r1", "r4"]
    assert found("=", "hut:a") == ["r4"] and found("=", "attic") == ["r3"]


def lookups(make):
    target = make.schema("target", ("single", "Page", {"usetitles": True}), "word")
    source = make.schema(
        "source",
        ("ref", "Lookup", {"schema": "target", "field": "single"}),
        ("refs[]", "Lookup", {"schema": "target", "field": "word"}),
        ("chain", "Lookup", {"schema": "source", "field": "ref"}),
    )
    make.titles(("wiki", "A Wiki", "", 1, ""))
    make.add(target, [("t1", 0, 5, 1, None, "wiki", "one"), ("", 7, 0, 1, None, "none", "two")])
    return make.add(
        source,
        [
            ("s1", 0, 5, 1, None, '["t1",0]', ['["",7]', '["t1",0]', '["gone",0]'], '["s2",0]'),
            ("s2", 0, 5, 1, None, '["",7]', [], '["s1",0]'),
            ("s3", 0, 5, 1, None, "broken", [], ""),
        ],
    )


def test_references(make):
    store = lookups(make)
    rows = search(store, SearchSpec(("source",), ("ref", "refs", "chain"), sorts=("ref",)), "display", "raw", "compare")
    by_page = {row["pid"]: row for row in rows.collect()}
    assert by_page["s1"]["ref"] == "A Wiki"
    assert by_page["s1"]["ref__raw"] == '["t1",0]'
    assert by_page["s1"]["ref__compare"] == "wiki"
    assert by_page["s1"]["refs"] == ["two", "one", ""]
    assert by_page["s1"]["chain"] == "none"
    assert by_page["s2"]["chain"] == "A Wiki"
    hit = SearchSpec(("source",), ("ref",), filters=(("ref", "~", "a w*"),))
    assert pids(search(store, hit)) == ["s1"]
    hit = SearchSpec(("source",), ("ref",), filters=(("refs", "=", "two"),))
    assert pids(search(store, hit)) == ["s1"]
    order = SearchSpec(("source",), ("%pageid%", "ref"), sorts=("^ref",))
    assert pids(search(store, order)) == ["s1", "s2", "s3"]


def test_endless_references_are_refused(make):
    schema = make.schema("loop", ("ref", "Lookup", {"schema": "loop", "field": "ref"}))
    store = make.pages(schema, a=('["a",0]',))
    with pytest.raises(StructureError):
        search(store, SearchSpec(("loop",), ("ref",)))
    make.pages(make.schema("ping", ("to", "Lookup", {"schema": "pong", "field": "to"})), a=('["a",0]',))
    store = make.pages(make.schema("pong", ("to", "Lookup", {"schema": "ping", "field": "to"})), a=('["a",0]',))
    with pytest.raises(StructureError):
        search(store, SearchSpec(("ping",), ("to",)))


def test_a_long_chain_of_references(make):
    last = 12
    for n in range(last):
        make.pages(make.schema(f"s{n}", ("ref", "Lookup", {"schema": f"s{n + 1}", "field": "ref"})), x=('["x",0]',))
    store = make.pages(make.schema(f"s{last}", ("ref", "Decimal", {"postfix": " m"})), x=("7.50",))
    found = search(store, SearchSpec(("s0",), ("ref",))).collect()
    assert [r["ref"] for r in found] == ["7.5 m"] or [r["ref"] for r in found] == ["7.50"]


def test_language_column(make):
    words = make.schema("words", "en", "de")
    source = make.schema("s", ("word", "Lookup", {"schema": "words", "field": "$LANG"}))
    make.pages(words, w=("tree", "Baum"))
    store = make.pages(source, a=('["w",0]',))
    shown = {}
    for language in ("en", "de", "fr"):
        store.language = language
        shown[language] = search(store, SearchSpec(("s",), ("word",))).first()["word"]
    assert shown == {"en": "tree", "de": "Baum", "fr": "tree"}


def test_empty_rows_are_dropped(make):
    schema = make.schema("s", "a", "b[]")
    store = make.pages(schema, full=("x", []), listed=("", ["y"]), blank=(" ", ["", " "]), none=("", []))
    spec = SearchSpec(("s",), ("%pageid%", "a", "b"))
    assert sorted(pids(search(store, spec))) == ["full", "listed"]
    limited = SearchSpec(("s",), ("%pageid%", "a", "b"), sorts=("%pageid%",), limit=2)
    assert pids(search(store, limited)) == ["full", "listed"]
    assert Search(store, limited).count().first()[0] == 2
    assert search(store, SearchSpec(("s",), ("%pageid%",))).count() == 4
    rows = Search(store, spec).exploded(2).select("pid", "c2_raw").collect()
    assert sorted(map(tuple, rows)) == [("full", ""), ("listed", "y")]


def test_lists_keep_order_and_each_value_once(make):
    schema = make.schema("s", "a[]")
    store = make.pages(schema, p=(["c", "a", "c", "b", "a"],))
    assert search(store, SearchSpec(("s",), ("a",))).first()["a"] == ["c", "a", "b"]


def test_merged_revisions(make):
    schema = make.schema("s", "a", "b[]")
    store = make.add(
        schema,
        [
            ("p", 0, 1, 0, None, "x", ["one"]),
            ("p", 0, 2, 0, None, "x", ["two"]),
            ("p", 0, 3, 1, None, "y", ["three"]),
        ],
    )
    rows = search(store, SearchSpec(("s",), ("a", "b"), latest=False)).collect()
    assert sorted((r["rev"], r["a"], sorted(r["b"])) for r in rows) == [
        (2, "x", ["one", "two"]),
        (3, "y", ["three"]),
    ]


def test_dynamic_parameters(two_schemas):
    spec = SearchSpec(("harvest",), ("crop",), filters=(("weight", ">", "12"),), sorts=("crop",))
    spec = spec.with_dynamic(filters=[("tools", "~", "hoe*"), ("weather", "~", "ain 8"), ("weather", "~", "  ")], sort="^weight")
    assert pids(search(two_schemas, spec)) == [f"bed{n}" for n in range(9, 3, -1)]


def test_placeholders(two_schemas):
    names = Names(two_schemas, SearchSpec(("plots",), ("name",)))
    here = Params(page="farm:west:hut", user="hilda", user_info={"name": "Hilda H", "mail": "h@farm.example", "grps": ["herd", "mill"]})

    def value(text):
        return bound_value(text, here, names)

    assert value("[$ID$]") == "[farm:west:hut]"
    assert value("$USER$ at $PAGE$ in $NS$") == "hilda at hut in farm:west"
    assert value("$NSORID$") == "farm:west:hut"
    assert bound_value("$NSORID$", Params(page="farm:start", is_start=True), names) == "farm"
    assert value("$USER.grps$") == ["herd", "mill"] and value("$USER.mail$") == "h@farm.example"
    assert value("$STRUCT.crops$") == PageValue("plots", "crops", "farm:west:hut")
    assert value("<$STRUCT.harvest.weather$>") == PageValue("harvest", "weather", "farm:west:hut", "<", ">")
    for wrong in ("$USER.shoe size$", "$DATE(when the cows come home)$"):
        with pytest.raises(StructureError):
            value(wrong)


def test_values_of_the_current_page(two_schemas):
    def found(text, page, comparator="="):
        spec = SearchSpec(("harvest",), ("crop",), filters=(("tools", comparator, text),))
        return sorted(pids(search(two_schemas, bind(spec, Params(page=page), two_schemas))))

    assert found("$STRUCT.plots.crops$", "orchard") == ["orchard"]
    assert found("$STRUCT.plots.crops$", "farm:north") == ["farm:north"]
    assert found("$STRUCT.plots.crops$", "bed4") == []
    assert found("*$STRUCT.harvest.tools$", "bed4", "~") == ["bed4"]
    spec = SearchSpec(("harvest",), ("crop",), filters=(("crop", "=", "$STRUCT.plots.owner$"),))
    with pytest.raises(StructureError):
        search(two_schemas, bind(spec, Params(page="orchard"), two_schemas))


def test_values_of_a_page_are_joined_by_the_rules_of_the_type(make):
    """Equality, order and inequality against several values give what one comparison after another gives."""
    cells = {"p": "7", "q": "07.0", "r": "12", "s": "", "t": None, "u": "x", "v": "9007199254740993", "w": "A b"}
    kinds = ("Text", "Decimal", "Tag", ("Text", {"prefix": "x"}), ("Page", {"usetitles": True}))
    named = [(f"c{n}", *(k if isinstance(k, tuple) else (k,))) for n, k in enumerate(kinds)]
    make.pages(make.schema("rows", *named), **{pid: (c,) * len(kinds) for pid, c in cells.items()})
    make.titles(("7", "12", "", 0, ""), ("x", "7", "", 0, ""))
    values = {"one": ["7"], "two": ["7", "12", " "], "big": ["9007199254740992"], "tag": ["aB"], "affixed": ["x7"], "none": []}
    store = make.pages(make.schema("own", "list[]"), **{pid: (v,) for pid, v in values.items()})

    expected = [
        ("c0", "=", "two", "pr"), ("c0", "!=", "two", "pqrsuvw"), ("c0", "<", "two", "qrs"), ("c0", "=", "none", "s"),
        ("c1", "=", "two", "pqr"), ("c1", "=", "big", ""), ("c1", ">", "big", "v"), ("c1", "!=", "one", "ruvw"), ("c1", "<=", "two", "pqruw"),
        ("c2", "=", "tag", "w"), ("c3", "=", "affixed", "p"), ("c4", "=", "two", "pru"),
    ]
    parts = []
    for label, comparator, page, _ in expected:
        spec = SearchSpec(("rows",), ("%pageid%",), filters=((label, comparator, PageValue("own", "list", page)),))
        parts.append(search(store, spec).select("pid", F.lit(f"{label}{comparator}{page}").alias("test")))
    rows = reduce(lambda a, b: a.unionByName(b), parts).collect()
    for label, comparator, page, pages in expected:
        test = f"{label}{comparator}{page}"
        assert "".join(sorted(r["pid"] for r in rows if r["test"] == test)) == pages, test


def test_page_values_need_no_array(two_schemas):
    spec = SearchSpec(("harvest",), ("crop",), filters=(("tools", "=", "$STRUCT.plots.crops$"), ("weight", "<", "$STRUCT.harvest.weight$", "OR")))
    found = search(two_schemas, bind(spec, Params(page="orchard"), two_schemas))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "collect_set" not in plan


def test_sort_direction_is_replaced_in_place(two_schemas):
    spec = SearchSpec(("harvest",), ("crop",), sorts=("^weight", "weather", "weight", "^weather", "crop"))
    names = Names(two_schemas, spec)
    assert [(c.label, asc) for c, asc in names.sorts(spec.sorts)] == [("weight", True), ("weather", False), ("crop", True)]


def test_metadata_columns(make):
    schema = make.schema("s", "a")
    make.titles(("p", "Title", "bob", 86400, "changed"), ("q", "", "eve", 0, ""))
    store = make.pages(schema, p=("x",), q=("y",), r=("z",))
    columns = ("%pageid%", "%title%", "%lastupdate%", "%lasteditor%", "%lastsummary%", "%rowid%", "a")
    rows = {row["pid"]: row for row in search(store, SearchSpec(("s",), columns)).collect()}
    assert rows["p"]["%title%"] == "Title" and rows["q"]["%title%"] == "q"
    assert rows["p"]["%lastupdate%"] == "1970-01-02 00:00:00"
    assert rows["r"]["%lasteditor%"] == "" and rows["p"]["%rowid%"] == "0"
    # a page without metadata satisfies no comparison, not even a negative one
    other = SearchSpec(("s",), ("a",), filters=(("%lasteditor%", "!=", "bob"),))
    assert pids(search(store, other)) == ["q"]
    listed = SearchSpec(("s",), ("a",), filters=(Filter("%lastsummary%", "=", ["changed", "zzz"]),))
    assert pids(search(store, listed)) == ["p"]


def test_custom_type(make):
    class Backwards(ColumnType):
        def predicate(self, relation, cell, comparator, value):
            return compare(F.reverse(cell.value), comparator, value)

        def sort_keys(self, relation, cell):
            return [F.reverse(cell.value)]

    register_type("Backwards", Backwards)
    store = make.pages(make.schema("s", ("a", "Backwards")), p=("abz",), q=("zba",))
    spec = SearchSpec(("s",), ("a",), filters=(("a", "<", "zz"),), sorts=("^a",))
    assert pids(search(store, spec)) == ["p", "q"]
    with pytest.raises(StructureError):
        register_type("Text2", str)


def test_unknown_class_reads_as_text(make):
    store: Store = make.pages(make.schema("s", ("a", "Nonsense"), ("b", "Integer")), p=("x", "5"))
    kinds = [c.type.name for c in store.schema("s").columns]
    assert kinds == ["Text", "Decimal"]
