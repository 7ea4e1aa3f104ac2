from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagegrain import SearchSpec, search
from pagegrain.operators import aggregate, nested, suggest
from pagegrain.operators.numbering import Key, numbered

# kind, family, plant and its flower colours
PLANTS = [
    ("tree", "beech", "oak", []),
    ("herb", "mint", "sage", ["violet", "white"]),
    ("tree", "rose", "plum", ["white"]),
    ("herb", "mint", "thyme", ["violet"]),
    ("herb", "rose", "avens", ["yellow"]),
    ("tree", "", "mystery", ["white", "yellow"]),
    ("herb", "daisy", "arnica", ["yellow"]),
    ("tree", "rose", "plum", ["white"]),
]


@pytest.fixture
def things(make):
    schema = make.schema("things", "colors[]", "type", "family", "plant")
    rows = [(f"p{n}", 0, 1, 1, None, colours, kind, family, plant) for n, (kind, family, plant, colours) in enumerate(PLANTS)]
    return make.add(schema, rows)


def leaves(df):
    return [(tuple(r["path"]), *[r[c] for c in df.columns[2:]]) for r in df.collect()]


def test_tree(things):
    df = nested.nested(things, SearchSpec(("things",), ("type", "family", "plant")), levels=2)
    assert leaves(df) == [
        (("herb", "daisy"), "arnica"), (("herb", "mint"), "sage"), (("herb", "mint"), "thyme"), (("herb", "rose"), "avens"),
        (("tree", "beech"), "oak"), (("tree", "rose"), "plum"), (("tree", ""), "mystery"),
    ]
    counts = {tuple(r["path"]): r["leaf_rows"] for r in nested.nodes(df).collect()}
    assert counts == {
        ("herb",): 4, ("tree",): 3, ("herb", "daisy"): 1, ("herb", "mint"): 2, ("herb", "rose"): 1,
        ("tree", "beech"): 1, ("tree", "rose"): 1, ("tree", ""): 1,
    }


def test_tree_over_lists(things):
    df = nested.nested(things, SearchSpec(("things",), ("colors", "type", "plant")), levels=1)
    below = {}
    for path, _, plant in leaves(df):
        below.setdefault(path[0], []).append(plant)
    assert below == {"violet": ["sage", "thyme"], "white": ["sage", "mystery", "plum"], "yellow": ["arnica", "avens", "mystery"], "": ["oak"]}


def test_tree_in_search_order(things):
    spec = SearchSpec(("things",), ("type", "family", "plant"), sorts=("^plant",))
    df = nested.nested(things, spec, levels=2, keep_order=True)
    paths = list(dict.fromkeys(path for path, *_ in leaves(df)))
    assert paths == [("herb", "mint"), ("herb", "rose"), ("herb", "daisy"), ("tree", "rose"), ("tree", "beech"), ("tree", "")]


def test_siblings_follow_the_compare_value(make):
    schema = make.schema("visits", ("place", "Page", {"usetitles": True}), "day")
    make.titles(("a:1", "Zoo", "", 1, ""), ("b:2", "Alps", "", 1, ""))
    store = make.pages(schema, x=("b:2", "one"), y=("a:1", "two"), z=("c:3", "three"))
    df = nested.nested(store, SearchSpec(("visits",), ("place", "day")), levels=1)
    assert leaves(df) == [(("Zoo",), "two"), (("Alps",), "one"), (("c:3",), "three")]


def test_index(things):
    df = nested.nested(things, SearchSpec(("things",), ("family", "plant")), levels=1, index=1)
    assert [path for path, _ in leaves(df)] == [
        ("B", "beech"), ("D", "daisy"), ("M", "mint"), ("M", "mint"), ("R", "rose"), ("R", "rose"), ("", ""),
    ]
    flat = nested.nested(things, SearchSpec(("things",), ("plant", "type")), levels=0, index=3)
    assert (("SAG",), "sage", "herb") in leaves(flat) and len(leaves(flat)) == 7


def test_facets(things):
    df = aggregate.facets(things, SearchSpec(("things",), ("colors", "type", "family")))
    found = {}
    for row in df.collect():
        found.setdefault(row["column"], set()).add(row["display"])
    assert found == {
        "colors": {"violet", "white", "yellow"}, "type": {"tree", "herb"}, "family": {"beech", "mint", "rose", "daisy"},
    }


def test_facets_are_the_values_of_the_result(make):
    """Joined schemas, blank cells, equal values and pages of the result: nothing more, nothing less than the rows show."""
    make.pages(make.schema("a", "one", "many[]"), p=("x", ["1", "2", "1"]), q=("", ["3", " "]), r=("y", []), s=("", []))
    store = make.pages(make.schema("b", "two", "more[]"), p=("u", ["1", "4"]), q=("v", []), r=(None, ["5"]), s=("w", ["6"]))
    for schemas, columns in ((("a",), ("one", "many")), (("a", "b"), ("one", "many", "two", "more")), (("a", "b"), ("more",))):
        for paging in ({}, {"limit": 2, "sorts": ("%pageid%",)}, {"offset": 1, "sorts": ("^%pageid%",)}):
            spec = SearchSpec(schemas, columns, **paging)
            rows = search(store, spec).collect()
            cells = [(c, v) for row in rows for c in columns for v in (row[c] if isinstance(row[c], list) else [row[c]])]
            found = sorted((r["column"], r["value"]) for r in aggregate.facets(store, spec).collect())
            assert found == sorted({(c, v) for c, v in cells if v}), (schemas, paging)


def test_facets_find_the_rows_once(things):
    plan = aggregate.facets(things, SearchSpec(("things",), ("colors", "type", "family")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2, "one for the rows, one for all their values"


def test_cloud(things):
    spec = SearchSpec(("things",), ("colors",), filters=(("type", "=", "tree"),))
    counts = {r["tag"]: r["count"] for r in aggregate.cloud(things, spec).collect()}
    assert {tag: n for tag, n in counts.items() if tag} == {"white": 3, "yellow": 1}
    families = aggregate.cloud(things, SearchSpec(("things",), ("family",)), minimum=2, limit=2)
    rows = {r["tag"]: (r["count"], r["weight"]) for r in families.collect()}
    assert {tag: n for tag, (n, _) in rows.items()} == {"rose": 3, "mint": 2}
    assert rows["rose"][1] > rows["mint"][1]


def test_sums(make):
    schema = make.schema("s", ("n", "Decimal"), "t", "l[]")
    store = make.pages(schema, a=("1.5", "x", ["5"]), b=("2", "3", ["6"]), c=("", "", ["7"]), d=("-9", "", []))
    row = aggregate.sums(store, SearchSpec(("s",), ("n", "t", "l"), filters=(("n", ">", "0"),))).first()
    assert (row["n"], row["t"], row["l"]) == (3.5, 3.0, None)
    page = SearchSpec(("s",), ("n",), sorts=("^n",), limit=1)
    assert aggregate.sums(store, page).first()["n"] == 2.0


def test_single_value(things):
    spec = SearchSpec(("things",), ("colors", "family", "plant"), sorts=("^plant",))
    rows = aggregate.single_value(things, spec).orderBy("position").collect()
    assert [(r["column"], r["values"]) for r in rows] == [("colors", ["violet"]), ("family", ["mint"]), ("plant", ["thyme"])]


def test_row_numbers(things):
    spec = SearchSpec(("things",), ("plant",), sorts=("plant",))
    whole = aggregate.with_row_numbers(things, spec).orderBy("row_number").collect()
    assert [(r["row_number"], r["plant"]) for r in whole] == list(enumerate(sorted(p for _, _, p, _ in PLANTS), 1))
    page = aggregate.with_row_numbers(things, replace(spec, limit=3, offset=4)).collect()
    assert [(r["row_number"], r["plant"]) for r in page] == [(n, whole[n - 1]["plant"]) for n in (5, 6, 7)]


def test_numbering_is_exact_under_ties_and_skew(spark):
    df = spark.range(0, 10_000, numPartitions=7).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    out = numbered(df, [Key("k", False), Key("id")], "n").collect()
    ranked = sorted(out, key=lambda r: (-r["k"], r["id"]))
    assert [r["n"] for r in ranked] == list(range(1, 10_001))


def test_shown_table(make):
    schema = make.schema(
        "s",
        ("n", "Decimal", {"thousands": " ", "postfix": " EUR"}),
        ("d", "Date", {"format": "dd.MM.yyyy"}),
        ("l[]", "Text", {"prefix": "#"}),
    )
    store = make.pages(schema, a=("1234.50", "2020-02-01", ["x", "y"]), b=("", "", ["z"]))
    rows = {r["pid"]: (r["n"], r["d"], r["l"]) for r in aggregate.text_rows(store, SearchSpec(("s",), ("*",))).collect()}
    assert rows == {"a": ("1 234.5 EUR", "01.02.2020", "#x, #y"), "b": ("", "", "#z")}


def test_suggestions(make):
    store = make.pages(
        make.schema("tag", ("tag", "Tag"), ("tags[]", "Tag")),
        p1=("Aragorn", ["Faramir", "Gollum"]), p2=("Arwen", ["Gandalf", "Aragorn"]), p3=("Gandalf", []),
    )

    def found(label, text, **options):
        return [r["value"] for r in suggest.value_suggestions(store, "tag", label, text, **options).collect()]

    assert found("tag", "ar") == ["Aragorn", "Arwen"]
    assert found("tags", "ar") == ["Aragorn", "Faramir"]
    assert found("tag", "a") == [] and found("tag", "ar", maximum=0) == []
    store.pages = make.frame("pid string, exists int, access_level int", ("p2", 1, 1))
    assert found("tag", "ar") == ["Arwen"]


def test_reference_options(make):
    target = make.schema("t", "name")
    make.add(target, [("", 1, 0, 1, None, "beta"), ("", 2, 0, 1, None, "Alpha")])
    store = make.pages(make.schema("s", ("r", "Lookup", {"schema": "t", "field": "name"})))
    rows = suggest.reference_options(store, "s", "r").collect()
    assert [tuple(r) for r in rows] == [("", ""), ('["",2]', "Alpha"), ('["",1]', "beta")]


def test_page_suggestions(make):
    make.titles(("wiki:syntax", "Syntax Help", "", 1, ""), ("wiki:start", "", "", 1, ""))
    store = make.store
    store.pages = make.frame(
        "pid string, exists int, access_level int",
        ("wiki:syntax", 1, 1), ("wiki:start", 1, 1), ("synthesis", 1, 1), ("wiki:synod", 1, 0),
    )

    def found(text, **options):
        return [tuple(r) for r in suggest.page_suggestions(store, text, **options).collect()]

    assert found("syn") == [("synthesis", "synthesis"), ("syntax (wiki)", "wiki:syntax")]
    assert found("help", usetitles=True) == [("Syntax Help (wiki:syntax)", "wiki:syntax")]
    assert found("s", minimum=1, pattern=":wiki:", maximum=1) == [("start (wiki)", "wiki:start")]
