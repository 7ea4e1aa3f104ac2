import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagegrain import Schema, SearchSpec, StructureError, search
from pagegrain.operators import upkeep, validation
from pagegrain.operators.evolution import evolve
from pagegrain.operators.revisions import records
from pagegrain.sources import csv_files, definitions, tables
from pagegrain.sources.registry import Registry


@pytest.fixture
def tools(make):
    return make.schema("tools", "name", "uses[]", "shelf", "remark")


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


# ---- CSV -------------------------------------------------------------------------------------------


def test_page_import(make, spark, tmp_path):
    boats = make.schema("boats", "name", "crew[]", "port", "remark")
    store = make.pages(boats)
    store.pages = make.frame("pid string, exists int, access_level int", ("fleet:eider", 1, 1), ("fleet:tern", 1, 1))
    store.assignments = make.frame("pid string, tbl string, assigned int", ("fleet:tern", "boats", 0))
    raw = csv_files.read_rows(spark, write(tmp_path, (
        "port,pid,remark,length,name,crew\n"
        'Husum,Fleet:Eider,"a ""quoted"" word",12,Eider," Ann ,Bo,,Cy"\n'
        "Kiel,fleet:eider,late,,Eider II,\n"
        "Kiel,fleet:gull,,9,Gull,Di\n"
        "Emden,fleet:tern\n"
        '"Emden\nharbour",fleet:tern,"",,Tern,\n'
    )), multiline=True)
    grown, bad = csv_files.import_csv(store, "boats", raw, "page", ts=80)
    found = {r["pid"]: tuple(r)[3:] for r in records(grown, "boats").collect()}
    assert found == {
        "fleet:eider": ("Eider", ["Ann", "Bo", "Cy"], "Husum", 'a "quoted" word'), "fleet:tern": ("Tern", [], "Emden\nharbour", ""),
    }
    reasons = sorted(r["errors"][0] for r in bad.collect())
    assert reasons == [
        'Page "fleet:eider" already imported', 'Page "fleet:gull" does not exist', "missing field remark, name, crew",
    ]
    assert {r["pid"]: r["assigned"] for r in grown.assignments.collect()}["fleet:eider"] == 1


def test_created_pages_exist_afterwards(make, spark, tmp_path):
    boats = make.schema("boats", "name")
    store = make.pages(boats)
    store.pages = make.frame("pid string, exists int, access_level int", ("fleet:eider", 1, 4))
    raw = csv_files.read_rows(spark, write(tmp_path, "pid,name\nfleet:gull,Gull\nfleet:eider,Eider\n"))
    created, bad = csv_files.import_csv(store, "boats", raw, "page", ts=80, create_pages=True)
    assert bad.count() == 0
    rows = search(created, SearchSpec(("boats",), ("%pageid%", "name"))).collect()
    assert sorted(r["name"] for r in rows) == ["Eider", "Gull"]
    levels = {r["pid"]: r["access_level"] for r in created.pages.collect()}
    assert levels["fleet:eider"] == 4 and set(levels) == {"fleet:eider", "fleet:gull"}


def test_files_with_headers_of_their_own(make, spark, tmp_path):
    folder = tmp_path / "in box"
    folder.mkdir()
    (folder / "a.csv").write_text("\ufeffpid,name,name\nfleet:tern,Tern,x\nfleet:gull,Gull,x\nfleet:auk\n")
    (folder / "b.csv").write_text('port,"PID",Name,line\nKiel,fleet:tern,Tern II,7\nEmden,fleet:skua,Skua,8\n')
    (folder / "c.csv").write_text("")
    (folder / "d.csv").write_text("port,pid,name\n" + "".join(f"Husum,fleet:gull,Gull {n}\n" for n in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = csv_files.read_rows(spark, str(folder))
        assert rows.columns == ["pid", "name", "port", "line"] and rows.rdd.getNumPartitions() > 8
        ordered = [tuple(r)[:3] for r in sorted(rows.collect(), key=lambda r: r["line"])]
        assert ordered[:5] == [
            ("fleet:tern", "Tern", ""), ("fleet:gull", "Gull", ""), ("fleet:auk", None, ""),
            ("fleet:tern", "Tern II", "Kiel"), ("fleet:skua", "Skua", "Emden"),
        ]
        assert ordered[5:] == [("fleet:gull", f"Gull {n}", "Husum") for n in range(300)]
        boats = make.schema("boats", "name", "port")
        store = make.pages(boats)
        store.pages = make.frame("pid string, exists int, access_level int", ("fleet:tern", 1, 1))
        grown, bad = csv_files.import_csv(store, "boats", rows, "page", ts=80, create_pages=True)
        found = search(grown, SearchSpec(("boats",), ("name", "port"))).collect()
        # the first row of a page that exists, the last of one that is made
        assert {r["pid"]: (r["name"], r["port"]) for r in found} == {
            "fleet:tern": ("Tern", ""), "fleet:skua": ("Skua", "Emden"), "fleet:gull": ("Gull 299", "Husum"),
        }
        assert sorted(r["errors"][0] for r in bad.collect()) == ['Page "fleet:tern" already imported', "missing field name"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(StructureError):
        csv_files.read_rows(spark, str(folder / "c.csv"))


def test_unchanged_rows_make_no_revision(make, spark, tools, tmp_path):
    store = make.pages(tools, p=("a", ["b"], "c", "d"), q=("a", ["b"], "c", "d"))
    raw = csv_files.read_rows(spark, write(tmp_path, "pid,name,uses,shelf,remark\np,a,b,c,d\nq,a,b,c,other\n"))
    grown, bad = csv_files.import_csv(store, "tools", raw, "page", ts=50)
    assert bad.count() == 0
    assert sorted((r["pid"], r["rev"]) for r in grown.data("tools").collect()) == [("p", 10), ("q", 10), ("q", 50)]


def test_global_and_serial_import(make, spark, tmp_path):
    schema = make.schema("s", "a", ("n", "Decimal"), ("refs[]", "Lookup", {"schema": "s", "field": "a"}))
    store = make.add(schema, [("", 4, 0, 1, None, "old", "1", [])])
    text = 'A,n,refs,pid\nx,5,"[""p"",0],[""q"",1]",page one\ny,no,,page one\n,,,\nz,7,"[""r"",0]",page one\n'
    raw = csv_files.read_rows(spark, write(tmp_path, text.replace("\n,,,\n", '\n"","","",p\n')))
    grown, bad = csv_files.import_csv(store, "s", raw, "global")
    assert {r["rid"]: (r["pid"], r["col1"]) for r in grown.data("s").collect()} == {
        4: ("", "old"), 5: ("", "x"), 6: ("", "z"),
    }
    assert sorted((r["rid"], r["row"], r["value"]) for r in grown.multi("s").collect()) == [
        (5, 1, '["p",0]'), (5, 2, '["q",1]'), (6, 1, '["r",0]'),
    ]
    assert [r["errors"] for r in bad.collect() if "decimal" in r["errors"][0]]
    serial, _ = csv_files.import_csv(store, "s", raw, "serial")
    assert {r["pid"] for r in serial.data("s").collect() if r["rid"] > 4} == {"page_one"}


def test_import_needs_columns(make, spark, tools, tmp_path):
    store = make.pages(tools)
    raw = csv_files.read_rows(spark, write(tmp_path, "name\nx\n"))
    with pytest.raises(StructureError):
        csv_files.import_columns(store, "tools", raw, "page")
    raw = csv_files.read_rows(spark, write(tmp_path, "pid,other\nx,y\n"))
    with pytest.raises(StructureError):
        csv_files.import_columns(store, "tools", raw, "page")


def test_export_and_import_again(make, spark, tools, tmp_path):
    cells = {"a": ('quo"te', ["x", "y"], "1,2", "line\nbreak"), "b": ("", [], "z", "")}
    store = make.pages(tools, **cells)
    csv_files.export_schema(store, "tools", "page", str(tmp_path / "out"))
    files = [p.read_bytes() for p in (tmp_path / "out").glob("part-*")]
    whole = b"".join(files)
    assert b'"pid","name","uses","shelf","remark"\r\n' in whole
    assert b'"a","quo""te","x,y","1,2","line\r\nbreak"\r\n' in whole
    assert b'"b","","","z",""\r\n' in whole
    empty = make.pages(tools)
    raw = csv_files.read_rows(spark, str(tmp_path / "out"), multiline=True)
    grown, bad = csv_files.import_csv(empty, "tools", raw, "page", ts=3)
    assert bad.count() == 0
    assert {r["pid"]: tuple(r)[3:] for r in records(grown, "tools").collect()} == {
        "a": cells["a"], "b": ("", [], "z", ""),
    }


def test_table_export_ignores_paging(make, tools, spark, tmp_path):
    store = make.pages(tools, a=("1", [], "", ""), b=("2", ["x", "y"], "", ""))
    spec = SearchSpec(("tools",), ("name", "uses"), sorts=("^name",), limit=1, offset=1)
    csv_files.export_table(store, spec, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted((r["name"], r["uses"] or "") for r in rows) == [("1", ""), ("2", "x, y")]


# ---- validation ------------------------------------------------------------------------------------


def test_validation_reports_all_errors(make):
    schema = make.schema("v", ("n", "Decimal", {"max": "9"}), ("d[]", "Date"), ("u", "User"), "t")
    incoming = make.frame(
        "pid string, n string, d string, u string, t string",
        ("good", "1,5", "2020-1-2, ,2020-01-03", "bob", " x "),
        ("bad", "12", "never,2020-01-01", "eve", ""),
        ("blank", "", "", None, None),
    )
    users = make.frame("login string, name string", ("bob", "Bob"))
    rows = {r["pid"]: r for r in validation.validated(incoming, schema, ["pid"], users).collect()}
    assert tuple(rows["good"])[1:] == ("1.5", ["2020-01-02", "2020-01-03"], "bob", "x", [])
    assert rows["bad"]["errors"] == [
        "n: must not be above 9", "d: not a valid date", "u: unknown user eve",
    ]
    assert tuple(rows["blank"])[1:] == ("", [""], "", "", [])
    with pytest.raises(StructureError):
        validation.validated(incoming.withColumn("zz", F.lit("")), schema, ["pid"])


def test_an_error_in_one_schema_blocks_the_page(make):
    schema = make.schema("v", ("n", "Decimal"))
    one = validation.validated(make.frame("pid string, n string", ("p", "1"), ("q", "1")), schema, ["pid"])
    two = validation.validated(make.frame("pid string, n string", ("p", "x"), ("q", "2")), schema, ["pid"])
    kept = validation.pages_without_errors({"one": one, "two": two})
    assert [r["pid"] for r in kept["one"].collect()] == [r["pid"] for r in kept["two"].collect()] == ["q"]
    good, bad = validation.split_valid(two)
    assert [r["pid"] for r in good.collect()] == ["q"] and [r["pid"] for r in bad.collect()] == ["p"]


# ---- schemas ---------------------------------------------------------------------------------------


def test_evolution():
    first = evolve(None, "Tool List 2", {}, [
        {"label": " grip", "class": "Text", "isenabled": True, "ismulti": False, "sort": 10},
        {"label": "grip", "class": "Text", "isenabled": True, "sort": 5},
        {"label": "hidden", "class": "Text", "isenabled": False},
        {"label": " ", "class": "Text", "isenabled": True},
    ], ts=10)
    assert first.schema.name == "toollist2" and first.added == [1, 2]
    assert [(c.colref, c.label) for c in first.schema.columns] == [(2, "grip1"), (1, "grip")]
    second = evolve(first.schema, "toollist2", {
        1: {"label": "renamed", "class": "Decimal", "isenabled": True, "ismulti": True, "sort": 1},
    }, [{"label": "added", "class": "Tag", "isenabled": True, "sort": 9}], ts=20)
    assert second.added == [3] and second.to_lists == [1]
    by_ref = {c.colref: c for c in second.schema.columns}
    assert by_ref[1].type.name == "Decimal" and by_ref[1].multi and by_ref[1].label == "renamed"
    assert not by_ref[2].enabled and by_ref[3].label == "added"
    assert second.schema.find("RENAMED").colref == 1 and second.schema.find("grip1") is None


def test_data_follows_evolution(make):
    store = make.pages(make.schema("s", "a"), p=("x",))
    grown = evolve(store.schema("s"), "s", {
        1: {"label": "a", "class": "Text", "isenabled": True, "ismulti": True},
    }, [{"label": "b", "class": "Text", "isenabled": True}], ts=9)
    multi = upkeep.single_to_multi(store, "s", grown.to_lists)
    store.add(grown.schema, upkeep.added_columns(store.data("s"), grown.schema), multi)
    row = search(store, SearchSpec(("s",), ("a", "b"))).first()
    assert (row["a"], row["b"]) == (["x"], "")


def test_json_documents(make):
    schema = make.schema("s", ("a", "Decimal", {"min": "3"}), "b[]", ts=5)
    text = definitions.to_json(schema)
    document = json.loads(text)
    assert document["schema"] == "s" and document["columns"][1]["ismulti"] is True
    copy = definitions.from_json(text, ts=7, name="copy")
    assert [(c.label, c.type.name, c.multi) for c in copy.schema.columns] == [
        ("a", "Decimal", False), ("b", "Text", True),
    ]
    assert copy.schema.columns[0].type.config["min"] == "3" and copy.added == [1, 2]
    document["columns"].append({"label": "c", "class": "Text", "isenabled": True, "sort": 99})
    update = definitions.from_json(json.dumps(document), ts=8, old=schema)
    assert update.added == [3] and len(update.schema.columns) == 3
    with pytest.raises(StructureError):
        definitions.from_json("{", ts=1)


def test_registry_versions(make, spark, tmp_path):
    registry = Registry.empty(spark)
    schema = make.schema("s", "a", ("b", "Decimal"), ts=100)
    registry, saved = registry.with_version(schema)
    later = Schema("s", (*[replace(c, enabled=False) for c in schema.columns], make.schema("x", "new").columns[0]), 200)
    registry, _ = registry.with_version(replace(later, columns=tuple(replace(c, colref=n) for n, c in enumerate(later.columns, 1))))
    registry.write(str(tmp_path / "registry"))
    registry = Registry.read(spark, str(tmp_path / "registry"))
    assert [c.label for c in registry.load("S", 150).enabled] == ["a", "b"]
    assert [c.label for c in registry.load("s", 250).enabled] == ["new"]
    assert [c.label for c in registry.load("s").enabled] == ["new"]
    assert [c.label for c in registry.load("s", 50).enabled] == ["new"]  # before the first: newest
    assert registry.load("s", 150).columns[1].type.name == "Decimal" and saved.id == 1
    with pytest.raises(StructureError):
        registry.load("other")


# ---- stores on disk --------------------------------------------------------------------------------


def test_store_round_trip_reads_only_latest(make, spark, tools, tmp_path):
    store = make.add(tools, [
        ("p", 0, 1, 0, None, "old", ["x"], "", ""),
        ("p", 0, 2, 1, None, "new", ["y"], "", ""),
    ])
    make.titles(("p", "P", "", 1, ""))
    tables.write_store(store, str(tmp_path / "store"))
    again = tables.read_store(spark, str(tmp_path / "store"), [tools], ("titles",))
    found = search(again, SearchSpec(("tools",), ("%title%", "name", "uses")))
    assert [tuple(r)[3:] for r in found.collect()] == [("P", "new", ["y"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "latest" in plan.split("PartitionFilters")[1]


def test_bucketed_tables_join_without_a_shuffle(make, spark, tools):
    store = make.pages(tools, p=("a", ["x"], "", ""), q=("b", [], "", ""))
    make.titles(("p", "P", "bob", 1, ""))
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    tables.save_bucketed(store, "bucketed", 4)
    again = tables.open_tables(spark, "bucketed", [tools], ("titles",))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search(again, SearchSpec(("tools",), ("%lasteditor%", "name")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert sorted(tuple(r)[3:] for r in found.collect()) == [("", "b"), ("bob", "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_with_dots_and_signs(make, spark, tmp_path):
    from pagegrain import Search
    from pagegrain.operators import aggregate, nested
    from pagegrain.operators.revisions import revision_changes, save_revisions
    from pagegrain.operators.rows import save_rows

    schema = make.schema("stock_7", "kind_of", "made by[]", "share%sold", ("last.seen?", "User"))
    store = make.pages(schema, p=("a", ["b", "c"], "d", "e"), q=("a", [], "x", "bob"))
    everything = SearchSpec(("stock_7",), ("*",), sorts=("stock_7.last.seen?",))
    assert [tuple(r)[3:] for r in search(store, everything).collect()] == [
        ("a", [], "x", "bob"), ("a", ["b", "c"], "d", "e"),
    ]
    # without its schema such a label reads as a qualified one
    assert Search(store, SearchSpec(("stock_7",), ("kind_of", "last.seen?"))).output_names == ["kind_of"]
    tree = nested.nested(store, SearchSpec(("stock_7",), ("kind_of", "stock_7.last.seen?")), levels=1)
    assert [tuple(r) for r in tree.collect()] == [(["a"], 1, "bob"), (["a"], 1, "e")]
    numbers = aggregate.with_row_numbers(store, everything).orderBy("row_number").collect()
    assert [tuple(r)[4:] for r in numbers][0] == ("a", [], "x", "bob")
    assert aggregate.facets(store, everything).filter("`column` = 'last.seen?'").count() == 2

    users = make.frame("login string, name string", ("bob", "Bob"))
    path = write(tmp_path, "pid,last.seen?,made by\np,bob,\"k,l\"\nq,eve,m\n")
    store.users = users
    grown, bad = csv_files.import_csv(store, "stock_7", csv_files.read_rows(spark, path), "page", ts=20)
    assert [r["errors"] for r in bad.collect()] == [["last.seen?: unknown user eve"]]
    found = records(grown, "stock_7").filter("pid = 'p'").first()
    assert found["last.seen?"] == "bob" and found["made by"] == ["k", "l"]
    assert "last.seen?" in {r["label"] for r in revision_changes(grown, "stock_7").collect()}

    fresh = search(store, everything).drop("rev").withColumn("rid", F.lit(0)).withColumn("line", F.length("pid"))
    data, _ = save_rows(store, "stock_7", fresh.withColumn("pid", F.lit("")).filter("`last.seen?` = 'bob'"))
    assert data.filter("pid = ''").first()["col4"] == "bob"
    again = search(store, everything).drop("rid").withColumn("rev", F.lit(50))
    data, _ = save_revisions(store, "stock_7", again)
    assert data.filter("latest = 1").count() == 2
    assert Search(store, everything).count().first()[0] == 2
