import random

import pytest
from pyspark.sql import functions as F

from pagegrain import SearchSpec, Search, StructureError, search
from pagegrain.operators import revisions, rows


@pytest.fixture
def pages(make):
    schema = make.schema("testtable", "testcolumn", "testMulitColumn[]")
    return make.add(
        schema,
        [
            ("testpage", 0, 123, 0, None, "value1", ["value2.1", "value2.2"]),
            ("testpage", 0, 789, 1, None, "value1a", ["value2.1a", "value2.2a"]),
            ("testpage2", 0, 789, 1, None, "value1a", ["value2.1a"]),
        ],
    )


def latest(data):
    return {(r["pid"], r["rev"]): r["latest"] for r in data.collect()}


def test_as_of(pages):
    def read(ts):
        found = revisions.records(pages, "testtable", ts).collect()
        return {r["pid"]: (r["testcolumn"], r["testMulitColumn"]) for r in found}

    assert read(200) == {"testpage": ("value1", ["value2.1", "value2.2"])}
    assert read(None)["testpage"] == ("value1a", ["value2.1a", "value2.2a"])
    assert read(100) == {}


def test_as_of_for_given_pages(pages, make):
    wanted = make.frame("pid string", ("testpage",), ("nowhere",))
    found = revisions.records(pages, "testtable", 200, wanted).collect()
    assert {r["pid"]: (r["testcolumn"], r["testMulitColumn"]) for r in found} == {
        "testpage": ("value1", ["value2.1", "value2.2"]),
        "nowhere": ("", []),
    }


def test_as_of_the_newest_is_the_latest(make):
    pick = random.Random(5)
    keys = {(f"p{pick.randint(0, 9)}", pick.randint(1, 400)) for _ in range(300)}
    records = [(pid, 0, rev, 0, None, str(rev)) for pid, rev in keys]
    store = make.add(make.schema("s", "a"), records)
    flagged = revisions.with_latest(store.data("s"))
    newest = {(r["pid"], r["rev"]) for r in flagged.filter("latest = 1").collect()}
    as_of = {(r["pid"], r["rev"]) for r in revisions.as_of(store.data("s"), 400).collect()}
    assert newest == as_of == {(p, max(r for q, r in keys if q == p)) for p, _ in keys}


def test_save(pages, make):
    incoming = make.frame(
        "pid string, rev bigint, testcolumn string, testMulitColumn array<string>",
        ("testpage", 900, "new", ["a", "b"]),
        ("testpage", 500, "late", ["c"]),
        ("fresh", 10, "first", []),
        ("testpage2", 789, "again", ["x"]),
    )
    data, multi = revisions.save_revisions(pages, "testtable", incoming)
    assert latest(data) == {
        ("testpage", 123): 0, ("testpage", 789): 0, ("testpage", 500): 0, ("testpage", 900): 1,
        ("testpage2", 789): 1, ("fresh", 10): 1,
    }
    values = {(r["pid"], r["rev"], r["row"]): (r["value"], r["latest"]) for r in multi.collect()}
    assert values[("testpage", 900, 1)] == ("a", 1) and values[("testpage", 900, 2)] == ("b", 1)
    assert values[("testpage", 500, 1)] == ("c", 0) and values[("testpage", 789, 1)] == ("value2.1a", 0)
    assert values[("testpage2", 789, 1)] == ("value2.1a", 1)
    stored = {(r["pid"], r["rev"]): r["col2"] for r in data.collect()}
    assert stored[("testpage", 900)] == "a" and stored[("fresh", 10)] is None

    pages.data_tables["testtable"], pages.multi_tables["testtable"] = data, multi
    again, values = revisions.save_revisions(pages, "testtable", incoming)
    assert latest(again) == latest(data) and values.count() == multi.count()


def test_save_refuses(pages, make):
    with pytest.raises(StructureError):
        revisions.save_revisions(pages, "testtable", make.frame("pid string, rev bigint, x string", ("p", 1, "")))
    bad = make.frame("pid string, rev bigint, testcolumn string", ("p", 0, "x"))
    with pytest.raises(Exception, match="revision time"):
        revisions.save_revisions(pages, "testtable", bad)[0].collect()


def test_clear_and_revert(pages, make):
    data, multi = revisions.clear_pages(pages, "testtable", make.frame("pid string, rev bigint", ("testpage", 800)))
    pages.data_tables["testtable"], pages.multi_tables["testtable"] = data, multi
    spec = SearchSpec(("testtable",), ("testcolumn", "testMulitColumn"))
    assert [r["pid"] for r in search(pages, spec).collect()] == ["testpage2"]
    targets = make.frame("pid string, at bigint, rev bigint", ("testpage", 130, 900))
    data, multi = revisions.revert_pages(pages, "testtable", targets)
    pages.data_tables["testtable"], pages.multi_tables["testtable"] = data, multi
    row = search(pages, spec).filter("pid = 'testpage'").first()
    assert (row["rev"], row["testcolumn"], row["testMulitColumn"]) == (900, "value1", ["value2.1", "value2.2"])


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_changes_do_not_depend_on_partitions(make, spark, partitions):
    pick = random.Random(11)
    records = []
    for page in ("hot", "cold", "warm"):
        revs = sorted(pick.sample(range(1, 400), 90 if page == "hot" else 3))
        records += [(page, 0, rev, 0, None, pick.choice("ab"), [pick.choice("xyz")]) for rev in revs]
    store = make.add(make.schema("s", "a", "l[]"), records)
    expected = set()
    for before, after in zip(records, records[1:]):
        if before[0] != after[0]:
            continue
        pairs = (("a", before[5], after[5]), ("l", before[6][0], after[6][0]))
        expected |= {(after[0], after[2], before[2], *p) for p in pairs if p[1] != p[2]}
    kept = {name: spark.conf.get(name) for name in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
    )}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {tuple(r) for r in revisions.revision_changes(store, "s").collect()}
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert found == expected


def test_record_text(pages):
    rows_ = pages.data("testtable").filter("pid = 'testpage' and latest = 1")
    text = revisions.record_text(pages, "testtable", rows_).first()["text"]
    assert text == (
        "testtable.testcolumn : value1a\n" "testtable.testMulitColumn : value2.1a, value2.2a\n"
    )


def test_page_data(pages, make):
    wanted = make.frame("pid string", ("testpage",), ("nowhere",))
    found = {
        (r["pid"], r["schema"], r["label"]): r["values"]
        for r in revisions.page_data(pages, wanted, 200).collect()
    }
    assert found[("testpage", "testtable", "testcolumn")] == ["value1"]
    assert found[("nowhere", "testtable", "testMulitColumn")] == []
    assert revisions.page_data(pages, wanted, 200, skip_empty=True).count() == 2


def test_rows_by_id(make):
    store = make.add(
        make.schema("s", "a", "b[]"),
        [("", 1, 0, 1, None, "x", ["y"]), ("", 2, 0, 1, None, "z", []), ("p", 3, 0, 1, None, "w", [])],
    )
    assert revisions.rows_by_id(store, "s", 1).first()["b"] == ["y"]
    assert revisions.rows_by_id(store, "s").count() == 2
    assert [r["a"] for r in revisions.rows_by_id(store, "s", pid="p").collect()] == ["w"]


def test_save_rows(make):
    store = make.add(
        make.schema("s", "a", "b[]", "c[]"),
        [("", 1, 0, 1, None, "one", ["x", "y"], ["k"]), ("", 5, 0, 1, None, "five", ["z"], [])],
    )
    incoming = make.frame(
        "pid string, rid bigint, line bigint, a string, b array<string>",
        ("", 0, 10, "new1", ["n"]),
        ("", 0, 11, "", []),
        ("", 0, 12, "new2", []),
        ("", 1, 13, "early", ["w"]),
        ("", 1, 14, "changed", [""]),
    )
    data, multi = rows.save_rows(store, "s", incoming)
    assert {r["rid"]: r["col1"] for r in data.collect()} == {1: "changed", 5: "five", 6: "new1", 7: "new2"}
    values = sorted((r["rid"], r["colref"], r["row"], r["value"]) for r in multi.collect())
    assert values == [(1, 3, 1, "k"), (5, 2, 1, "z"), (6, 2, 1, "n")]
    store.data_tables["s"], store.multi_tables["s"] = data, multi
    data, multi = rows.delete_rows(store, "s", make.frame("rid bigint", (1,)))
    assert sorted(r["rid"] for r in data.collect()) == [5, 6, 7]
    assert 1 not in {r["rid"] for r in multi.collect()}


def test_folding_then_exploding_gives_the_distinct_values(make):
    pick = random.Random(3)
    records = [(f"p{n}", 0, 1, 1, None, [pick.choice("abcdef") for _ in range(pick.randint(0, 9))]) for n in range(40)]
    store = make.add(make.schema("s", "l[]"), records)
    found = Search(store, SearchSpec(("s",), ("l", "%pageid%")))
    listed = found.cells.select("pid", F.explode("c0_raw").alias("v"))
    spread = found.exploded(0).select("pid", "c0_raw")
    expected = sorted({(r[0], v) for r in records for v in r[5]})
    assert sorted(map(tuple, listed.collect())) == expected
    assert sorted(map(tuple, spread.collect())) == expected
