import pytest

from pagegrain.operators import upkeep


@pytest.fixture
def herbarium(make):
    """Sheets that point to places, to other sheets and to pictures."""
    schema = make.schema(
        "sheets",
        "remark",
        ("site", "Page"),
        ("trails[]", "Page"),
        ("parent", "Lookup", {"schema": "sheets", "field": "remark"}),
        ("kin[]", "Lookup", {"schema": "sheets", "field": "remark"}),
        ("photo", "Media"),
        ("scans[]", "Media"),
        ("garden", "Page", {"usetitles": True}),
    )
    fern = ("see hill:top", "hill:top", ["hill:top#east", "lake"], "", [], "img:fern.jpg", ["img:a.png", "img:fern.jpg"], "lake")
    moss = ("", "lake#north", [], '["sheet:fern",0]', ['["sheet:fern",0]', '["sheet:moss",0]', '["",12]'], "", [], "hill:top")
    before = ("", "hill:top", ["hill:top"], '["sheet:fern",0]', [], "", [], "")
    make.titles(("sheet:fern", "Fern", "", 1, ""), ("lake", "The lake", "", 1, ""))
    return make.add(
        schema,
        [("sheet:fern", 0, 70, 1, None, *fern), ("sheet:moss", 0, 70, 1, None, *moss), ("sheet:moss", 0, 60, 0, None, *before)],
    )


def cells(store, rev=70):
    data = {r["pid"]: r.asDict() for r in store.data("sheets").filter(f"rev = {rev}").collect()}
    for row in store.multi("sheets").filter(f"rev = {rev}").orderBy("row").collect():
        data[row["pid"]].setdefault(row["colref"], []).append(row["value"])
    return data


def test_renamed_record_takes_its_references_along(herbarium, make):
    herbarium.assignments = make.frame("pid string, tbl string, assigned int", ("sheet:fern", "sheets", 0))
    renames = make.frame("old string, new string", ("sheet:fern", "archive:fern"))
    data = cells(moved := upkeep.rename_pages(herbarium, renames, [("archive:*", "sheets")]))
    assert sorted(data) == ["archive:fern", "sheet:moss"]
    assert data["sheet:moss"]["col4"] == '["archive:fern",0]'
    assert data["sheet:moss"][5] == ['["archive:fern",0]', '["sheet:moss",0]', '["",12]']
    assert {r["pid"] for r in moved.titles.collect()} == {"archive:fern", "lake"}
    assert [tuple(r) for r in moved.assignments.collect()] == [("archive:fern", "sheets", 1)]


def test_renamed_place_keeps_fragments_and_history(herbarium, make):
    moved = upkeep.rename_pages(herbarium, make.frame("old string, new string", ("hill:top", "peak"), ("lake", "pond")))
    now, then = cells(moved), cells(moved, rev=60)
    assert (now["sheet:fern"]["col2"], now["sheet:fern"][3]) == ("peak", ["peak#east", "pond"])
    assert (now["sheet:moss"]["col2"], now["sheet:moss"]["col8"]) == ("pond#north", "peak")
    assert now["sheet:fern"]["col1"] == "see hill:top"  # plain text is no link
    assert (then["sheet:moss"]["col2"], then["sheet:moss"][3]) == ("hill:top", ["hill:top"])


def test_renamed_media(herbarium, make):
    renames = make.frame("old string, new string", ("img:fern.jpg", "img:bracken.jpg"), ("lake", "no:medium"))
    data, multi = upkeep.renamed_values(herbarium, "sheets", renames, media=True)
    herbarium.data_tables["sheets"], herbarium.multi_tables["sheets"] = data, multi
    found = cells(herbarium)["sheet:fern"]
    assert (found["col6"], found[7], found["col8"]) == ("img:bracken.jpg", ["img:a.png", "img:bracken.jpg"], "lake")


def test_legacy_references(evaluate):
    cases = {
        "": "", "wiki:page": '["wiki:page",0]', "17": '["",17]', '["",17]': '["",17]',
        '["",wiki:page]': '["wiki:page",0]', '["wiki",0]': '["wiki",0]',
    }
    once = evaluate(upkeep.upgraded_reference, *cases)
    assert once == list(cases.values())
    assert evaluate(upkeep.upgraded_reference, *once) == once


def test_single_to_multi(make):
    store = make.add(
        make.schema("s", "a", "b"),
        [("p", 0, 1, 0, None, "old", "x"), ("p", 0, 2, 1, None, "new", " "), ("", 3, 0, 1, None, "global", "y")],
    )
    rows = upkeep.single_to_multi(store, "s", [1, 2]).collect()
    assert sorted((r["colref"], r["pid"], r["rid"], r["rev"], r["latest"], r["row"], r["value"]) for r in rows) == [
        (1, "", 3, 0, 1, 1, "global"), (1, "p", 0, 2, 1, 1, "new"), (2, "", 3, 0, 1, 1, "y"),
    ]


def test_page_metadata(make):
    make.titles(("a", "A", "bob", 5, "s"), ("b", "B", "bob", 7, "s"))
    changes = make.frame(
        "pid string, title string, date bigint, user string, ip string, summary string",
        ("a", "ignored", 5, "eve", "", "x"),
        ("b", "", 9, "", "10.0.0.1", "second"),
        ("b", "no", 8, "eve", "", "first"),
        ("ns:c", None, None, None, None, None),
    )
    rows = {r["pid"]: tuple(r)[1:] for r in upkeep.update_titles(make.store.titles, changes).collect()}
    assert rows == {
        "a": ("A", "bob", 5, "s"), "b": ("b", "10.0.0.1", 9, "second"), "ns:c": ("c", "", 0, ""),
    }


def test_colliding_renames_are_refused(herbarium, make):
    for pairs in ([("lake", "a"), ("lake", "b")], [("lake", "x"), ("sheet:moss", "x")], [("lake", "sheet:moss")]):
        moved = upkeep.rename_pages(herbarium, make.frame("old string, new string", *pairs))
        with pytest.raises(Exception, match="twice|taken"):
            moved.data("sheets").collect()
    swapped = upkeep.rename_pages(
        herbarium, make.frame("old string, new string", ("sheet:fern", "sheet:moss"), ("sheet:moss", "sheet:fern"))
    )
    assert cells(swapped)["sheet:moss"]["col1"] == "see hill:top"
