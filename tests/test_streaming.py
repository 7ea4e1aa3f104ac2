import json

from pagegrain.operators import revisions
from pagegrain.streaming.ingest import compact, last_batch, latest_pages, read_log, start_ingest, start_latest

FIELDS = "pid string, rev bigint, a string, n string, l array<string>"


def feed(folder, name, *rows):
    names = ("pid", "rev", "a", "n", "l")
    text = "\n".join(json.dumps(dict(zip(names, row))) for row in rows)
    (folder / name).write_text(text + "\n")


def test_ingest(make, spark, tmp_path):
    schema = make.schema("s", "a", ("n", "Decimal"), "l[]")
    store = make.add(schema, [("p", 0, 5, 1, None, "stored", "1", ["x"])])
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    log = str(tmp_path / "log")

    def run():
        stream = spark.readStream.schema(FIELDS).json(str(inbox))
        start_ingest(stream, schema, log, str(tmp_path / "progress")).awaitTermination()

    feed(inbox, "1.json", ("p", 9, " new ", "2,5", ["y", ""]), ("q", 3, "q3", "1", []), ("q", 4, "bad", "x", []))
    run()
    feed(inbox, "2.json", ("p", 7, "late", "1", ["z"]), ("p", 9, "repeated", "9", []), ("r", 0, "no time", "1", []))
    run()

    accepted = {(r["pid"], r["rev"]): (r["a"], r["n"], r["l"]) for r in read_log(spark, log).collect()}
    assert accepted == {
        ("p", 9): ("new", "2.5", ["y"]), ("p", 7): ("late", "1", ["z"]), ("q", 3): ("q3", "1", [""]),
    }
    rejected = spark.read.parquet(f"{log}/rejected").collect()
    assert {(r["pid"], tuple(r["errors"])) for r in rejected} == {
        ("q", ("n: a decimal number is needed",)), ("r", ()),
    }
    data, multi = compact(store, "s", log)
    flags = {(r["pid"], r["rev"]): r["latest"] for r in data.collect()}
    assert flags == {("p", 5): 0, ("p", 7): 0, ("p", 9): 1, ("q", 3): 1}
    assert {(r["rev"], r["value"], r["latest"]) for r in multi.filter("pid = 'p'").collect()} == {
        (5, "x", 0), (7, "z", 0), (9, "y", 1),
    }
    store.data_tables["s"], store.multi_tables["s"] = data, multi
    again, _ = compact(store, "s", log)
    assert again.count() == data.count()
    assert {r["pid"]: r["a"] for r in revisions.records(store, "s").collect()} == {"p": "new", "q": "q3"}


def test_latest_state_over_restarts(make, spark, tmp_path):
    schema = make.schema("s", "a", ("n", "Decimal"), "l[]")
    inbox, log, state = tmp_path / "inbox", str(tmp_path / "log"), str(tmp_path / "state")
    inbox.mkdir()

    def run():
        stream = spark.readStream.schema(FIELDS).json(str(inbox))
        start_ingest(stream, schema, log, str(tmp_path / "progress")).awaitTermination()
        start_latest(spark, schema, log, state, str(tmp_path / "state-progress")).awaitTermination()
        return {r["pid"]: (r["rev"], r["a"], r["n"], r["l"]) for r in latest_pages(spark, state).collect()}

    feed(inbox, "1.json", ("p", 9, "nine", "2", ["y", "z"]), ("q", 3, "b", "1", []), ("q", 3, "a", "1", []))
    first = {"p": (9, "nine", "2", ["y", "z"]), "q": (3, "a", "1", [""])}
    assert run() == first
    feed(inbox, "2.json", ("p", 7, "late", "1", ["z"]), ("p", 9, "repeated", "9", []), ("q", 8, "faulty", "x", []))
    assert run() == first
    feed(inbox, "3.json", *[("q", n, f"q{n}", "1", []) for n in range(4, 90)], ("r", 1, "", "", []))
    second = {"p": first["p"], "q": (89, "q89", "1", [""]), "r": (1, "", "", [""])}
    assert run() == second
    # nothing new
    assert run() == second
    changed = spark.read.parquet(state).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in changed)[-1] <= 2
    base, newest = latest_pages(spark, state).filter("pid <> 'q'"), last_batch(spark, state)
    assert {r["pid"] for r in latest_pages(spark, state, base, newest).collect()} == {"p", "r"}
    assert {r["pid"] for r in latest_pages(spark, state, base, newest - 1).collect()} == {"p", "q", "r"}
