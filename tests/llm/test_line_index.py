import numpy as np
import pytest

from pagegrain.llm import line_index
from pagegrain.llm.line_index import Cuckoo, add_documents, delete, documents_now, remove_repeated_lines
from tests.llm.brute import ascii_lower

SCHEMA = "doc_id bigint, text string"


def plain(docs, least=10):
    """n lines, n dropped and kept text of every document, by id; ids are distinct."""
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
            if len(key) >= least:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if min(holders.get(ascii_lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d")), {i})) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def result(found):
    return {r.doc.doc_id: (r.cut.n, r.cut.n_dropped, bytes(r.cut.kept).decode()) for r in found.collect()}


def some_documents(count, seed):
    random = np.random.default_rng(seed)
    common = [f"a line that {k} documents share" for k in range(30)] + ["short", "Ünïcode énd", "nine cp é", "ten cp éöü"]

    def line(i):
        pick = random.integers(0, 10)
        if pick < 4:
            return f"own line {i} {random.integers(0, 1000)}"
        known = common[random.integers(0, len(common))]
        return (known, known.upper(), f"  {known}\t\r", f"\x0b{known} ")[pick % 4]

    docs = [(i, "\n".join(line(i) for _ in range(random.integers(0, 12)))) for i in range(count)]
    return docs + [(count, None), (count + 1, ""), (count + 2, "\n\n"), (count + 3, docs[0][1]), (count + 4, "\n".join([common[0]] * 500))]


def test_against_plain(spark):
    docs = some_documents(60, 1)
    found = remove_repeated_lines(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert result(found) == plain(docs)


@pytest.mark.parametrize("shard_keys", [3, line_index.SHARD_KEYS])
def test_added_and_deleted_again(spark, shard_keys):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    docs = some_documents(40, 2)
    first, second = docs[::2], docs[1::2]
    index, _ = add_documents(None, frame(first), shard_keys=shard_keys)
    index, found = add_documents(index, frame(second), shard_keys=shard_keys)
    whole = plain(docs)
    assert result(found) == {i: whole[i] for i, _ in second}
    # those added before now lose what smaller ids of the second batch hold
    assert result(documents_now(index, frame(docs))) == whole
    gone = [i for i, _ in docs if i % 3 == 0]
    left = [(i, text) for i, text in docs if i % 3]
    smaller = delete(index, frame([(i, None) for i in gone] + [(10**6, None)]))
    assert result(documents_now(smaller, frame(left))) == plain(left)
    again, _ = add_documents(smaller, frame([d for d in docs if d[0] in gone]), shard_keys=shard_keys)
    assert result(documents_now(again, frame(docs))) == whole
    keys = {(r.h1, r.h2): r.refs for r in again.counts.collect()}
    assert keys == {(r.h1, r.h2): r.refs for r in index.counts.collect()}


def test_hot_lines_and_filter_give_the_same(spark, monkeypatch):
    docs = some_documents(50, 3)
    expected = plain(docs)
    for hot in (1, 10**9):  # every shared line by the filter, every one by the broadcast
        monkeypatch.setattr(line_index.repeated_places, "__defaults__", (hot,))
        assert result(remove_repeated_lines(spark.createDataFrame(docs, SCHEMA))) == expected


def test_repeated_ids_null_ids_and_clashing_columns(spark):
    shared = "one line of several documents"
    rows = [(None, shared, 1), (3, shared, 2), (3, shared, 3), (4, f"{shared}\nrest", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cut int")
    found = {r.doc.cut: bytes(r.cut.kept).decode() for r in remove_repeated_lines(df).collect()}
    assert found == {1: shared, 2: "", 3: "", 4: "rest"}
    alone = spark.createDataFrame(rows[1:3], df.schema)
    assert [r.cut.n_dropped for r in remove_repeated_lines(alone).collect()] == [0, 0]


def test_empty_table_and_very_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index, found = add_documents(None, empty)
    assert found.count() == 0
    long = [(1, "\n".join(f"line number {k % 20_000}" for k in range(60_000))), (2, "x" * 2_000_000 + "\nline number 7")]
    _, found = add_documents(index, spark.createDataFrame(long, SCHEMA))
    assert result(found) == plain(long)


def test_cuckoo_filter():
    random = np.random.default_rng(5)
    keys = random.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    made = Cuckoo.of(keys)
    assert made.contains(keys).all()
    others = random.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert made.contains(others).mean() < 0.002
    made.delete(keys[:10_000])
    assert made.contains(keys[10_000:]).all() and made.contains(keys[:10_000]).mean() < 0.002
    assert made.insert(keys[:10_000]) and Cuckoo.load(made.dump()).contains(keys).all()
    assert not Cuckoo(np.zeros(8, np.uint16)).insert(keys[:9])
    assert Cuckoo.of(np.repeat(keys[:1], 3)).contains(keys[:1]).all()
