import random

import pytest
from pyspark.sql import functions as F

from pagegrain.llm.common import measured_joins, save
from pagegrain.llm.components import components
from pagegrain.llm.simhash import fingerprint, links, near_duplicates
from tests.llm import brute


def test_fingerprints_follow_the_rule():
    texts = ["", " \t\n", "One", "a b c", "A B c D", "é à É x y z", "w " * 5000, "a\x1cb c\x00d e f"]
    for text in texts:
        for size in (1, 4, 5):
            assert fingerprint(text.encode(), size) == brute.fingerprint(text, size)


def variants(seed, count, most):
    """Fingerprints around a few centres, each with up to so many bits changed."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    found = set()
    while len(found) < count:
        value = draw.choice(centres)
        for bit in draw.sample(range(64), draw.randint(0, most)):
            value ^= 1 << bit
        found.add(value)
    return sorted(found)


@pytest.mark.parametrize("crowded", [1000, 3])
def test_links_connect_like_all_pairs(spark, crowded):
    prints = variants(1, 60, 6)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    pairs = links(df, crowded)
    for a, b in pairs.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    root = {r.node: r.root for r in components(pairs).collect()}
    ours = [root.get(p, p) for p in signed]
    theirs = brute.groups(prints)
    assert len(set(zip(ours, theirs))) == len(set(ours)) == len(set(theirs))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_documents_with_nulls_copies_and_clashing_columns(spark, documents):
    long = " ".join(f"word{k}" for k in range(400))
    rows = [(7, long), (3, long + " more"), (3, long), (5, None), (9, ""), (None, "alone here"), (2, "quite another text"), (2, "quite another text")]
    found = near_duplicates(documents(rows)).select("doc.doc_id", "doc.fp", "doc.text", "fingerprint", "component_id", "is_first").collect()
    assert len(found) == 8 and {r.fp for r in found} == {"fp"}
    prints = [brute.fingerprint(r.text, 4) for r in found]
    assert [int(r.fingerprint, 16) for r in found] == prints
    members = {}
    for r, group in zip(found, brute.groups(prints), strict=True):
        members.setdefault(group, []).append(r)
    for group in members.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.component_id for r in group} == {min(ids, default=None)}
        assert sum(r.is_first for r in group) == 1


def test_empty_table(documents):
    assert near_duplicates(documents([])).count() == 0


def broadcast_sides(df):
    """What the plan has below each broadcast."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((n for n, x in enumerate(lines[k + 1 :], k + 1) if depth(x) <= depth(line)), len(lines))
            found.append("\n".join(lines[k:below]))
    return found


@pytest.mark.parametrize("crowded", [1000, 3])
def test_exploded_sides_are_never_broadcast(spark, crowded):
    """Spark sizes an explode by the rows it gets, so 0.6 GB of documents sent 17 million rows through the driver."""
    signed = [p - (1 << 64) if p >> 63 else p for p in variants(1, 60, 6)]
    prints = save(spark.createDataFrame([(p,) for p in signed], "fp bigint"), "prints")
    pairs = links(prints, crowded)
    assert "Generate" in pairs._jdf.queryExecution().executedPlan().toString()
    assert not any("Generate" in side for side in broadcast_sides(pairs))


def test_texts_are_never_broadcast(documents):
    """Texts that pack well have small files."""
    found = near_duplicates(save(documents([(k, "the same text " * 50) for k in range(40)]), "packed"))
    assert not any("fingerprints-" in side for side in broadcast_sides(found))
    assert {r.component_id for r in found.collect()} == {0} and found.filter("is_first").count() == 1


def test_measured_joins_do_not_trust_the_size_of_files(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(name, None) for name in names]
    packed = save(spark.range(2000).select(F.lit(1).alias("k")), "packed")
    plan = lambda: packed.join(packed.withColumnRenamed("k", "other"), F.col("k") == F.col("other"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with measured_joins(spark):
        assert [spark.conf.get(name) for name in names] == ["-1", before[0] or "10485760b"]
        assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    with pytest.raises(ZeroDivisionError), measured_joins(spark):
        raise ZeroDivisionError
    assert [spark.conf.get(name, None) for name in names] == before
