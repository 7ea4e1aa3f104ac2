import random

import corpus_pipeline
from pagegrain.llm.common import shared_folder
from tests.llm import brute


def first_of_groups(texts, words=4):
    """Smallest ids of the groups that SimHash fingerprints make, every pair compared."""
    ids = sorted(texts)
    groups = brute.groups([brute.fingerprint(texts[i], words) for i in ids])
    return {min(i for i, g in zip(ids, groups, strict=True) if g == group) for group in set(groups)}


def test_stages_take_effect(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leak = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    known = sorted({w for r in source.filter("lang = 'en'").limit(60).collect() for w in (r.text or "").split() if w.isascii() and w.isalpha() and w.islower() and len(w) > 3})
    dice = random.Random(5)
    passage = lambda n: [dice.choice(known) for _ in range(n)]
    shared, one, other = " ".join(passage(120)), passage(90), passage(90)
    rows = [(10_000, None), (10_001, "123 !"), (10_002, f"the one {leak} and more"), (10_003, f"the start é{shared} {' '.join(one)}"),
            (10_004, f"other {' '.join(other)} \u0669{shared}"), (10_005, "the very same words"), (10_006, "the very same words")]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], source.schema)
    source.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept, frames = spark.read.parquet(str(tmp_path / "documents.parquet")), [], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        kept.append(set(frames[name]))
        if name != "packing":
            assert docs.columns == source.columns
    every = {r.doc_id for r in source.collect()} | {i for i, _ in rows}
    assert every - kept[0] >= {10_000, 10_001} and len(every - kept[0]) < 5
    firsts = first_of_groups({i: r["text"] for i, r in frames["language"].items()})
    assert kept[1] == firsts and 10_005 in firsts and 10_006 not in kept[1] and len(firsts) < len(kept[0]) - 1
    texts = frames["repeated_strings"]
    assert kept[2] == kept[1] and shared[200:300] not in texts[10_003]["text"] + texts[10_004]["text"]
    assert texts[10_003]["text"] == f"the start  {' '.join(one)}" and texts[10_004]["text"] == f"other {' '.join(other)} "
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert 10_002 in kept[2] - kept[3] and 10_003 in kept[3]
    assert kept[4] == kept[3]
    assert corpus_pipeline.ORACLE_SQL is None
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    clashing = source.selectExpr("*", "'a' AS __text", "'b' AS doc", "'c' AS new", "'d' AS cut", "1L AS row", "'e' AS spans", "'f' AS n")
    for frame in (source.limit(0), clashing):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            path = f"{shared_folder(spark)}/{name}-{frame is clashing}-{tmp_path.name}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == frame.columns
        assert bool(docs.count()) == (frame is clashing)
