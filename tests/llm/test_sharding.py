import zlib

import pytest
from pyspark.sql import functions as F

from pagegrain.llm.queries import op9_external_shuffle
from pagegrain.llm.sharding import external_shuffle, write_shards


@pytest.mark.parametrize("bucket", [200, 1 << 20])
def test_every_record_has_one_place(documents, bucket):
    rows = [(k, f"text é {k} " * (k % 9)) for k in range(300)] + [(7, None), (7, None), (None, "x")] + [(5, "same")] * 150
    found = external_shuffle(documents(rows), bucket=bucket).select("doc.doc_id", "doc.text", "size", "crc", "shard", "slot").collect()
    key = lambda pair: (pair[0] or -1, pair[1] or "")
    assert sorted(((r.doc_id, r.text) for r in found), key=key) == sorted(rows, key=key)
    for r in found:
        data = (r.text or "").encode()
        assert (r["size"], r.crc) == (len(data) + 1, zlib.crc32(data))
    shards = [sorted(r.slot for r in found if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in shards)
    assert max(map(len, shards)) - min(map(len, shards)) <= 1
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.2 < rising / len(order) < 0.8  # no sorted stretch is left


def test_same_seed_same_places(documents):
    df = documents([(k, "x" * k) for k in range(100)])
    once, again, other = ({r.doc.doc_id: (r.shard, r.slot) for r in external_shuffle(df, seed=s).collect()} for s in (1, 1, 2))
    assert once == again != other


@pytest.mark.parametrize("bucket_rows", [7, 1 << 18])
def test_written_shards(documents, tmp_path, bucket_rows):
    path = str(tmp_path / "shards")
    back = write_shards(documents([(k, f"t{k}") for k in range(50)] + [(k, None) for k in range(50, 90)]), path, shards=4, file_bytes=20, bucket_rows=bucket_rows)
    assert back.groupBy("shard").agg(F.count("*"), F.max("slot")).orderBy("shard").collect()[0][1:] == (23, 22)
    assert back.select("doc.text").distinct().count() == 51 and back.select("doc.row").first()[0] == "row"
    files = back.groupBy("shard", F.col("_metadata.file_path").alias("file")).agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("*").alias("n"))
    ranges = sorted(tuple(r)[:1] + tuple(r)[2:] for r in files.collect())
    assert len(ranges) > 8 and all(high - low + 1 == n for _, low, high, n in ranges)


def test_registered_query(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate([None, "", "é", "same", "same", "x" * 100_000, *map(str, range(40))])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS shard", "1 AS slot", "'b' AS doc")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = op9_external_shuffle(spark, str(tmp_path))
    assert found.dtypes == [
        ("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int"),
    ]
    found = found.collect()
    expected = {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == expected and len(found) == len(rows)
    for shard in range(8):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)
    table.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op9_external_shuffle(spark, str(tmp_path / "none")).collect() == []


def test_empty_table(documents):
    assert external_shuffle(documents([])).count() == 0
