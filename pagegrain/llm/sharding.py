"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records into buckets of bounded size by a seeded hash. Pass two permutes each bucket by itself:
Spark's ``shuffle`` function runs a Fisher-Yates shuffle over the bucket's places. The buckets one after another are
a random order of all records; the shards take turns along it, so their counts differ by one at most. Each record is
then sent to the file its slot belongs to, and the shards are written.

Only row numbers are permuted, so that a bucket's records never have to stand in one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import drop, new_path, save, utf8, whole, write

SHARDS = 8
SEED = 42
# Bytes of a bucket, and its rows (empty texts take hardly any bytes).
BUCKET = 16 << 20
BUCKET_ROWS = 1 << 18
# Bytes of text in a file of a shard.
FILE = 256 << 20


def _deal(docs: DataFrame, text: str, shards: int, seed: int, bucket: int, bucket_rows: int, records: str) -> tuple[DataFrame, DataFrame, int, int]:
    """The records (row, doc, size, crc; written to ``records``), the place of each (of_row, shard, slot), their number and their bytes."""
    spark = docs.sparkSession
    data = utf8(F.col(f"doc.`{text}`"))
    rows = whole(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc", (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("crc")
    )
    write(rows, records)
    rows = spark.read.schema(rows.schema).parquet(records)
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    count = max(1, -(-size // bucket), -(-total // bucket_rows))
    scattered = rows.select("row", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(count)).alias("bucket"))
    held = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled = held.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    places = settled.select("bucket", F.posexplode(F.shuffle(F.sequence(F.lit(1).cast("bigint"), F.col("n")), F.lit(seed))).alias("place", "k"))
    places = save(places, "places")
    # one row for each bucket
    offsets = held.select(F.col("bucket").alias("b"), (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("offset"))
    numbered = scattered.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("row")).cast("bigint"))
    ordered = numbered.join(places, ["bucket", "k"]).join(offsets, F.col("bucket") == F.col("b"))
    ordered = ordered.select("row", (F.col("offset") + F.col("place")).alias("at"))
    dealt = ordered.select(
        F.col("row").alias("of_row"), F.pmod("at", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("at") / shards).alias("slot")
    )
    return rows, dealt, total, size


def external_shuffle(
    docs: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket: int = BUCKET, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``doc`` (the input row), ``size`` (UTF-8 bytes and one), ``crc``, ``shard``, ``slot`` (from 0 within the shard).

    Null texts have size 1; repeated rows and ids are records of their own, each in a place of its own, so that no hot
    value gathers in a bucket; an empty table gives no rows. The order depends on the seed, the rows' places in
    the input files and the number of shuffle partitions.
    """
    rows, dealt, _, _ = _deal(docs, text, shards, seed, bucket, bucket_rows, new_path(docs.sparkSession, "records"))
    return rows.join(dealt, F.col("row") == F.col("of_row")).select("doc", "size", "crc", "shard", "slot")


def write_shards(
    docs: DataFrame, path: str, text: str = "text", shards: int = SHARDS, seed: int = SEED, file_bytes: int = FILE, bucket: int = BUCKET,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Writes the shuffled records (``doc``, ``slot``) to ``path/shard=N``: one file for each range of slots, sorted, of about ``file_bytes``
    of text. Returns the table as reread: ``doc``, ``slot``, ``shard``. Cases as in :func:`external_shuffle`; an empty table makes an empty one."""
    spark = docs.sparkSession
    records, scattered = new_path(spark, "records"), new_path(spark, "scattered")
    rows, dealt, total, size = _deal(docs, text, shards, seed, bucket, bucket_rows, records)
    files, each = max(1, -(-size // (shards * file_bytes))), max(1, -(-total // shards))
    part = F.col("shard") * files + F.floor(F.col("slot") * files / each).cast("int")
    placed = dealt.withColumn("part", part.cast("int"))
    joined = rows.select("row", "doc").join(placed, F.col("row") == F.col("of_row"))
    # written between the two shuffles of the texts, so that only one of them is on disk at a time
    joined = joined.select("doc", "slot", "shard", "part")
    write(joined, scattered)
    drop(spark, records)
    ordered = spark.read.schema(joined.schema).parquet(scattered).repartitionById(shards * files, F.col("part"))
    ordered = ordered.sortWithinPartitions("shard", "slot").select("doc", "slot", "shard")
    write(ordered, path, "shard")
    drop(spark, scattered)
    return spark.read.schema(ordered.schema).parquet(path)
