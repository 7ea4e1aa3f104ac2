"""Revision log fed by a stream.

Every micro-batch of revisions is validated and appended to the log in a folder of its own, so a batch
that runs again after a failure replaces itself. The latest state is derived from the log: a revision
that arrives late is kept, but does not become the latest one. ``compact`` turns log and snapshot into
a new snapshot from time to time, so readers never have to merge a long log.

``start_latest`` follows the log as a second stream. Its state store holds the latest revision of every page, partitioned
by page; the partial results of a task meet before the shuffle, so a page with very many revisions in one batch is
one row for each task. What a batch changes is written in a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.names import quoted
from ..operators.revisions import save_revisions
from ..operators.validation import validated
from ..schema import Schema
from ..store import Store

KEYS = ["pid", "rev"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_ingest(
    stream: DataFrame,
    schema: Schema,
    log: str,
    checkpoint: str,
    users: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append a stream of ``pid``, ``rev`` and cells by label to the log.

    Good records go to ``<log>/accepted/batch=<n>``, others with their errors to
    ``<log>/rejected/batch=<n>``. ``checkpoint`` is the stream's own progress folder.
    ``trigger`` is passed on to the writer; by default what is there is worked off once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        checked = validated(batch, schema, KEYS, users).persist()
        try:
            good = checked.filter((F.size("errors") == 0) & (F.col("rev") > 0)).drop("errors")
            good = first_arrived(good.withColumn("batch", F.lit(number)))
            good.write.mode("overwrite").parquet(f"{log}/accepted/batch={number}")
            bad = checked.filter((F.size("errors") > 0) | ~(F.coalesce("rev", F.lit(0)) > 0))
            bad.write.mode("overwrite").parquet(f"{log}/rejected/batch={number}")
        finally:
            checked.unpersist()

    return (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def log_fields(schema: Schema) -> StructType:
    """Columns of the accepted part of a log."""
    cells = [(c.label, ArrayType(StringType()) if c.multi else StringType()) for c in schema.enabled]
    named = [("pid", StringType()), ("rev", LongType()), *cells, ("batch", IntegerType())]
    return StructType([StructField(name, kind) for name, kind in named])


def start_latest(
    spark: SparkSession, schema: Schema, log: str, state: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the latest revision of every page of a log that has at least one batch.

    Of a ``(pid, rev)`` that came several times the first counts. The pages a batch touches go to
    ``<state>/batch=<n>``; a batch that runs again replaces its folder. The state grows with the pages, so it
    is kept in RocksDB and survives in ``checkpoint``, from which a new start goes on.
    """

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/batch={number}")

    fields = log_fields(schema)
    cells = [name for name in fields.names if name not in (*KEYS, "batch")]
    record, arrival = F.struct("rev", *quoted(cells)), F.struct("rev", -F.col("batch"))
    rows = spark.readStream.schema(fields).parquet(f"{log}/accepted")
    latest = rows.groupBy("pid").agg(F.max_by(record, arrival).alias("_top")).select("pid", "_top.*")
    writer = latest.writeStream.outputMode("update").foreachBatch(keep)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        # a query takes the settings of its start
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest_pages(spark: SparkSession, state: str, base: DataFrame | None = None, after: int | None = None) -> DataFrame:
    """The latest revision of every page, as ``start_latest`` left it: ``pid``, ``rev`` and cells.

    With ``base``, an earlier result, only the batches after its newest one (``after``) are read.
    """
    changes = spark.read.parquet(state)
    if after is not None:
        changes = changes.filter(F.col("batch") > after)
    if base is not None:
        changes = changes.unionByName(base.withColumn("batch", F.lit(-1)))
    rest = [c for c in changes.columns if c not in ("pid", "batch")]
    newest = changes.groupBy("pid").agg(F.max_by(F.struct(*quoted(rest)), "batch").alias("_top"))
    return newest.select("pid", "_top.*")


def read_log(spark: SparkSession, log: str, after: int | None = None) -> DataFrame:
    """Accepted revisions of the batches after a number, each ``(pid, rev)`` once."""
    rows = spark.read.parquet(f"{log}/accepted")
    return first_arrived(rows if after is None else rows.filter(F.col("batch") > after))


def first_arrived(rows: DataFrame) -> DataFrame:
    """Each ``(pid, rev)`` as it came first; of different records in one batch the smallest, whole."""
    rest = [c for c in rows.columns if c not in (*KEYS, "batch")]
    first = rows.groupBy(*KEYS).agg(F.min(F.struct("batch", *quoted(rest))).alias("_first"))
    return first.select(*KEYS, "_first.*").drop("batch")


def last_batch(spark: SparkSession, folder: str) -> int | None:
    """Number of the newest batch in a folder of batches, to be kept with a snapshot made from it."""
    return spark.read.parquet(folder).agg(F.max("batch")).first()[0]


def compact(
    store: Store, schema_name: str, log: str, after: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The ``data`` and ``multi`` tables of the store with the log worked in.

    ``after`` is the newest batch that the store already holds; earlier folders are not read.
    """
    return save_revisions(store, schema_name, read_log(store.spark, log, after))
