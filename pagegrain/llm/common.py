"""What the operators share: stable copies of inputs, bounded Arrow batches, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow batches end at this size, so that a run of long texts does not fill a worker.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2000

_own_folders: dict[str, str] = {}
_stage_tables: dict[tuple[str, str], list[str]] = {}
_recording: list[list[str]] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, local sessions get a folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folders[application] = tempfile.mkdtemp(prefix="pagegrain-")
    return _own_folders[application]


@contextmanager
def _settings(spark: SparkSession, **values: str):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def measured_joins(spark: SparkSession):
    """Joins that run inside are broadcast only by sizes that AQE has measured, never by those of files: a packed table can be
    many times as large in the driver's memory. The limit stays the session's."""
    limit = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with _settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold=limit):
        yield


def _ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="pagegrain-")) / "pagegrain_workers.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(application)


def python_workers(spark: SparkSession) -> None:
    """Makes workers ready: the package, and smaller Arrow batches, which change memory, never results."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def save(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, reread. Its shuffle files go once it is written.

    A later step reads the table, so it does not repeat the work and sees the same rows after a loss.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    write(df, path)
    if _recording:
        _recording[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes a table, in folders by columns if any are given; shuffle files go once it is written."""
    with _settings(
        df.sparkSession,
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
        spark__sql__parquet__compression__codec="zstd",
    ):
        df.write.partitionBy(*by).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that this run has written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def stage_tables(spark: SparkSession, stage: str, before: str | None):
    """Notes the tables that a stage saves, and deletes those of the stage before, whose result is a table of its own by now."""
    application = spark.sparkContext.applicationId
    for path in _stage_tables.pop((application, before), []):
        drop(spark, path)
    _recording.append([])
    try:
        yield
    finally:
        _stage_tables.setdefault((application, stage), []).extend(_recording.pop())


@contextmanager
def step_tables(spark: SparkSession):
    """Deletes the tables that are saved inside, except the last, which is the result."""
    _recording.append([])
    try:
        yield
    finally:
        *steps, result = _recording.pop() or [None]
        for path in steps:
            drop(spark, path)
        if result and _recording:
            _recording[-1].append(result)


def whole(docs: DataFrame) -> DataFrame:
    """Every input row as one struct ``doc``, so that no name of ours can clash with its columns."""
    return docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"))


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """``doc`` with a number ``row``, written once: repeated ids and rows stay apart, and keys are stable."""
    return save(whole(docs).select(F.monotonically_increasing_id().alias("row"), "doc"), label)


def utf8(column) -> "F.Column":
    """The bytes of a text, empty for null."""
    return F.coalesce(column.cast("binary"), F.lit(b""))
