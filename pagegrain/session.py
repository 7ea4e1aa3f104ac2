"""Session settings the package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import StructureError

# AQE splits skewed shuffle partitions (also where that costs one more shuffle) and picks
# broadcast joins from measured sizes, so no join in this package carries a broadcast hint.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # larger generated methods are never compiled to machine code by HotSpot
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; everything else stays with the cluster's owner."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure ``DataFrame.checkpoint`` has a folder every executor can reach.

    The folder named by ``spark.checkpoint.dir`` always wins. Only a local session, where
    driver and executors share one disk, gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return
    if context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise StructureError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pagegrain-checkpoint-"))


def scratch_folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
