"""Packing in space-filling-curve order.

A document's token ids are hashed into signs, added up and scaled by its length: a few coordinates that lie close for
documents with common vocabulary. The coordinates become a Hilbert key, documents are range-sorted by it, and the
ids are laid along the curve one after another and cut every 2,048: neighbours share sequences, and only the last sequence
of all is short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import python_workers, save
from pagegrain.llm.tokens import tokenized

LENGTH = 2048
DIMENSIONS = 4
BITS = 12
_HASHED = 1 << 16
SEED = 8


def _signs() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (_HASHED, DIMENSIONS)).astype(np.float32) * 2 - 1


def coordinates(ids: Column) -> Column:
    """The sum of the ids' sign vectors over the root of their number."""
    signs = _signs()

    @F.arrow_udf("array<double>")
    def of(blobs: pa.Array) -> pa.Array:
        found = np.zeros((len(blobs), DIMENSIONS))
        for k, blob in enumerate(blobs):
            own = np.frombuffer(blob.as_buffer(), "<u4")
            counts = np.bincount(own * np.uint32(2654435761) >> np.uint32(16), minlength=_HASHED) if len(own) > _HASHED else None
            total = counts @ signs if counts is not None else signs[own * np.uint32(2654435761) >> np.uint32(16)].sum(0)
            found[k] = total / np.sqrt(max(1, len(own)))
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))

    return of(ids)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of cells (rows of whole numbers below ``2 ** bits``)."""
    axes = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for k in range(len(axes)):
            high = (axes[k] & step) != 0
            swapped = np.where(high, 0, (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swapped)
            if k:
                axes[k] ^= swapped
        step >>= 1
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    turn = np.zeros(len(cells), np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        turn = np.where(axes[-1] & step, turn ^ (step - 1), turn)
        step >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def curve_key(point: Column, means: list[float], spreads: list[float]) -> Column:
    @F.arrow_udf("bigint")
    def of(points: pa.Array) -> pa.Array:
        values = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
        scaled = 0.5 + 0.5 * np.tanh((values - means) / spreads)
        return pa.array(hilbert(np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))

    return of(point)


def along_curve(tokens: DataFrame) -> DataFrame:
    """(row, key, before): the ids of all documents earlier on the curve. ``tokens``: row, id, n, ids."""
    points = save(tokens.select("row", "id", "n", coordinates(F.col("ids")).alias("point")), "points")
    parts = [f(F.col("point")[k]) for k in range(DIMENSIONS) for f in (F.avg, F.stddev_pop)]
    stats = [v or 0.0 for v in points.agg(*parts).first()]
    keyed = points.select("row", "id", "n", curve_key(F.col("point"), stats[::2], [v or 1.0 for v in stats[1::2]]).alias("key"))
    count = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(count, "key", "id", "row").withColumn("part", F.spark_partition_id())
    ranged = save(ranged, "curve")
    ahead = W.partitionBy("part").orderBy("key", "id", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("held"))
    # one row for each range
    offsets = sizes.select(F.col("part").alias("p"), (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("offset"))
    placed = ranged.withColumn("inside", F.sum("n").over(ahead) - F.col("n"))
    joined = placed.join(F.broadcast(offsets), F.col("part") == F.col("p"))
    return joined.select("row", "key", (F.col("offset") + F.col("inside")).alias("before"))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Pieces: ``id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Every document ends with the end id, so null and empty texts are pieces of one id; repeated rows and ids are
    documents of their own; an empty table gives no pieces.
    """
    python_workers(docs.sparkSession)
    tokens = tokenized(docs, tokenizer, text, id)
    rows = tokens.join(along_curve(tokens).select("row", "before"), "row")
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    numbers = F.sequence(F.floor(first / length), F.floor(last / length))
    cut = rows.select("id", "n", "ids", "before", F.explode(numbers).alias("sequence_id"))
    cut = cut.withColumn("start", F.greatest(F.lit(0).cast("bigint"), F.col("sequence_id") * length - F.col("before")))
    cut = cut.withColumn("length", F.least("n", (F.col("sequence_id") + 1) * length - F.col("before")) - F.col("start"))
    return cut.select(
        "id", "start", "length", F.expr("substring(ids, CAST(4 * start + 1 AS INT), CAST(4 * length AS INT))").alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", (F.col("before") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    )
