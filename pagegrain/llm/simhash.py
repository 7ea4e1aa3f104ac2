"""SimHash near-duplicates, with pigeonring chains as the filter before the Hamming check.

A fingerprint's 64 bits lie on a ring of five segments. If two fingerprints differ in at most four bits, some
segment starts a chain in which every prefix of ``l`` segments differs in at most ``4 * l / 5`` bits: none in the first
segment, at most one in the first two, then two and three. The first two segments of the chain are the join key
(the second with its one-bit variants on one side), the rest of the chain and the full distance are join conditions.

Where very many fingerprints share a key, pairs would grow with the square. Fingerprints that meet such a key are
linked over midpoints instead: two fingerprints differ in at most four bits exactly if some point lies within two
bits of both, so each sends its 2,081 points and every point links what it gets to the smallest. Both ways give the same
components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import python_workers, save, utf8, whole
from pagegrain.llm.components import components

DISTANCE = 4
SEGMENTS = DISTANCE + 1
# Fingerprints of a key from which on it is linked over midpoints; either way gives the same result.
CROWDED = 2000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BLOCK = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """A bit is set if more than half of the shingles' XXH64 values (seed 42) have it; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(found) - words + 1], ends[words - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        pairs = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], 42) for a, b in pairs], dtype="<u8").view(np.uint8).reshape(-1, 8)
        if len(hashes) < 200:
            total += np.unpackbits(hashes, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            for byte in range(8):
                total[byte * 8 : byte * 8 + 8] += np.bincount(hashes[:, byte], minlength=256) @ _BITS
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int) -> Column:
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return of(utf8(text))


def _segments() -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    edges = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chain(first: int, length: int) -> int:
    """The bits of so many segments from the given one on around the ring."""
    parts = _segments()
    return sum(((1 << w) - 1) << s for s, w in (parts[(first + k) % SEGMENTS] for k in range(length)))


def _exact_keys(prints: DataFrame) -> DataFrame:
    """One row for each start of a chain: the segment's number and the bits of its first two segments."""
    keys = [F.struct(F.lit(k).alias("at"), F.col("fp").bitwiseAND(_signed(_chain(k, 2))).alias("key")) for k in range(SEGMENTS)]
    return prints.select("fp", F.inline(F.array(*keys)))


def _near_keys(prints: DataFrame) -> DataFrame:
    """The keys of fingerprints that have the same first and up to one differing bit in the second segment."""
    flips = []
    for k in range(SEGMENTS):
        shift, width = _segments()[(k + 1) % SEGMENTS]
        flips += [(k, _signed(_chain(k, 2)), _signed(flip)) for flip in [0, *(1 << (shift + b) for b in range(width))]]
    rows = [
        F.struct(F.lit(k).alias("at"), F.col("fp").bitwiseAND(mask).bitwiseXOR(F.lit(flip).cast("bigint")).alias("key"))
        for k, mask, flip in flips
    ]
    return prints.select(F.col("fp").alias("other"), F.inline(F.array(*rows)))


def _prefixes_hold() -> Column:
    """The budget of each prefix of the chain that starts at segment ``at``."""
    differ, found = F.col("fp").bitwiseXOR(F.col("other")), F.lit(False)
    for k in range(SEGMENTS):
        held = F.col("at") == k
        for length in range(1, SEGMENTS):
            budget = DISTANCE * length // SEGMENTS
            held &= F.bit_count(differ.bitwiseAND(_signed(_chain(k, length)))) <= budget
        found |= held
    return found & (F.bit_count(differ) <= DISTANCE)


def _midpoint_links(prints: DataFrame) -> DataFrame:
    """Links of each fingerprint to the smallest that shares a point within half the distance."""
    bits = [1 << b for b in range(64)]
    flips = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[i + 1 :])]
    points = prints.select("fp", F.explode(F.array(*[F.lit(_signed(f)).cast("bigint") for f in flips])).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    # sizes are guessed from below the explode, so a broadcast side could hold thousands of times what Spark takes it for
    return points.join(least.hint("merge"), "point").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all within the distance. ``prints``: distinct ``fp``."""
    exact, near = _exact_keys(prints), _near_keys(prints)
    hot = save(exact.groupBy("at", "key").count().filter(F.col("count") > crowded).select("at", "key"), "hot-keys")
    crowds = not hot.isEmpty()
    kept = exact.join(hot, ["at", "key"], "left_anti") if crowds else exact
    near = near.select("other", F.col("at").alias("near_at"), F.col("key").alias("near_key"))
    same = (F.col("at") == F.col("near_at")) & (F.col("key") == F.col("near_key"))
    # both sides are many rows for each fingerprint, which Spark's sizes leave out; see ``_midpoint_links``
    pairs = kept.join(near.hint("merge"), same & (F.col("fp") < F.col("other")) & _prefixes_hold())
    pairs = pairs.select(F.col("other").alias("a"), F.col("fp").alias("b"))
    if crowds:
        meets = (F.col("near_at") == F.col("at")) & (F.col("near_key") == F.col("key"))
        dense = near.join(hot, meets, "left_semi").select(F.col("other").alias("fp")).distinct()
        pairs = pairs.union(_midpoint_links(dense))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 4, crowded: int = CROWDED) -> DataFrame:
    """``doc`` (the input row), ``fingerprint`` (16 hex digits), ``component_id``: the smallest id reachable over links,
    ``is_first``: true for one row of each component, one with that id.

    Null and wordless texts have fingerprint zero and are linked like others; repeated rows each stay a row of
    their component; a component without any id has a null ``component_id``; an empty table gives no rows.
    """
    python_workers(docs.sparkSession)
    rows = whole(docs).withColumn("row", F.monotonically_increasing_id())
    printed = save(rows.withColumn("fp", fingerprints(F.col(f"doc.`{text}`"), words)), "fingerprints")
    own = F.struct(F.col(f"doc.`{id}`").isNull().alias("none"), F.col(f"doc.`{id}`").alias("id"), "row")
    prints = save(printed.groupBy("fp").agg(F.min(own).alias("least")), "prints")
    roots = components(links(prints.select("fp"), crowded))
    linked = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("first"))
    labels = linked.join(least, "root").select("fp", "first")
    # every fingerprint has a label; as a left join it never broadcasts the texts, however small their files are
    return printed.join(labels, "fp", "left").select(
        "doc",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("is_first"),
    )
