"""Line dedup on an index that documents can be added to and deleted from.

The index keeps, for every key (a line without white space at its ends, lower-cased), an exact *reference count*: the
documents' rows that hold it, with the first and the last document id. In front of that table stand cuckoo filters, one for each
shard of the keys: ``seen`` holds every key of the table, ``shared`` those of two or more documents. A filter never denies
a key it holds, so

* keys of a new batch that ``seen`` denies are new and are added without a look at the exact table;
* lines that ``shared`` denies stay without a look at the exact table;
* all others are looked up there, so a false alarm of a filter changes nothing.

When a document is deleted its counts go down; keys that lose their last (or second last) document are deleted from the
filters too, which hold one fingerprint for each key, so that no other key is lost. The lines that had been dropped elsewhere in
favour of the deleted document come back: dedup is reversible.

Keys are compared by 128-bit digests. Shards grow in number with the keys, so a filter and a shard's keys have a bounded size.
Keys in a great share of the rows are few; they are looked up first, by a broadcast of bounded size, and never gather in a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagegrain.llm.common import BATCH_BYTES, keyed, python_workers, save, utf8

LEAST = 10  # code points of a key
SHARD_KEYS = 1 << 17
# Keys that may be hot at a time: those with more than this part of all rows.
HOT = 50_000
_KEY = ["h1", "h2"]
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SLOTS = 4  # fingerprints of a bucket


class Cuckoo:
    """A cuckoo filter over 64-bit hashes that are worked on all at once; a multiset, so every insert needs its own delete."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots.reshape(-1, _SLOTS).copy()

    @classmethod
    def of(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter with the hashes, at most about three quarters full."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, len(hashes)) / (_SLOTS * 0.75)))))
        while True:
            made = cls(np.zeros(buckets * _SLOTS, np.uint16))
            if made.insert(hashes):
                return made
            buckets *= 2

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1  # 0 is an empty slot
        return prints, (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return buckets ^ ((prints.astype(np.int64) * 0x5BD1E995) & (len(self.slots) - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, buckets = self._places(hashes)
        here = (self.slots[buckets] == prints[:, None]).any(1)
        return here | (self.slots[self._other(prints, buckets)] == prints[:, None]).any(1)

    def insert(self, hashes: np.ndarray, tries: int = 500) -> bool:
        """Adds the hashes; False if the filter is too full, which leaves it unusable."""
        prints, buckets = self._places(hashes)
        random = np.random.default_rng(len(hashes))
        for turn in range(tries):
            if not len(prints):
                return True
            order = np.argsort(buckets, kind="stable")
            prints, buckets = prints[order], buckets[order]
            rank = np.arange(len(buckets)) - np.searchsorted(buckets, buckets)
            free = self.slots[buckets] == 0
            fits = rank < free.sum(1)
            column = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.slots[buckets[fits], column] = prints[fits]
            prints, buckets, rank = prints[~fits], buckets[~fits], rank[~fits]
            if turn % 2:
                # one of each full bucket takes the slot of another, which moves on
                takes = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.empty(0, np.int64)
                slot = random.integers(0, _SLOTS, len(takes))
                moved = self.slots[buckets[takes], slot].copy()
                self.slots[buckets[takes], slot] = prints[takes]
                prints[takes] = moved
            buckets = self._other(prints, buckets)
        return not len(prints)

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one fingerprint for each hash; each has to have been inserted."""
        prints, buckets = self._places(hashes)
        for bucket, other, one in zip(buckets.tolist(), self._other(prints, buckets).tolist(), prints.tolist(), strict=True):
            for at in (bucket, other):
                held = np.flatnonzero(self.slots[at] == one)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").astype(np.uint16))


@dataclass(frozen=True)
class LineIndex:
    """``postings`` (row, id, h1, h2, at: places of the lines), ``counts`` (h1, h2, refs, first, last: structs with the id),
    ``seen`` and ``shared`` (shard, slots). All are tables in the shared folder."""

    postings: DataFrame
    counts: DataFrame
    seen: DataFrame
    shared: DataFrame
    shards: int


# --- lines -------------------------------------------------------------------------------------------------------------


def line_keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """Digests of the keys of a text with at least so many code points, and the places of their lines."""
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(_SPACE).lower()
        if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
            continue
        found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
    return found


def postings(rows: DataFrame, text: str, id: str, least: int) -> DataFrame:
    """One row for each key of each document. ``rows``: row, doc."""
    source = rows.select("row", F.col(f"doc.`{id}`").alias("id"), utf8(F.col(f"doc.`{text}`")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def table(batch: pa.RecordBatch, owners: list, digests: list, places: list) -> pa.RecordBatch:
        who, keys = pa.array(owners, pa.int64()), np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        arrays = [batch.column("row").take(who), batch.column("id").take(who), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(places, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "id", "h1", "h2", "at"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, digests, places = [], [], []
            for k, value in enumerate(batch.column("text")):
                found = line_keys(value.as_py(), least)
                owners += [k] * len(found)
                digests += found.keys()
                places += found.values()
                if len(owners) > BATCH_BYTES >> 6:
                    yield table(batch, owners, digests, places)
                    owners, digests, places = [], [], []
            if owners:
                yield table(batch, owners, digests, places)

    return save(source.mapInArrow(of, f"row bigint, id {kind}, h1 bigint, h2 bigint, at array<int>"), "postings")


# --- the index -----------------------------------------------------------------------------------------------------------


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min(F.struct("id")).alias("first"), F.max(F.struct("id")).alias("last"))


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEY).agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"))


def _is_shared() -> Column:
    return ~F.col("first").eqNullSafe(F.col("last"))


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int").alias("shard")


def _hashes(table: pa.Table) -> np.ndarray:
    return table["h2"].to_numpy().view(np.uint64)


def _filters(keys: DataFrame, shards: int, label: str) -> DataFrame:
    """A filter for each shard that has keys."""

    def of(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"].slice(0, 1), "slots": pa.array([Cuckoo.of(_hashes(table)).dump()], pa.binary())})

    return save(keys.select(_shard(shards), "h2").groupBy("shard").applyInArrow(of, "shard int, slots binary"), label)


def _updated(filters: DataFrame, added: DataFrame, removed: DataFrame, exact: DataFrame, shards: int, label: str) -> DataFrame:
    """Filters with keys added and removed. Those that become too full are made anew from the ``exact`` keys."""
    changes = added.select(_shard(shards), "h2", F.lit(True).alias("is_new")).union(removed.select(_shard(shards), "h2", F.lit(False)))

    def of(own: pa.Table, changes: pa.Table) -> pa.Table:
        shard = (own if own.num_rows else changes)["shard"].slice(0, 1)
        made = Cuckoo.load(own["slots"][0].as_py()) if own.num_rows else Cuckoo.of(np.empty(0, np.uint64))
        full = False
        if changes.num_rows:
            is_new, hashes = changes["is_new"].to_numpy(), _hashes(changes)
            made.delete(hashes[~is_new])
            full = not made.insert(hashes[is_new])
        return pa.table({"shard": shard, "slots": pa.array([None if full else made.dump()], pa.binary())})

    pairs = filters.groupBy("shard").cogroup(changes.groupBy("shard"))
    found = save(pairs.applyInArrow(of, "shard int, slots binary"), label)
    full = found.filter("slots IS NULL").select("shard")
    keys = exact.withColumn("shard", _shard(shards)).join(full, "shard", "left_semi")
    return save(found.filter("slots IS NOT NULL").unionByName(_filters(keys, shards, f"{label}-grown")), label)


def _probed(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``maybe``: False where the filter of the row's shard denies its key."""
    names = rows.columns
    dealt = rows.withColumn("shard", _shard(shards))
    schema = StructType(rows.schema.fields).add("maybe", "boolean")

    def of(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return to_arrow_schema(schema).empty_table()
        found = Cuckoo.load(filters["slots"][0].as_py()).contains(_hashes(rows)) if filters.num_rows else np.zeros(rows.num_rows, bool)
        return rows.select(names).append_column("maybe", pa.array(found))

    # shards without rows need no filter
    wanted = filters.join(dealt.select("shard").distinct(), "shard", "left_semi")
    return dealt.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(of, schema)


def _shard_count(keys: int, shard_keys: int) -> int:
    return max(1, -(-keys // shard_keys))


def insert(index: LineIndex | None, batch: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index with the postings of some documents added."""
    fresh = save(_counted(batch), "batch-counts")
    if index is None:
        shards = _shard_count(fresh.count(), shard_keys)
        seen = _filters(fresh, shards, "seen")
        return LineIndex(batch, fresh, seen, _filters(fresh.filter(_is_shared()), shards, "shared"), shards)
    probed = save(_probed(fresh, index.seen, index.shards), "probed")
    maybe, new = probed.filter("maybe").drop("maybe"), probed.filter("NOT maybe").drop("maybe")
    known = save(index.counts.join(maybe, _KEY, "left_semi"), "known")
    touched = save(_merged(known.unionByName(maybe)), "touched")
    counts = index.counts.join(maybe, _KEY, "left_anti").unionByName(touched).unionByName(new)
    counts = save(counts, "counts")
    all_postings = index.postings.unionByName(batch)
    shards = _shard_count(counts.count(), shard_keys)
    if shards > 2 * index.shards:
        seen = _filters(counts, shards, "seen")
        return LineIndex(all_postings, counts, seen, _filters(counts.filter(_is_shared()), shards, "shared"), shards)
    none = counts.filter(F.lit(False))
    added = touched.join(known, _KEY, "left_anti").unionByName(new)
    seen = _updated(index.seen, added, none, counts, index.shards, "seen")
    turned = touched.filter(_is_shared()).join(known.filter(_is_shared()), _KEY, "left_anti").unionByName(new.filter(_is_shared()))
    shared = _updated(index.shared, turned, none, counts.filter(_is_shared()), index.shards, "shared")
    return LineIndex(all_postings, counts, seen, shared, index.shards)


def delete(index: LineIndex, documents: DataFrame, id: str = "doc_id") -> LineIndex:
    """The index without the documents of these ids. Ids that it does not hold change nothing."""
    gone = documents.select(F.col(f"`{id}`").alias("gone_id")).distinct()
    same = F.col("id").eqNullSafe(F.col("gone_id"))
    left = save(index.postings.join(gone, same, "left_anti"), "postings")
    keys = save(index.postings.join(gone, same, "left_semi").select(*_KEY).distinct(), "gone")
    before = save(index.counts.join(keys, _KEY, "left_semi"), "before")
    after = save(_counted(left.join(keys, _KEY, "left_semi")), "after")
    counts = save(index.counts.join(keys, _KEY, "left_anti").unionByName(after), "counts")
    none = counts.filter(F.lit(False))
    seen = _updated(index.seen, none, before.join(after, _KEY, "left_anti"), counts, index.shards, "seen")
    ended = before.filter(_is_shared()).join(after.filter(_is_shared()), _KEY, "left_anti")
    shared = _updated(index.shared, none, ended, counts.filter(_is_shared()), index.shards, "shared")
    return LineIndex(left, counts, seen, shared, index.shards)


# --- dedup -----------------------------------------------------------------------------------------------------------------


def repeated_places(index: LineIndex, batch: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, at): for each posting the places of lines that stand in an earlier document of the index, or in the index as ``first``."""
    shared = index.counts.filter(_is_shared()).select(*_KEY, "refs", "first")
    total = index.counts.agg(F.sum("refs")).first()[0] or 0
    # fewer than ``hot`` keys can have more than this part of all rows
    common = shared.filter(F.col("refs") > total // hot)
    where = [F.col(k) == F.col(f"c_{k}") for k in _KEY]
    named = common.select(*[F.col(k).alias(f"c_{k}") for k in _KEY], F.col("first").alias("c_first"))
    looked = save(batch.join(F.broadcast(named), where, "left"), "looked")
    found = [looked.filter("c_h1 IS NOT NULL").select("row", "id", "at", F.col("c_first").alias("first"))]
    rest = _probed(looked.filter("c_h1 IS NULL").select(*batch.columns), index.shared, index.shards).filter("maybe")
    found.append(rest.join(shared.filter(F.col("refs") <= total // hot), _KEY).select("row", "id", "at", "first"))
    return found[0].unionByName(found[1]).filter(~F.struct("id").eqNullSafe(F.col("first"))).select("row", "at")


def _without(text: Column, places: Column) -> Column:
    """Struct of ``n`` lines, ``n_dropped`` and the ``kept`` text as bytes."""

    @F.arrow_udf("n bigint, n_dropped bigint, kept binary")
    def of(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for value, places in zip(texts, lists, strict=True):
            data, gone = value.as_py(), places.as_py()
            if gone:
                lines = data.split(b"\n")
                dropped = set(gone)
                out.append((len(lines), len(dropped), b"\n".join([line for k, line in enumerate(lines) if k not in dropped])))
            else:
                out.append((data.count(b"\n") + 1, 0, data))
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["n", "n_dropped", "kept"])

    return of(utf8(text), places)


def without_repeats(index: LineIndex, rows: DataFrame, batch: DataFrame, text: str) -> DataFrame:
    """``doc`` and ``cut`` of keyed ``rows`` whose postings are ``batch``, as the index stands now."""
    lists = repeated_places(index, batch).groupBy("row").agg(F.flatten(F.collect_list("at")).alias("places"))
    joined = rows.join(lists, "row", "left").select("doc", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    return joined.select("doc", _without(F.col(f"doc.`{text}`"), F.col("places")).alias("cut"))


def add_documents(
    index: LineIndex | None, docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST, shard_keys: int = SHARD_KEYS
) -> tuple[LineIndex, DataFrame]:
    """The index with the documents, and the documents without their repeated lines: ``doc`` (the input row) and ``cut``: ``n`` lines,
    ``n_dropped``, the ``kept`` text as bytes.

    A line is dropped if its key has ``least`` code points or more and stands in a document with a smaller id (a null id
    is the smallest). Rows with one id are one document: they do not repeat each other. Null and empty texts are one
    empty line, which stays. A text that loses all lines becomes empty. An empty table gives no rows.
    """
    python_workers(docs.sparkSession)
    rows = keyed(docs, "documents")
    batch = postings(rows, text, id, least)
    index = insert(index, batch, shard_keys)
    return index, without_repeats(index, rows, batch, text)


def documents_now(index: LineIndex, docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Documents as the index stands now, without adding them: after a deletion their lines may have come back."""
    python_workers(docs.sparkSession)
    rows = keyed(docs, "documents")
    return without_repeats(index, rows, postings(rows, text, id, least), text)


def remove_repeated_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """:func:`add_documents` to an empty index, for one table as a whole."""
    return add_documents(None, docs, text, id, least)[1]
