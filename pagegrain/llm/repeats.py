"""Equal windows of a fixed length, by passes that compare them to a growing depth.

A window is ``length`` consecutive units (bytes or words). A pass of depth ``gram`` takes from every window its gram of
that many units with the smallest hash (the leftmost of equal ones); neighbouring windows mostly share it, so they form
one *run*, a row with the gram's hash and a 96-bit digest of all units that its windows cover. Equal windows have equal
grams, so:

* a run whose gram occurs once in the pass has no repeated window and leaves;
* runs with equal digests are equal window by window, and their windows are settled at once;
* one run of each digest stays open if its gram has other digests too; only the covered units of open runs are read
  by the next, deeper pass. At the full depth a run is one window, and nothing stays open.

Rows per pass follow the number of runs, not of positions, and only counts and joins on hashes are shuffled, so a passage
shared by a third of all texts is spread by map-side counts and split joins, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.llm.common import BATCH_BYTES, save, utf8

_POSITION = 20  # bits of a position within a block
_BLOCK = 1 << (_POSITION - 1)
_GROUP = 1 << 17  # bytes of texts that are worked on together
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64; the table grows with the largest block seen."""
    known = _powers.get(base)
    if known is None or len(known) < size:
        known = np.empty(1 << max(_POSITION, (size - 1).bit_length()), np.uint64)
        known[0], filled = 1, 1
        while filled < len(known):
            known[filled : 2 * filled] = known[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _powers[base] = known
    return known[:size]


def _mix(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def _between(values: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hashes of the ranges [start, end), equal for equal content wherever it stands."""
    size = len(values)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(values * _power(_BASE, size), out=sums[1:])
    found = sums[ends] - sums[starts]
    return _mix(found * _power(pow(_BASE, -1, 1 << 64), size + 1)[starts][: len(found)])


class Bytes:
    """Units of some texts, one after another: bytes."""

    def __init__(self, texts: list[bytes]):
        self.line = texts[0] if len(texts) == 1 else b"".join(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))

    def values(self) -> np.ndarray:
        return _VALUES[np.frombuffer(self.line, np.uint8)]

    def offsets(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return starts, ends

    def kept(self, removed: np.ndarray) -> bytes:
        return np.frombuffer(self.line, np.uint8)[~removed].tobytes()


class Words:
    """Units are words between ASCII white space; the line has them with one space in between."""

    def __init__(self, texts: list[bytes]):
        parts = [text.split() for text in texts]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.words = parts[0] if len(parts) == 1 else [word for part in parts for word in part]
        self.line = b" ".join(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def values(self) -> np.ndarray:
        size, data = len(self.words), np.frombuffer(self.line, np.uint8)
        found, at = np.empty(size, np.uint64), 0
        while at < size:
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.starts, base + _BLOCK)))
            found[at:to] = _between(_VALUES[data[base : self.ends[to - 1]]], self.starts[at:to] - base, self.ends[at:to] - base)
            at = to
        return found

    def offsets(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[starts], self.ends[ends - 1]

    def kept(self, removed: np.ndarray) -> bytes:
        return b" ".join([word for word, gone in zip(self.words, removed.tolist(), strict=True) if not gone])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    size = len(values) - width + 1
    filled = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    behind = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:size], ahead[width - 1 : width - 1 + size])


def runs(values: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, first unit, number of windows and gram hash of each run, block by block; no window leaves its text."""
    bounds, windows = np.cumsum(sizes), len(values) - length + 1
    for at in range(0, windows, _BLOCK):
        part = values[at : min(at + _BLOCK, windows) + length - 1]
        hashes = _between(part, slice(0, len(part) - gram + 1), slice(gram, None))
        begins = np.arange(at, at + len(part) - length + 1)
        owner = np.searchsorted(bounds, begins, side="right")
        inside = begins + length <= bounds[owner]
        if gram == length:
            first, counts, found = inside, None, hashes >> np.uint64(_POSITION)
        else:
            low = np.uint64((1 << _POSITION) - 1)
            least = _least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
            first = inside.copy()
            first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
            counts, found = np.bincount((np.cumsum(first) - 1)[inside]), least >> np.uint64(_POSITION)
        starts = begins[first]
        yield owner[first], starts, np.ones(len(starts), np.int64) if counts is None else counts, found[first]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of a batch of together about a group's bytes, with the number of the first."""
    first, texts, held = 0, [], 0
    for k, text in enumerate(batch.column("text")):
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= _GROUP:
            yield first, texts
            first, texts, held = k + 1, [], 0
    if texts:
        yield first, texts


def _run_rows(unit: type, length: int, gram: int, schema: pa.Schema):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            base = batch.column("base").to_numpy()
            for at, texts in _groups(batch):
                units = unit(texts)
                befores = np.cumsum(units.sizes) - units.sizes
                for owner, starts, n, hashes in runs(units.values(), units.sizes, length, gram):
                    a, b = units.offsets(starts, starts + n - 1 + length)
                    line = units.line
                    raw = b"".join([digest(line[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    digests = np.frombuffer(raw, "<i4").reshape(-1, 4)
                    rows = owner + at
                    taken = [batch.column(name).take(pa.array(rows)) for name in ("row", "id")]
                    own = base[rows]
                    arrays = [*taken, pa.array(own), pa.array((own + starts - befores[owner]).astype(np.int32)), pa.array(n.astype(np.int32)),
                              pa.array(hashes.view(np.int64)), pa.array(np.ascontiguousarray(digests[:, :2]).view("<i8")[:, 0]),
                              pa.array(np.ascontiguousarray(digests[:, 2]))]
                    if len(starts):
                        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    return of


def _slices(unit: type, length: int, schema: pa.Schema):
    """The units that open runs cover."""

    def table(owners: list[int], starts: list[int], texts: list[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [batch.column(name).take(pa.array(owners, pa.int64())) for name in ("row", "id")]
        arrays += [pa.array(starts, pa.int32()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, starts, texts, held = [], [], [], 0
            for k, (base, lo, n) in enumerate(zip(batch.column("base").to_numpy(), *_lists(batch.column("spans"), "lo", "n"), strict=True)):
                units = unit([batch.column("text")[k].as_py()])
                a, b = units.offsets(lo - base, lo - base + n - 1 + length)
                owners += [k] * len(lo)
                starts += lo.tolist()
                texts += [units.line[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                held += int((b - a).sum())
                if held > BATCH_BYTES:
                    yield table(owners, starts, texts, batch)
                    owners, starts, texts, held = [], [], [], 0
            if owners:
                yield table(owners, starts, texts, batch)

    return of


def _lists(column: pa.Array, *names: str) -> list[list[np.ndarray]]:
    """The numbers of each row's list of structs, by field."""
    edges = column.offsets.to_numpy()
    fields = [column.values.field(name).to_numpy().astype(np.int64) for name in names]
    return [[field[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)] for field in fields]


def _arrow(ddl: str, spark) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def covered(docs: DataFrame, text: Column, order: Column, unit: type, length: int, depths: tuple[int, ...], earliest: bool) -> DataFrame:
    """(row, a, b): unit ranges that lie in repeated windows. ``docs`` has a stable unique ``row``.

    With ``earliest`` the first window of equal ones, by ``order``, row and start, is left out; else all count.
    """
    spark = docs.sparkSession
    source = docs.select("row", order.alias("id"), F.lit(0).alias("base"), utf8(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    run_ddl, run_schema = _arrow(f"row bigint, id {kind}, base int, lo int, n int, gram bigint, s1 bigint, s2 int", spark)
    span_ddl, span_schema = _arrow(f"row bigint, id {kind}, base int, text binary", spark)
    settled = []
    for depth in depths:
        found = save(source.mapInArrow(_run_rows(unit, length, depth, run_schema), run_ddl), f"runs-{depth}")
        # a table of its own, so that the join can split a gram that very many rows share
        shared = save(found.groupBy("gram").count().filter("count > 1").select("gram"), f"grams-{depth}")
        tied = save(found.join(shared, "gram", "left_semi"), f"tied-{depth}")
        first = F.min(F.struct("id", "row", "lo", "base")).alias("first")
        classes = save(tied.groupBy("s1", "s2").agg(F.count("*").alias("equal"), first, F.min("n").alias("n"), F.min("gram").alias("gram")),
                       f"classes-{depth}")
        repeated = classes.filter("equal > 1").select("s1", "s2", F.col("first.row").alias("r"), F.col("first.lo").alias("l"))
        again = tied.join(repeated, ["s1", "s2"])
        if earliest:
            again = again.filter("row <> r OR lo <> l")
        settled.append(again.select("row", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).alias("b")))
        if depth == depths[-1]:
            break
        several = save(classes.groupBy("gram").count().filter("count > 1").select("gram"), f"several-{depth}")
        opened = classes.join(several, "gram", "left_semi").select("first.row", "first.base", "first.lo", "n")
        spans = opened.groupBy("row", "base").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
        source = save(source.join(spans, ["row", "base"]).select("row", "id", "base", "text", "spans")
                      .mapInArrow(_slices(unit, length, span_schema), span_ddl), f"open-{depth}")
    return save(_union(settled), "covered")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def cut(text: Column, spans: Column, unit: type, readable: bool = False) -> Column:
    """Struct of ``n`` units, ``n_removed``, ``n_spans`` (maximal removed ranges) and the ``kept`` bytes; if ``readable``, kept
    as text without the rests of characters that a cut went through."""
    # decoded here, as a function of its own would be a second Python worker beside each task's first
    kind = "string" if readable else "binary"

    @F.arrow_udf(f"n bigint, n_removed bigint, n_spans bigint, kept {kind}")
    def of(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for value, a, b in zip(texts, *_lists(ranges, "a", "b"), strict=True):
            units = unit([value.as_py()])
            size = int(units.sizes[0])
            if not len(a):
                out.append((size, 0, 0, units.line))
                continue
            steps = np.bincount(a, minlength=size + 1) - np.bincount(b, minlength=size + 1)
            removed = np.cumsum(steps)[:size] > 0
            begins = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
            out.append((size, int(removed.sum()), begins, units.kept(removed)))
        if readable:
            out = [(*counts, bytes(kept).decode("utf-8", "ignore")) for *counts, kept in out]
        names = ("n", "n_removed", "n_spans", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if readable else pa.binary())
        arrays = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(arrays, names=list(names))

    return of(utf8(text), spans)


def lengths(spans: DataFrame) -> DataFrame:
    """(row, n): the units in any of a row's ranges, each counted once."""
    before = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0)))
    return spans.select("row", F.greatest(fresh, F.lit(0)).alias("n")).groupBy("row").agg(F.sum("n").alias("n"))


def without(docs: DataFrame, spans: DataFrame, text: str, unit: type, readable: bool = False) -> DataFrame:
    """``doc``, any other columns and the struct ``cut`` for every row of ``docs``."""
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    others = [name for name in docs.columns if name not in ("row", "doc")]
    joined = docs.join(lists, "row", "left").select("row", "doc", *others, F.coalesce("spans", none).alias("spans"))
    return joined.select("doc", cut(F.col(f"doc.`{text}`"), F.col("spans"), unit, readable).alias("cut"), *others)
