"""Vector code compression with per-dimension value dictionaries.

Vectors become whole numbers, are cut into parts, and each part is written as the index of its nearest codebook entry.
The rows are stored once in *blocks*: for every dimension the block holds the dictionary of the distinct numbers that occur
there and, for every row, the index into it. A pass over a block tabulates, for each dimension, the squared differences of
all dictionary numbers to all entries; the distances of a part are then gathers from these tables and additions.

A pass of the codebook's refinement gives one row of sums and counts for each entry and task; they are added up in
whole numbers, so the codebooks do not depend on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DecimalType, IntegerType, StructField, StructType

from pagegrain.llm.common import python_workers, save, whole

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Numbers in a block, and its rows at most (indexes have 16 bits).
_CELLS = 1 << 21
_ROWS = 1 << 16
_CHUNK = 2048  # rows whose distances are held at a time
# From here on doubles have no fractions and squares soon leave 64 bits; such components count as infinite.
_LARGEST = float(1 << 52)
_WIDE = DecimalType(38, 0)


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part, as lists of whole numbers."""

    entries: list[list[list[int]]]

    def numbers(self) -> list[int]:
        """All numbers by part, entry and place within the part."""
        return [number for part in self.entries for entry in part for number in entry]


def _kind(bound: int):
    """The smallest type of whole numbers that holds sums up to a bound; beyond 64 bits Python's own."""
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def _block(numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionaries of a block's dimensions, and the index of every number (one row per dimension)."""
    found = [np.unique(column, return_inverse=True) for column in numbers.T]
    indexes = np.array([index for _, index in found], np.uint16).reshape(numbers.shape[1], len(numbers))
    return [values for values, _ in found], indexes


def nearest_entries(values: list[np.ndarray], indexes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a part the nearest entry (the first of equal ones) and its squared distance."""
    ends = [max(abs(int(v[k]) - int(e)) for k in (0, -1) for e in (book[:, j].min(), book[:, j].max())) for j, v in enumerate(values)]
    kind = _kind(sum(end * end for end in ends))
    tables = []
    for j, known in enumerate(values):
        apart = known[:, None].astype(kind) - book[None, :, j].astype(kind)
        tables.append(apart * apart)
    rows = indexes.shape[1]
    chosen, apart = np.empty(rows, np.int64), np.empty(rows, object if kind is object else np.int64)
    for at in range(0, rows, _CHUNK):
        total = tables[0][indexes[0, at : at + _CHUNK]]
        for table, index in zip(tables[1:], indexes[1:], strict=True):
            total += table[index[at : at + _CHUNK]]
        best = total.argmin(axis=1)
        chosen[at : at + _CHUNK] = best
        apart[at : at + _CHUNK] = total[np.arange(len(best)), best]
    return chosen, apart


def _sums(values: list[np.ndarray], indexes: np.ndarray, chosen: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each entry, and their sums in every dimension (whole numbers of any size)."""
    counts = np.bincount(chosen, minlength=entries)
    order = np.argsort(chosen, kind="stable")
    used = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[used]
    sums = np.zeros((entries, len(values)), object)
    for j, known in enumerate(values):
        kind = _kind(max(abs(int(known[0])), abs(int(known[-1]))) * len(order))
        sums[used, j] = np.add.reduceat(known.astype(np.int64 if kind is np.int32 else kind)[indexes[j, order]], starts)
    return counts, sums


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    for k in range(batch.num_rows):
        values = [np.array(v, np.int64) for v in batch.column("values")[k].as_py()]
        indexes = np.frombuffer(batch.column("indexes")[k].as_buffer(), "<u2").reshape(len(values), -1)
        yield k, values, indexes


def _write_blocks(schema: pa.Schema) -> Callable:
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["numbers"].combine_chunks()
        numbers = lists.flatten().to_numpy().reshape(len(lists), -1)
        values, indexes = _block(numbers)
        docs = table["doc"].combine_chunks()
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([[v.tolist() for v in values]]), pa.array([indexes.astype("<u2").tobytes()])]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, _ROWS
        for batch in batches:
            if batch.num_rows:
                most = min(_ROWS, max(1, _CELLS // len(batch.column("numbers")[0])))
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if rows + part.num_rows > most:
                    yield block(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield block(held)

    return of


def _part_slices(size: int, parts: int) -> list[slice]:
    width = size // parts
    return [slice(p * width, (p + 1) * width) for p in range(parts)]


def _refined(blocks: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Every entry replaced by the rounded-down mean of the parts nearest to it; unused entries stay."""
    places, width = _part_slices(size, len(books)), size // len(books)
    schema = StructType.fromDDL("part int, entry int, n bigint").add(StructField("sums", ArrayType(_WIDE)))
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(len(book), np.int64), np.zeros((len(book), width), object)) for book in books]
        for batch in batches:
            for _, values, indexes in _unpacked(batch):
                for book, place, (counts, sums) in zip(books, places, totals, strict=True):
                    own, at = values[place], indexes[place]
                    n, added = _sums(own, at, nearest_entries(own, at, book)[0], len(book))
                    counts += n
                    sums += added
        for part, (counts, sums) in enumerate(totals):
            used = np.flatnonzero(counts)
            rows = [[Decimal(int(v)) for v in sums[k]] for k in used]
            arrays = [np.full(len(used), part), used, counts[used], rows]
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    partial = blocks.select("values", "indexes").mapInArrow(of, schema)
    sums = [F.sum(F.col("sums")[k]) for k in range(width)]
    books = [book.copy() for book in books]
    # one row for each entry of each part
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect():
        books[row["part"]][row["entry"]] = [int(total) // row["n"] for total in row["sums"]]
    return books


def compress(
    vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """The coded rows and the codebooks: ``doc`` (the input row), ``codes`` (an entry's index for each part) and ``error`` (squared
    distance to those entries, ``decimal(38,0)``).

    A component ``x`` counts as ``floor(scale * x)``. Null vectors and those with null or non-finite components give no row;
    components of ``2^52 / scale`` and more count as non-finite. Vectors have the length of the one with the smallest id; others, and
    lengths that ``parts`` does not divide, give no row. The codebooks start with the ``entries`` smallest ids (null last; of
    equal ids the smaller vector first; fewer rows make shorter codebooks). Repeated rows count each by itself. An empty table gives no rows
    and empty codebooks.
    """
    python_workers(vectors.sparkSession)
    v = F.col(f"doc.`{vector}`").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(_LARGEST)))
    rows = whole(vectors).filter(v.isNotNull() & usable & (F.size(v) > 0) & (F.size(v) % parts == 0))
    rows = rows.select("doc", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("numbers"))
    first = [F.asc_nulls_last(F.col(f"doc.`{id}`")), F.asc("numbers")]
    least = rows.orderBy(*first).select(F.size("numbers").alias("size")).first()
    if least is None:
        coded = rows.select("doc", F.array().cast("array<int>").alias("codes"), F.lit(0).cast(_WIDE).alias("error"))
        return coded, Codebooks([[] for _ in range(parts)])
    size = least["size"]
    rows = rows.filter(F.size("numbers") == size)
    seeds = np.array([r["numbers"] for r in rows.orderBy(*first).limit(entries).select("numbers").collect()], np.int64)
    books = [seeds[:, place] for place in _part_slices(size, parts)]
    doc = rows.schema["doc"]
    schema = StructType.fromDDL("values array<array<bigint>>, indexes binary")
    schema = StructType([StructField("docs", ArrayType(doc.dataType)), *schema])
    blocks = save(rows.mapInArrow(_write_blocks(to_arrow_schema(schema)), schema), "vector-blocks")
    for _ in range(rounds):
        books = _refined(blocks, books, size)
    coded = save(_coded(blocks, books, size, doc), "vector-codes")
    return coded, Codebooks([book.tolist() for book in books])


def _coded(blocks: DataFrame, books: list[np.ndarray], size: int, doc: StructField) -> DataFrame:
    places = _part_slices(size, len(books))
    schema = StructType([doc, StructField("codes", ArrayType(IntegerType())), StructField("error", _WIDE)])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, values, indexes in _unpacked(batch):
                found = [nearest_entries(values[place], indexes[place], book) for book, place in zip(books, places, strict=True)]
                codes = np.stack([chosen for chosen, _ in found], axis=1)
                error = sum(apart.astype(object) for _, apart in found)
                arrays = [batch.column("docs")[k].values, codes.tolist(), [Decimal(int(e)) for e in error]]
                arrays = [arrays[0], *[pa.array(a, f.type) for a, f in zip(arrays[1:], list(arrow)[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([arrow[0].with_type(arrays[0].type), *list(arrow)[1:]]))

    return blocks.mapInArrow(of, schema)
