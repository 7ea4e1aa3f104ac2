"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

A-Z become a-z and every other ASCII byte that is no digit or letter separates words. The automaton holds every window of
ten words of an item, or the whole item if it is shorter. Each text is scanned once; found windows are mapped back to
word numbers and to byte offsets of the original text, as normalisation keeps the length of every word.

Items are collected in blocks of bounded size, each with an automaton of its own; a block is scanned for and released before the
next is collected, so that what the driver and an executor hold does not grow with the benchmark.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import keyed, python_workers, save, utf8

WORDS = 10
# Bytes of item text in one automaton.
BLOCK_BYTES = 4 << 20

_ORDER = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
_ORDER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in _ORDER)

FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"


def normal(text: bytes) -> bytes:
    """The same length, with words in lower case and spaces elsewhere."""
    return text.translate(_ORDER)


def windows(items: list[tuple[str | None, bytes]], words: int) -> dict[str, tuple[int, set[str]]]:
    """Each window with its number of words and the ids of its items."""
    found: dict[str, tuple[int, set[str]]] = {}
    for name, text in items:
        own = normal(text).split()
        size = min(words, len(own))
        for at in range(len(own) - size + 1) if own else ():
            key = (b" " + b" ".join(own[at : at + size]) + b" ").decode("latin-1")
            found.setdefault(key, (size, set()))[1].update([name] if name is not None else [])
    return found


@lru_cache(maxsize=1)
def _automaton(items: tuple, words: int):
    machine, held = ahocorasick.Automaton(), []
    for key, (size, names) in windows(list(items), words).items():
        machine.add_word(key, (size, len(held)))
        held.append(names)
    if held:
        machine.make_automaton()
    return machine if held else None, held


def scan(text: Column, items, words: int) -> Column:
    """What one text has of a block of items (a broadcast of ids and texts)."""

    @F.arrow_udf(FOUND)
    def of(texts: pa.Array) -> pa.Array:
        machine, held = _automaton(items.value, words)
        counts, spans, names = [], [], []
        for value in texts:
            plain = normal(value.as_py())
            own = plain.split()
            counts.append(len(own))
            hits = []
            if machine is not None and own:
                line = b" " + b" ".join(own) + b" "
                hits = list(machine.iter(line.decode("latin-1")))
            if not hits:
                spans.append([])
                names.append([])
                continue
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            last = np.searchsorted(spaces, [end for end, _ in hits]) - 1
            marks = np.zeros(len(own) + 1, np.int64)
            np.add.at(marks, last - np.array([size for _, (size, _) in hits]) + 1, 1)
            np.add.at(marks, last + 1, -1)
            hit = np.concatenate([[0], (np.cumsum(marks)[:-1] > 0).astype(np.int8), [0]])
            a, b = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1) - 1
            letters = np.concatenate([[0], (np.frombuffer(plain, np.uint8) != 32).astype(np.int8), [0]])
            starts, ends = np.flatnonzero(np.diff(letters) == 1), np.flatnonzero(np.diff(letters) == -1)
            spans.append([dict(first=x, last=y, start=s, end=e) for x, y, s, e in zip(a.tolist(), b.tolist(), starts[a].tolist(), ends[b].tolist(), strict=True)])
            names.append(sorted(set().union(*(held[k] for k in {k for _, (_, k) in hits}))))
        kind = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])
        arrays = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(names, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(arrays, names=["n_words", "spans", "items"])

    return of(utf8(text))


def _placed(items: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The items with a block number, in so many blocks of at most about ``size`` bytes each."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 if total <= size else -(-2 * total // size)
    return items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count))), count


def _block(placed: DataFrame, block: int) -> Broadcast:
    """A broadcast of the items of one block."""
    rows = placed.filter(F.col("block") == block).select("id", "text").distinct().orderBy("id", "text")
    return placed.sparkSession.sparkContext.broadcast(tuple((r[0], bytes(r[1])) for r in rows.collect()))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    words: int = WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc`` (the input row), ``n_words``, ``spans`` (maximal hit ranges: first and last word, byte offsets in the
    original text), ``items`` (ids of the items found, as strings, sorted).

    Null and wordless texts and items have no words and hit nothing; items without id hit but are not listed; equal
    items and repeated rows count as they stand; empty tables are fine on either side.
    """
    spark = docs.sparkSession
    python_workers(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), utf8(F.col(item_text)).alias("text"))
    placed, count = _placed(items, block_bytes)
    if count == 1:
        found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        found = found.withColumn("found", scan(F.col(f"doc.`{text}`"), _block(placed, 0), words))
        return found.select("doc", "found.n_words", "found.spans", "found.items")
    rows, parts = keyed(docs, "texts"), None
    for number in range(count):
        block = _block(placed, number)
        part = save(rows.select("row", scan(F.col(f"doc.`{text}`"), block, words).alias("found")), "found")
        block.destroy()
        parts = part if parts is None else parts.union(part)
    merged = parts.groupBy("row").agg(
        F.max("found.n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("found.spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
    )
    return rows.join(merged, "row").select("doc", "n_words", "spans", "items")


def _merged(spans: Column) -> Column:
    """Touching and overlapping ranges as one."""

    def put(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
        )
        joined = (F.size(done) > 0) & (span["first"] <= last["last"] + 1)
        return F.when(joined, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, put)
