"""Token ids of texts, and files of frequency-ranked ids in byte-aligned variable-length coding.

Tokenizing. Texts are split at ASCII white space, which no token crosses, and every different word is encoded once by the
tokenizer library; a text's ids are those of its words. Words that a worker has met stay in a bounded cache. For files, ids of
16 bits are kept where the vocabulary allows it, and counted by the tasks that make them.

Files. Ids are replaced by their rank in the corpus (the most frequent is 0) and written as one to four bytes each; the
lengths, two bits each, stand apart in control bytes. A table row is a block of whole documents: their ids, their
lengths, control bytes and data bytes, a document's starting with a control byte of its own. Blocks are numbered within parts, and parts are ranges of document ids. Decoding
looks the four lengths of a control byte up in a table and gathers bytes with numpy.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.models import BPE

from pagegrain.llm.common import python_workers, save

END = 1
# Ids in a block, beyond which it is closed; a longer document is a block of its own.
BLOCK = 1 << 18
# Words, and parts of words, that a worker remembers; beyond, all are forgotten.
_CACHE = 250_000
# Bytes of texts that are tokenized together.
_GROUP = 8 << 20

# How the tokenizer of word_bpe_49k.json parts a text after lower-casing; fixed values of that file.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters for which case and normal form need no context; others go to the tokenizer as they are.
_PLAIN = re.compile("[!-;=-~¡-įı-ňŊ-ž]+")


def _plain_parts() -> re.Pattern:
    """The parts of plain characters, and single spaces. Letters and numbers are written out."""
    letters, numbers = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind) for kind in "LN")
    return re.compile(_PARTS.replace(r"\p{L}", letters).replace(r"\p{N}", numbers) + "| ")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    return Tokenizer.from_file(path)


def _byte_signs() -> str:
    """The characters that byte-level models use for the 256 bytes: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in plain)}
    return "".join(chr(moved.get(byte, byte)) for byte in range(256))


class _Lists:
    """Numbered lists of ids by name, one after another in ``flat``."""

    def __init__(self, name: str, ids: list[int]):
        self.numbers = {name: 0}
        self.flat, self.lengths, self.firsts = np.array(ids, np.uint32), np.array([len(ids)]), np.zeros(1, np.int64)

    def add(self, names: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.numbers.update(zip(names, range(len(self.numbers), len(self.numbers) + len(names)), strict=True))
        self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
        self.firsts = np.cumsum(self.lengths) - self.lengths

    def places(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, names), np.int32, len(names))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some lists one after another, and where each list stops."""
        each = self.lengths[places]
        stops = np.cumsum(each)
        return self.flat[np.arange(int(each.sum())) + np.repeat(self.firsts[places] - (stops - each), each)], stops


class Encoder:
    """Ids of whole texts by one call of the tokenizer for each different word."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        # the narrowest type that holds every id
        self.kind = "<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"
        self.signs = _byte_signs()
        # Parts of words go to the model by themselves only where the parting is known to be the one above.
        split = [part.get("pattern", {}).get("Regex") for part in json.loads(self.tokenizer.pre_tokenizer.__getstate__()).get("pretokenizers", [])]
        self.parts = _plain_parts() if _PARTS in split and isinstance(self.tokenizer.model, BPE) else None
        self.model = self.tokenizer.model
        # no word and no part is a space; it stands for the end of a text and for the end of a word
        self.known, self.pieces = _Lists(" ", [END]), _Lists(" ", [])

    def _learn(self, words: list[str]) -> None:
        """Adds words that are not known yet; those that may be parted here are parted by one search through all of them."""
        plain = list(filter(_PLAIN.fullmatch, words)) if self.parts is not None else []
        if plain:
            parts = self.parts.findall(" ".join([*plain, ""]).lower())
            new = list(set(parts).difference(self.pieces.numbers))
            if new:
                # the table of signs is indexed by byte
                signs = " ".join(new).encode().decode("latin-1").translate(self.signs).split(self.signs[32])
                self._add(self.pieces, new, [[t.id for t in found] for found in map(self.model.tokenize, signs)])
            places = self.pieces.places(parts)
            ids, stops = self.pieces.of(places)
            self.known.add(plain, np.diff(stops[places == 0], prepend=0), ids)
        if len(plain) < len(words):
            others = [word for word in words if word not in self.known.numbers]
            self._add(self.known, others, [self.tokenizer.encode(word, add_special_tokens=False).ids for word in others])

    @staticmethod
    def _add(lists: _Lists, names: list[str], ids: list[list[int]]) -> None:
        lists.add(names, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another with the end id after each text, and the number of ids of each text."""
        words = pc.ascii_split_whitespace(texts)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = words.flatten().dictionary_encode()
        if len(self.known.numbers) > _CACHE:
            self.known = _Lists(" ", [END])
        if len(self.pieces.numbers) > _CACHE:
            self.pieces = _Lists(" ", [])
        found = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [word for word in found if word not in self.known.numbers]
        if new:
            self._learn(new)
        # the words of each text, then its end
        order = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = self.known.places(found)[named.indices.to_numpy(zero_copy_only=False)]
        ids, stops = self.known.of(order)
        return ids, np.diff(stops[ends], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binaries(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Some bytes as one value for each stop, without copies."""
    edges = np.concatenate([[0], stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one of about a group's bytes, so that a word is looked up once for more text."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= _GROUP:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_COUNTS = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))


def _tokenize(tokenizer: str, narrow: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total, kind = encoder(tokenizer), np.zeros(0, np.int64), pa.null()
        names = ["row", "id", "n", "ids", "counts"] if narrow else ["row", "id", "n", "ids"]
        for batch in _groups(batches):
            ids, sizes = coder(pc.fill_null(batch.column("text"), ""))
            ids, kind = ids.astype(coder.kind if narrow else "<u4"), batch.column("id").type
            data = binaries(ids, np.cumsum(sizes) * ids.itemsize)
            columns = [batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()), data]
            if narrow:
                columns.append(pa.nulls(len(sizes), _COUNTS))
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if len(total):
            used = np.flatnonzero(total)
            counts = pa.StructArray.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])
            last = [pa.nulls(1, t) for t in (pa.int64(), kind, pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*last, pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), counts).cast(_COUNTS)], names=names)

    return of


def _encoded(docs: DataFrame, tokenizer: str, text: str, id: str, narrow: bool) -> DataFrame:
    python_workers(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    types = {"row": LongType(), "id": rows.schema["id"].dataType, "n": LongType(), "ids": BinaryType()}
    if narrow:
        types["counts"] = ArrayType(StructType([StructField("token", LongType()), StructField("n", LongType())]))
    schema = StructType([StructField(name, kind) for name, kind in types.items()])
    return save(rows.mapInArrow(_tokenize(tokenizer, narrow), schema), "tokens")


def tokenized(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(row, id, n, ids), written once: ``ids`` are little-endian unsigned 32-bit, the end id included, ``n`` their number; null is empty."""
    return _encoded(docs, tokenizer, text, id, False)


def counted(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """As ``tokenized`` with ids of 16 bits if the vocabulary allows it, and (token, n) over all rows; the tokens are counted by the tasks that
    make them, so the second has at most one row for each id of the vocabulary."""
    found = _encoded(docs, tokenizer, text, id, True)
    counts = found.filter("counts IS NOT NULL").select(F.inline("counts"))
    return found.filter("counts IS NULL").drop("counts"), counts.groupBy("token").agg(F.sum("n").alias("n"))


# --- files ---------------------------------------------------------------------------------------------------------

# One less than the lengths of the four values of a control byte.
_LENGTHS = np.array([[c >> (2 * k) & 3 for k in range(4)] for c in range(256)], np.uint8)


def _slots(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's place among the lengths of the control bytes, four to a byte, and the number of places."""
    slots = -(-sizes // 4) * 4
    ahead = np.cumsum(slots) - slots - (np.cumsum(sizes) - sizes)
    return np.arange(int(sizes.sum())) + np.repeat(ahead, sizes), int(slots.sum())


def _used(codes: np.ndarray, width: int) -> np.ndarray:
    """Which of the first bytes of each value are written."""
    used = np.empty((len(codes), width), bool)
    for k in range(width):
        used[:, k] = codes >= k
    return used


def pack(values: np.ndarray, sizes: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """Control and data bytes of some arrays of unsigned 32-bit values that stand one after another; without sizes of one array."""
    sizes = np.array([len(values)]) if sizes is None else sizes
    lengths = (values > 0xFF).astype(np.uint8)
    width = 4 if len(values) and values.max() > 0xFFFF else 2
    if width == 4:
        lengths += values > 0xFFFF
        lengths += values > 0xFFFFFF
    places, slots = _slots(sizes)
    codes = np.zeros(slots, np.uint8)
    codes[places] = lengths
    four = codes.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    data = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[_used(lengths, width)]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values of some packed arrays again, one after another: lengths by table lookup, bytes by one masked assignment."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[_slots(sizes)[0]]
    width = 4 if len(lengths) and lengths.max() > 1 else 2
    found = np.zeros((len(lengths), width), np.uint8)
    found[_used(lengths, width)] = np.frombuffer(data, np.uint8)
    return found.reshape(-1).view(f"<u{width}").astype(np.uint32)


def _values(ids: pa.Array, n: pa.Array) -> np.ndarray:
    """The ids of all rows, in the width they are stored in."""
    if not len(ids):
        return np.zeros(0, np.uint32)
    ids = ids.cast(pa.binary())
    edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    width = int(edges[-1] - edges[0]) // pc.sum(n).as_py()
    return np.frombuffer(ids.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(f"<u{width}")


def ranks(vocabulary: DataFrame) -> np.ndarray:
    """Tokens by falling frequency, equal ones by id. Bounded by the tokenizer's vocabulary."""
    rows = vocabulary.orderBy(F.desc("n"), "token").collect()
    return np.array([r["token"] for r in rows], np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", id: str = "doc_id") -> None:
    """Writes ``path/blocks`` and ``path/vocabulary``.

    Documents stand in ascending order of their ids, null ids first, equal ones in a fixed order. An empty table gives
    empty tables; a null or empty text is its end id alone.
    """
    spark = docs.sparkSession
    tokens, vocabulary = counted(docs, tokenizer, text, id)
    save_to(vocabulary, f"{path}/vocabulary")
    order = ranks(spark.read.parquet(f"{path}/vocabulary"))
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    kind = tokens.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held, rows = TaskContext.get().partitionId(), 0, 0, 0, []

        def closed() -> pa.RecordBatch:
            ids, sizes, values = zip(*rows, strict=True)
            ids, sizes = pa.concat_arrays(ids), np.concatenate(sizes)
            control, data = pack(rank_of[np.concatenate(values)], sizes)
            whole = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, a) for a in (ids, pa.array(sizes, pa.int64()))]
            counts = [pa.array([v], t) for v, t in ((part, pa.int32()), (number, pa.int32()), (before, pa.int64()))]
            names = ["part", "block", "before", "ids", "sizes", "control", "data"]
            return pa.RecordBatch.from_arrays([*counts, *lists, pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=names)

        for batch in batches:
            sizes, values, first = batch.column("n").to_numpy(), _values(batch.column("ids"), batch.column("n")), 0
            stops = np.cumsum(sizes)

            def taken(a: int, b: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
                return batch.column("id")[a:b], sizes[a:b], values[stops[a] - sizes[a] : stops[b - 1]]  # noqa: B023

            for k, size in enumerate(sizes.tolist()):
                if held and held + size > BLOCK:
                    if k > first:
                        rows.append(taken(first, k))
                    yield closed()
                    number, before, held, rows, first = number + 1, before + held, 0, [], k
                held += size
            if first < len(sizes):
                rows.append(taken(first, len(sizes)))
        if rows:
            yield closed()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").drop("row")
    ddl = f"part int, block int, before bigint, ids array<{kind}>, sizes array<bigint>, control binary, data binary"
    save_to(ordered.mapInArrow(blocks, ddl), f"{path}/blocks")


def save_to(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n`` and ``ids`` of every document in the files."""
    files = spark.read.parquet(f"{path}/blocks")
    order = ranks(spark.read.parquet(f"{path}/vocabulary"))
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, control, data = (batch.column(c)[k].as_py() for c in ("part", "before", "control", "data"))
                ids, sizes = (batch.column(c)[k].values for c in ("ids", "sizes"))
                each = sizes.to_numpy()
                stops = np.cumsum(each)
                blob = binaries(order[unpack(control, data, each)].astype("<u4"), stops * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(each), part, np.int32)), ids, pa.array(before + stops - each), sizes, blob], names=["part", "id", "local", "n", "ids"]
                )

    rows = files.select("part", "before", "ids", "sizes", "control", "data").mapInArrow(documents, f"part int, id {kind}, local bigint, n bigint, ids binary")
    sizes = files.select("part", F.expr("aggregate(sizes, 0L, (a, b) -> a + b)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    offsets = sizes.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    return rows.join(F.broadcast(offsets), F.col("part") == F.col("p")).select("id", (F.col("offset") + F.col("local")).alias("start"), "n", "ids")
