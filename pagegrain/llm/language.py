"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. An n-gram binds the vectors of its letters, each
permuted by its place; a text bundles (adds) the vectors of its n-grams. A language's prototype bundles the texts of its
training rows, each at length one, and a text gets the language whose prototype has the largest cosine.

Texts are lower-cased; everything but letters is one space. The n-grams of a batch are counted in one pass, and
the counts of all its texts are multiplied with the matrix of its n-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import python_workers, whole

DIMENSIONS = 1024
GRAM = 3
SEED = 17
# Texts are added up at this length in whole numbers, so that sums do not depend on their order.
SCALE = 1 << 20
_TEXTS = 128  # texts per matrix product


@lru_cache(maxsize=4096)
def _letter(code: int, dimensions: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, dimensions) * 2 - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """One row for each n-gram of code points: its letters' vectors, rolled by their place, multiplied."""
    found = np.ones((len(grams), dimensions), np.float32)
    for place in range(grams.shape[1]):
        codes, index = np.unique(grams[:, place], return_inverse=True)
        letters = np.stack([np.roll(_letter(int(c), dimensions), grams.shape[1] - 1 - place) for c in codes])
        found *= letters[index]
    return found


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local letter numbers of all texts (0: a space before, between and after words), text numbers, code points."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    codes = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    present = np.flatnonzero(np.bincount(codes))
    letters = [c for c in present.tolist() if chr(c).isalpha()]
    table = np.zeros(int(present[-1]) + 1, np.int64)
    table[letters] = np.arange(1, len(letters) + 1)
    symbols = table[codes]
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    return symbols[kept], owner[kept], np.array([32, *letters], np.int64)


def bundles(texts: list[str], dimensions: int) -> np.ndarray:
    """The vector of each text, zero without letters."""
    found = np.zeros((len(texts), dimensions), np.float64)
    if not texts:
        return found
    symbols, owner, codes = _symbols(texts)
    base, size = len(codes), len(symbols) - GRAM + 1
    same = owner[:size] == owner[GRAM - 1 :]
    packed = symbols[:size].copy()
    for place in range(1, GRAM):
        packed = packed * base + symbols[place : place + size]
    # a text without letters leaves two spaces at most, which make no n-gram
    packed, owner = packed[same], owner[:size][same]
    if not len(packed):
        return found
    if base**GRAM <= 1 << 22:
        used = np.flatnonzero(np.bincount(packed, minlength=base**GRAM))
        number = np.zeros(base**GRAM, np.int64)
        number[used] = np.arange(len(used))
        index = number[packed]
    else:
        used, index = np.unique(packed, return_inverse=True)
    grams = np.stack([codes[used // base ** (GRAM - 1 - place) % base] for place in range(GRAM)], axis=1)
    edges = np.searchsorted(owner, np.arange(0, len(texts) + _TEXTS, _TEXTS))
    vectors = gram_vectors(grams, dimensions) if len(used) * dimensions <= 1 << 26 else None
    for block, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b:
            continue
        first = block * _TEXTS
        rows = min(_TEXTS, len(texts) - first)
        if vectors is None:  # very many different n-grams: only those of the block
            own, local = np.unique(index[a:b], return_inverse=True)
            matrix = gram_vectors(grams[own], dimensions)
        else:
            local, matrix = index[a:b], vectors
        counts = np.bincount((owner[a:b] - first) * len(matrix) + local, minlength=rows * len(matrix))
        found[first : first + rows] = counts.reshape(rows, -1).astype(np.float32) @ matrix
    return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def prototypes(docs: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors, from all rows with text and label.

    What reaches the driver is one vector for each label, whatever the number of rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("lang").to_pylist()
            scaled = np.rint(_unit(bundles(batch.column("text").to_pylist(), dimensions)) * SCALE).astype(np.int64)
            for label in set(labels):
                own = scaled[[k for k, other in enumerate(labels) if other == label]].sum(0)
                sums[label] = sums.get(label, 0) + own
        for label, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([label] * dimensions), "at": pa.array(range(dimensions), pa.int32()), "v": pa.array(total)})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(partial, "lang string, at int, v bigint").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for label, values in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("values")).collect():
        found[label] = np.array([v for _, v in values], np.float64)
    names = sorted(found)
    return names, _unit(np.stack([found[n] for n in names])) if names else np.zeros((0, dimensions))


def predict(text: Column, names: list[str], matrix: np.ndarray) -> Column:
    """Struct of ``lang`` and ``score``, the cosine from 0 to 1; ``und`` and 0 without letters or without any prototype."""
    dimensions = matrix.shape[1]

    @F.arrow_udf("lang string, score double")
    def of(texts: pa.Array) -> pa.Array:
        vectors = _unit(bundles([t if t is not None else "" for t in texts.to_pylist()], dimensions))
        langs, scores = ["und"] * len(vectors), np.zeros(len(vectors))
        if names:
            cosines = vectors @ matrix.T
            best, known = cosines.argmax(1), np.abs(vectors).sum(1) > 0
            scores = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
            langs = [names[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return of(text)


def identify(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc`` (the input row), ``lang_pred`` and ``score``; learned from the rows where ``train`` holds (default: all).

    Rows with null text or label teach nothing; null and letterless texts are ``und`` with score 0, and so is every
    text if nothing can be learned; the first of equally near languages in alphabetical order wins. An empty table gives no rows.
    """
    python_workers(docs.sparkSession)
    names, matrix = prototypes(docs if train is None else docs.filter(train), text, lang)
    found = whole(docs).withColumn("found", predict(F.col(f"doc.`{text}`"), names, matrix))
    return found.select("doc", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
