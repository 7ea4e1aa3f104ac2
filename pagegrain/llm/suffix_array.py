"""Suffix-array dedup: a depth-limited most-significant-digit radix sort of all suffixes.

The suffixes of all texts are told apart only through the threshold: the first pass separates them by their first digit
(a gram of half the threshold), each further pass by a longer one, the last by the threshold itself. A suffix alone in
its group leaves; groups equal through the threshold are exactly the repeated strings. Neighbouring suffixes that agree
on a digit travel as one run (see ``repeats``), so that a pass moves about one row for each hundred suffixes.

Digits are compared by 96-bit digests of the bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import keyed, python_workers, step_tables
from pagegrain.llm.repeats import Bytes, Words, covered, lengths, without
from pagegrain.llm.substring import levels

THRESHOLD = 400


def depths(threshold: int) -> tuple[int, ...]:
    """Depths of the passes: half, nine tenths, all of the threshold."""
    return tuple(sorted({max(1, threshold // 2), max(1, threshold * 9 // 10), threshold}))


def remove_repeated_strings(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, words: int | None = None) -> DataFrame:
    """``doc`` (the input row) and ``cut``: ``n`` bytes, ``n_removed``, ``n_spans``, the ``kept`` bytes.

    A byte is removed if a string of ``threshold`` bytes over it also starts elsewhere, in any row, itself included.
    Null texts are empty; shorter texts stay whole; repeated rows repeat each other; an empty table gives no rows. Cuts
    can fall inside a character; ``kept`` holds bytes, not text.

    With ``words``, also ``n_passage_words``: how many words between ASCII white space lie in windows of so many that also start
    elsewhere. Such passages can have fewer bytes than the threshold; they are counted, and not removed for it.
    """
    spark = docs.sparkSession
    python_workers(spark)
    rows, column = keyed(docs, "texts"), F.col(f"doc.`{text}`")
    with step_tables(spark):
        spans = covered(rows, column, F.col("row"), Bytes, threshold, depths(threshold), earliest=False)
    if words:
        with step_tables(spark):
            windows = covered(rows, column, F.col("row"), Words, words, levels(words), earliest=False)
        counts = lengths(windows).withColumnRenamed("n", "n_passage_words")
        rows = rows.join(counts, "row", "left").fillna(0, "n_passage_words")
    return without(rows, spans, text, Bytes)
