"""Repeated passages: the strings of so many bytes, and the windows of so many words, that occur more than once.

Words are short in some texts and long in others, so neither length stands for the other: 400 bytes of short words are
over 60 words, and 51 words of long ones far over 400 bytes. Both are looked for (see ``repeats``), and a byte goes if either covers it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import keyed, measured_joins, python_workers, save, utf8
from pagegrain.llm.repeats import Bytes, Words, covered, without
from pagegrain.llm.substring import levels
from pagegrain.llm.suffix_array import THRESHOLD, depths

# More than 50 words.
WORDS = 51

_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def _in_bytes(text: Column, spans: Column) -> Column:
    """Ranges of words as ranges of bytes, from the first word's first to the last word's last byte."""

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def of(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for value, own in zip(texts, ranges.to_pylist(), strict=True):
            found = [match.span() for match in _WORD.finditer(value.as_py())]
            out.append([{"a": found[s["a"]][0], "b": found[s["b"] - 1][1]} for s in own])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    return of(utf8(text), spans)


def remove_repeated_passages(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, words: int = WORDS, readable: bool = False) -> DataFrame:
    """``doc`` (the input row) and ``cut``: ``n`` bytes, ``n_removed``, ``n_spans``, the ``kept`` bytes, or, if ``readable``, the
    text they make without the rests of cut characters.

    A byte is removed if a string of ``threshold`` bytes over it, or a window of ``words`` words between ASCII white space over it,
    also starts elsewhere, in any row, itself included. White space between windows' words goes with them and may differ
    between the copies. Null texts are empty; repeated rows repeat each other; an empty table gives no rows.
    """
    python_workers(docs.sparkSession)
    rows = keyed(docs, "texts")
    column = F.col(f"doc.`{text}`")
    # runs and their classes take a tenth in files of what they take in the driver's memory
    with measured_joins(docs.sparkSession):
        strings = covered(rows, column, F.col("row"), Bytes, threshold, depths(threshold), earliest=False)
        windows = covered(rows, column, F.col("row"), Words, words, levels(words), earliest=False)
    lists = windows.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    placed = rows.join(lists, "row").select("row", F.inline(_in_bytes(column, F.col("spans"))))
    return without(rows, strings.union(save(placed.select("row", "a", "b"), "passages")), text, Bytes, readable)
