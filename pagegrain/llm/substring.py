"""Substring dedup by level-wise doubling of word windows.

Windows of a quarter of the length are compared first; only where such a window is repeated are windows of twice the
length looked at, and so on up to the length itself, until no candidates survive (see ``repeats``). Of equal windows the
earliest stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import keyed, python_workers
from pagegrain.llm.repeats import Words, covered, without

WORDS = 20


def levels(words: int) -> tuple[int, ...]:
    """Lengths of the levels, each twice the one before: 5, 10, 20 for 20."""
    return tuple(sorted({-(-words // 4), -(-words // 2), words}))


def remove_repeated_words(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """``doc`` (the input row) and ``cut``: ``n`` words, ``n_removed``, ``n_spans``, the ``kept`` words by one space.

    A word is removed if a window of ``words`` words over it also starts earlier: in a row with a smaller id (null
    ids first; among equal ids in a fixed order of rows), or earlier in the same row. Null texts have no words.
    """
    python_workers(docs.sparkSession)
    rows = keyed(docs, "texts")
    spans = covered(rows, F.col(f"doc.`{text}`"), F.col(f"doc.`{id}`"), Words, words, levels(words), earliest=True)
    return without(rows, spans, text, Words)
