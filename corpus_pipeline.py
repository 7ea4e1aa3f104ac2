"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage gets what the one before it kept, as a table of documents, and returns documents; the last returns pieces of packed
sequences. A stage's result is written before the next stage begins, so that one deletes the tables the stage before had saved.

All stages keep every column of their input, whatever its name; repeated rows are documents of their own; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import save, stage_tables
from pagegrain.llm.contamination import contamination
from pagegrain.llm.language import identify
from pagegrain.llm.packing import pack
from pagegrain.llm.passages import remove_repeated_passages
from pagegrain.llm.queries import op8_pieces, tokenizer_path
from pagegrain.llm.simhash import near_duplicates

# The cosine from which on a text counts as one of the learned languages. Unrelated texts stay near 0 with a deviation of 1/32 (1,024
# dimensions); the lowest short text in a learned language seen had 0.092.
LEAST_SCORE = 0.09
# Words of a shingle of the fingerprints, which link at four or fewer differing bits.
SHINGLE = 4


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The documents with another text and its number of characters, other columns unchanged."""
    changed = docs.select("doc", text.alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("bigint")}
    return changed.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in changed.schema["doc"].dataType.names])


def after(before: str | None) -> Callable:
    """A stage that follows another one."""

    def of(stage: Callable) -> Callable:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            with stage_tables(spark, stage.__name__, before):
                return stage(spark, docs, sf_dir)

        return run_stage

    return of


@after(None)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null and letterless texts and those near none of the languages go.
    ``lang`` is kept as it came."""
    return identify(docs).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


@after("language")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: one with the smallest id (null first), of rows with one id any one. Null
    texts and those without words have fingerprint zero and are linked like any other."""
    return near_duplicates(docs, words=SHINGLE).filter("is_first").select("doc.*")


@after("near_dedup")
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes and the passages of 51 words that it shares; cut characters at the edges go with them."""
    found = remove_repeated_passages(docs, readable=True)
    return _with_text(found, F.when(F.col("cut.n_removed") == 0, F.col("doc.text")).otherwise(F.col("cut.kept")))


@after("repeated_strings")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null texts, and all texts if there are no items, stay."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("size(spans) = 0").select("doc.*")


@after("decontaminate")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, neighbours on the curve together. A null text is one end id; documents with equal
    keys come in the order of their ids."""
    return op8_pieces(pack(docs, tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeated_strings", repeated_strings),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs


# SQL has no hyperdimensional vectors, tokenizers or curves; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
