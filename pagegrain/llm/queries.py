"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import new_path, shared_folder
from pagegrain.llm.contamination import contamination
from pagegrain.llm.language import identify
from pagegrain.llm.licenses import scan
from pagegrain.llm.line_index import remove_repeated_lines
from pagegrain.llm.neighbours import nearest
from pagegrain.llm.packing import pack
from pagegrain.llm.passages import WORDS
from pagegrain.llm.sharding import write_shards
from pagegrain.llm.simhash import near_duplicates
from pagegrain.llm.spelling import spelling_variants
from pagegrain.llm.substring import remove_repeated_words
from pagegrain.llm.suffix_array import remove_repeated_strings
from pagegrain.llm.tokens import read_tokens, write_tokens
from pagegrain.llm.vector_codes import compress


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "fingerprint", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return identify(docs, ~F.col("held_out")).select("doc.doc_id", "doc.held_out", "lang_pred", "score")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_strings(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=WORDS)
    return found.select(
        "doc.doc_id", F.col("cut.n").alias("n_bytes"), "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"),
        "n_passage_words",
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = contamination(docs, items)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", F.col("cut.n").alias("n_words"), "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path())
    found = read_tokens(spark, path)
    return found.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_pieces(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pieces(pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()))


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = write_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "shards"))
    data = F.coalesce(F.col("doc.text").cast("binary"), F.lit(b""))
    return found.select(
        "doc.doc_id", (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    every = F.concat("base", "found")
    return found.select(
        "doc.doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.first").alias("first_word"), F.array_max("base.first").alias("last_word"),
        names(F.col("base.label")).alias("base_labels"), names(every["label"]).alias("labels"),
        F.coalesce(F.array_max(every["score"]), F.lit(0.0)).alias("score"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.numbers())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    # a label's sum is repeated, so that a label of very many rows is joined by many tasks
    totals = coded.groupBy(F.col("doc.label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    totals = totals.select("of_label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("of_salt"))
    salted = coded.select("doc", code.alias("code"), "error", F.pmod(F.xxhash64("doc.vec_id", "doc.embedding"), F.lit(16)).cast("int").alias("salt"))
    same = F.col("doc.label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))
    return salted.join(totals, same).select(
        "doc.vec_id", "code", F.col("error").try_cast("bigint").alias("error"), F.col("label_error").try_cast("bigint").alias("label_error"),
        F.lit(digest).alias("codebooks_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", F.col("cut.n").alias("n_lines"), "cut.n_dropped", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _codes_sql() -> str:
    """Four rounds of assigning and averaging, unrolled; all numbers are whole and below 2^53, so doubles are exact."""
    floored = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"
    steps = [
        f"""kept AS (SELECT vec_id, label, {floored} AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """piece AS (SELECT vec_id, label, p::INT AS p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS q FROM kept, range(4) t(p))""",
        """book0 AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM piece QUALIFY e < 256)""",
    ]
    for k in range(5):
        apart = "list_dot_product(a.q, a.q) + list_dot_product(b.q, b.q) - 2 * list_dot_product(a.q, b.q)"
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT a.vec_id, a.label, a.p, any_value(a.q) AS q, min({{'d': {apart}, 'e': b.e}}) AS m
                FROM piece a JOIN book{k} b USING (p) GROUP BY a.vec_id, a.label, a.p)"""
        )
        if k < 4:
            steps.append(
                f"""mean{k} AS (SELECT p, e, list(f ORDER BY i) AS q FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS f FROM
                    (SELECT p, m.e AS e, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e),
                book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.q, b.q) AS q FROM book{k} b LEFT JOIN mean{k} n USING (p, e))"""
            )
    return f"""WITH {", ".join(steps)},
        row AS (SELECT vec_id, label, string_agg(printf('%02x', m.e::INT), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near4 GROUP BY vec_id, label),
        digest AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
            FROM (SELECT p, e, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM book4))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM row, digest"""


_LINES_SQL = r"""
WITH line AS (
    SELECT doc_id, i, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
shared AS (SELECT k, min(doc_id) AS first FROM line WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (s.k IS NOT NULL AND line.doc_id <> s.first) AS n_dropped,
    sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (s.k IS NULL OR line.doc_id = s.first), '')) AS kept_sha256
FROM line LEFT JOIN shared s ON line.k = s.k GROUP BY doc_id
"""


QUERIES = {
    query.__name__: query
    for query in (
        op1_simhash_near_dedup, op2_language_id, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_substring_dedup,
        op6_token_files, op7_nearest_neighbours, op8_curve_packing, op9_external_shuffle, op10_license_scan,
        op11_vector_codes, op12_line_dedup, op13_spelling_variants,
    )
}
# Spelling variants need crc32, which DuckDB lacks; the others need digests, vectors, tokenizers or random orders of their own.
ORACLE: dict[str, str] = {"op11_vector_codes": _codes_sql(), "op12_line_dedup": _LINES_SQL}
