"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudence.llm import backoff, centroids, conversations, decontamination, jaccard_join, licenses
from prudence.llm.exact_dedup import exact_dedup
from prudence.llm.html_text import extract_text
from prudence.llm.language import identify
from prudence.llm.packing import pack
from prudence.llm.quality import score_quality
from prudence.llm.token_counts import section_token_counts
from prudence.llm.toxicity import grade_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six places, since sums depend on their order."""
    rows = backoff.score_texts(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_quality, op3_language_id, op4_decontamination, op5_html_text, op6_licenses, op7_toxicity, op8_jaccard_join, op9_token_counts, op10_exact_dedup, op11_conversation_repair, op12_centroids, op13_katz_scores)}

ORACLES: dict[str, str] = {
    "op4_decontamination": decontamination.oracle(),
    "op6_licenses": licenses.oracle(),
    "op8_jaccard_join": jaccard_join.oracle(),
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM t""",
    "op11_conversation_repair": conversations.oracle(),
    "op12_centroids": centroids.oracle(),
    "op13_katz_scores": backoff.oracle(),
}
