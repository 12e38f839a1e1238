"""Flat rows and comparisons for reports: error cases, rows to annotate, summaries, curves side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.operators import labels, metrics, ranking
from prudence.operators.validate import require

#: Empty columns of the annotation template.
ANNOTATION = ("error_type", "error_subtype", "answer_in_context", "claim_faithful", "nli_correct", "reference_complete", "severity", "annotator", "notes")


def error_cases(df: DataFrame, decision: str = "final_decision", prediction: str = "prediction_text", references: str = "reference_answers", answerable: str = "is_answerable") -> DataFrame:
    """Add strict and relaxed correctness, exact match, F1, answer_error_type and category. Correct means relaxed: an exact match or an F1 of 0.8 over references that don't normalise to nothing."""
    p, r, can = F.col(prediction), F.col(references), F.col(answerable)
    used = F.filter(r, lambda x: T.normalize_answer(x) != "")
    df = df.withColumn("exact_match", F.when(can, T.exact_match(p, used)).otherwise(0.0)).withColumn("token_f1", F.when(can, T.best_f1_pair(p, used)).otherwise(0.0))
    df = df.withColumn("strict_correct", can & (F.col("exact_match") == 1.0)).withColumn("prediction_correct", can & ((F.col("exact_match") == 1.0) | (F.col("token_f1") >= 0.8)))
    df = df.withColumn("answer_error_type", labels.answer_error_type(can, F.col("exact_match"), F.col("token_f1")))
    return df.withColumn("category", labels.error_category(F.col(decision), can, F.col("prediction_correct")))


def flattened(value: Column, kind: str) -> Column:
    """References as an array of texts, from a text, a list of texts, a list of lists or a struct with a list `text`."""
    if kind == "string":
        return F.when(T.clean_text(value) == "", F.array().cast("array<string>")).otherwise(F.array(value))
    if kind.startswith("array<array<"):
        return F.flatten(value)
    if kind.startswith("array<struct<"):
        return F.transform(value, lambda x: x["text"])
    if kind.startswith("struct<"):
        return value["text"]
    return value


def joined(value: Column) -> Column:
    return F.array_join(F.transform(value, T.clean_text), " | ")


def shown(value: Column) -> Column:
    """A flag as true, false or nothing."""
    return F.coalesce(value.cast("string"), F.lit(""))


def investigation_rows(df: DataFrame, threshold: float = 0.8, limit: int | None = None) -> DataFrame:
    """Wrong rows of high entailment as flat texts, highest first; unanswerable rows have the reference [UNANSWERABLE]. Columns that a table lacks are empty."""
    have = set(df.columns)

    def text(*names: str) -> Column:
        return T.clean_text(T.first_present(names, have).cast("string"))

    def number(*names: str) -> Column:
        return F.coalesce(F.format_number(T.first_present(names, have).cast("double"), 6), F.lit(""))

    wrong = df.where(~F.col("correct") & (F.col("entailment") >= threshold))
    references = F.when(~F.coalesce(F.col("is_answerable"), F.lit(True)), "[UNANSWERABLE]").otherwise(joined(F.col("reference_answers")) if "reference_answers" in have else F.lit(""))
    out = wrong.select(
        F.concat(F.lit("case_"), F.col("row_idx").cast("string")).alias("case_id"), "row_idx", text("question").alias("question"), text("prediction_text", "answer").alias("prediction"), references.alias("references"), shown(F.col("is_answerable")).alias("is_answerable"),
        shown(F.col("correct")).alias("correct"), number("calibrated_confidence", "confidence").alias("confidence"), number("qa_entailment_probability", "entailment").alias("entailment_probability"), number("qa_contradiction_probability", "contradiction").alias("contradiction_probability"),
        number("qa_neutral_probability", "neutral").alias("neutral_probability"), F.upper(text("qa_nli_label", "nli_label")).alias("nli_label"), text("qa_claim", "claim").alias("claim"), text("evidence_text", "context").alias("evidence"), number("retriever_score").alias("retriever_score"),
        text("evidence_source").alias("evidence_source"), shown(T.first_present(("qa_claim_valid", "claim_valid"), have).cast("boolean")).alias("claim_valid"), F.col("entailment").alias("_e"),
    )
    out = require(out, {"rows are wrong": F.col("correct") == "false"}, allow_empty=True)
    return (out.orderBy(F.desc("_e"), "row_idx").limit(limit) if limit else out).drop("_e")


def annotation_template(rows: DataFrame) -> DataFrame:
    """Rows with empty columns for people to fill in."""
    return rows.select("*", *(F.lit("").alias(c) for c in ANNOTATION))


def baseline_summary(df: DataFrame, row_idx: str = "row_idx", **columns: str) -> DataFrame:
    """Selective metrics with the system, model and split of the first row."""
    have = [c for c in ("system", "model", "split") if c in df.columns]
    first = df.agg(F.min_by(F.struct(*have, F.lit(1).alias("_one")), F.col(row_idx)).alias("f"))
    names = first.select(*(F.coalesce(F.col(f"f.{c}") if c in have else F.lit(None), F.lit("unknown")).alias(c) for c in ("system", "model", "split")))
    return names.join(metrics.selective_metrics(df, **columns))


def side_by_side(first: DataFrame, second: DataFrame, targets: Sequence[float], names: tuple[str, str] = ("confidence", "hybrid")) -> DataFrame:
    """Two curves at the same target coverages, with the second's differences."""
    a, b = (ranking.nearest_coverage(x, targets, larger_on_tie=True, positive_only=True).select("target_coverage", F.col("coverage").alias(f"{n}_coverage"), F.col("risk").alias(f"{n}_risk")) for x, n in zip((first, second), names, strict=True))
    both = a.join(b, "target_coverage")
    return both.withColumn("coverage_difference", F.col(f"{names[1]}_coverage") - F.col(f"{names[0]}_coverage")).withColumn("risk_difference", F.col(f"{names[1]}_risk") - F.col(f"{names[0]}_risk"))


def against_random(points: DataFrame, random_runs: DataFrame, key: str = "target_coverage") -> DataFrame:
    """Points with the mean risk of random abstention at the same coverage (to ten places); a coverage without runs raises."""
    known = random_runs.select(F.round(key, 10).alias("_k"), F.col("mean_selective_risk").alias("random_risk"))
    out = points.join(F.broadcast(known), F.round(key, 10) == F.col("_k"), "left").drop("_k")
    return out.withColumn("random_risk", F.coalesce("random_risk", F.raise_error(F.lit("no random runs at this coverage")).cast("double"))).withColumn("gain", F.col("random_risk") - F.col("risk"))
