"""Checks that are part of the semantics: bad values raise instead of turning into nulls. All checks of a table are one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions.values import in_range
from prudence.sources.stages import delete


class InvalidRows(ValueError):
    """Names each failed check with its number of rows."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise InvalidRows(f"missing columns: {', '.join(missing)}")


def require(df: DataFrame, checks: dict[str, Column], allow_empty: bool = False) -> DataFrame:
    """df itself if every check holds in every row (null counts as failed), and there are rows."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values()))).first()
    if not one["n"] and not allow_empty:
        raise InvalidRows("there are no rows")
    if bad := [f"{name}: {one[f'c{i}']} rows" for i, name in enumerate(checks) if one[f"c{i}"]]:
        raise InvalidRows("; ".join(bad))
    return df


def failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail each check (null counts as failed): check, failed, total. One aggregation of one pass."""
    one = df.agg(F.count("*").alias("total"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())))
    each = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("failed")) for i, name in enumerate(checks)))
    return one.select(F.inline(each), "total").select("check", "failed", "total")


class Watch:
    """Checks that ride on the pass which consumes the rows, as observed metrics.

    df is the table to go on with; after an action over all of its rows, verify() raises if any failed. The action runs
    once and nothing is read for the checks. An action that ends early, such as first(), observes part of the rows.
    """

    def __init__(self, df: DataFrame, checks: dict[str, Column], allow_empty: bool = False):
        self.names, self.allow_empty, self.seen = list(checks), allow_empty, Observation()
        self.df = df.observe(self.seen, F.count(F.lit(1)).alias("n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())))

    def verify(self) -> int:
        """The number of rows that passed by; raises InvalidRows if one failed a check, or there was none."""
        got = self.seen.get
        if not got.get("n") and not self.allow_empty:
            raise InvalidRows("there are no rows")
        if bad := [f"{name}: {got[f'c{i}']} rows" for i, name in enumerate(self.names) if got.get(f"c{i}")]:
            raise InvalidRows("; ".join(bad))
        return got.get("n") or 0


def write_checked(df: DataFrame, path: str, checks: dict[str, Column], allow_empty: bool = False) -> int:
    """Write Parquet and check the rows in the same job. If one fails, the files are deleted and InvalidRows is raised; else the number of rows."""
    watch = Watch(df, checks, allow_empty)
    watch.df.write.parquet(path)
    try:
        return watch.verify()
    except InvalidRows:
        delete(df.sparkSession, path)
        raise


def probability(column: str) -> dict[str, Column]:
    return {f"{column} between 0 and 1": in_range(F.col(column))}


def usable_text(column: str) -> dict[str, Column]:
    return {f"{column} has text": T.clean_text(F.col(column)) != ""}


def flag_matches_references(answerable: str = "is_answerable", references: str = "reference_answers") -> dict[str, Column]:
    some = F.coalesce(F.exists(references, lambda r: T.normalize_answer(r) != ""), F.lit(False))
    return {"answerability agrees with the references": F.col(answerable) == some}


def agreeing_decisions(columns: Sequence[str]) -> dict[str, Column]:
    values = F.array_compact(F.array(*(F.nullif(T.upper_label(F.col(c)), F.lit("")) for c in columns)))
    return {"decision fields agree": F.size(F.array_distinct(values)) <= 1}


def resolved_as_expected(before: str = "threshold_decision", support: str = "evidence_support", after: str = "final_decision") -> dict[str, Column]:
    from prudence.operators.labels import resolve

    return {"final decisions follow the policy": F.col(after) == resolve(F.col(before), F.col(support))}


def recomputed(stored: str, value: Column, tolerance: float = 1e-9) -> dict[str, Column]:
    return {f"{stored} equals its recomputation": F.abs(F.col(stored) - value) <= tolerance}


def metric_invariants(metrics: DataFrame) -> DataFrame:
    """Counts of selective metrics add up, and risk is 1 - accuracy where rows were answered."""
    c = F.col
    return require(
        metrics,
        {
            "answered + abstained = total": c("answered") + c("abstained") == c("total"),
            "answerable + unanswerable = total": c("answerable_count") + c("unanswerable_count") == c("total"),
            "coverage + abstention_rate = 1": F.abs(c("coverage") + c("abstention_rate") - 1) <= 1e-12,
            "selective_risk = 1 - answered_accuracy": (c("answered") == 0) | (F.abs(c("selective_risk") - 1 + c("answered_accuracy")) <= 1e-12),
        },
    )


def same_over_runs(runs: DataFrame, key: str = "target_coverage", values: Sequence[str] = ("answered", "actual_coverage")) -> DataFrame:
    """Every run of a target answers equally many rows."""
    require(runs.groupBy(key).agg(*(F.countDistinct(v).alias(v) for v in values)), {f"one {v} a {key}": F.col(v) == 1 for v in values})
    return runs


def best_field(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """Of several columns for one thing the one with most finite numbers; the first among equals; None if none has any."""
    have = [c for c in aliases if c in df.columns]
    if not have:
        return None
    counts = df.agg(*(F.count_if(in_range(F.col(c), float("-inf"), float("inf"))).alias(c) for c in have)).first()
    best = max(have, key=lambda c: (counts[c], -have.index(c)))
    return best if counts[best] else None


def calibrated_confidence(df: DataFrame, explicit: Sequence[str] = ("calibrated_confidence", "confidence_calibrated")) -> str:
    """The explicit calibrated column, or `confidence` if every row is marked as calibrated; else raises."""
    for c in explicit:
        if c in df.columns:
            return c
    require_columns(df, ["confidence", "confidence_is_calibrated"])
    require(df, {"confidence is marked as calibrated": F.col("confidence_is_calibrated")})
    return "confidence"
