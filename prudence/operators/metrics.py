"""Aggregate metrics. What an empty set gives (0, 1 or null) is part of each operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.functions.values import ratio

RATES = ("accuracy", "coverage", "abstention_rate", "answered_accuracy", "selective_risk", "exact_match", "token_f1", "answered_exact_match", "answered_token_f1", "unnecessary_abstention_rate", "unanswerable_answer_rate", "correct_abstention_rate")


def count_of(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0).cast("long"))


def total_of(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def selective_rates(decision: str = "decision", answerable: str = "is_answerable", correct: str = "is_correct", exact: str = "exact_match", f1: str = "token_f1") -> tuple[dict[str, Column], dict[str, Column]]:
    """Aggregates of answers and abstentions, and the rates over them; a rate over no rows is 0. Names with _ are of use for rates alone."""
    answer, abstain, can, right = F.col(decision) == "ANSWER", F.col(decision) == "ABSTAIN", F.col(answerable), F.col(correct)
    counts = {
        "total": F.count("*"), "answered": count_of(answer), "abstained": count_of(abstain), "answerable_count": count_of(can), "unanswerable_count": count_of(~can),
        "total_correct": count_of(right), "answered_correct": count_of(right & answer), "correct_abstentions": count_of(abstain & ~can),
        "unnecessary_abstentions": count_of(abstain & can), "answered_unanswerable": count_of(answer & ~can),
        "_em": total_of(F.col(exact)), "_f1": total_of(F.col(f1)), "_aem": total_of(F.when(answer, F.col(exact))), "_af1": total_of(F.when(answer, F.col(f1))),
    }
    c = F.col
    rates = {
        "accuracy": ratio(c("total_correct"), c("total"), 0.0), "coverage": ratio(c("answered"), c("total"), 0.0), "abstention_rate": ratio(c("abstained"), c("total"), 0.0),
        "answered_accuracy": ratio(c("answered_correct"), c("answered"), 0.0), "selective_risk": F.when(c("answered") > 0, 1 - c("answered_correct") / c("answered")).otherwise(0.0),
        "exact_match": ratio(c("_em"), c("total"), 0.0), "token_f1": ratio(c("_f1"), c("total"), 0.0), "answered_exact_match": ratio(c("_aem"), c("answered"), 0.0), "answered_token_f1": ratio(c("_af1"), c("answered"), 0.0),
        "unnecessary_abstention_rate": ratio(c("unnecessary_abstentions"), c("answerable_count"), 0.0), "unanswerable_answer_rate": ratio(c("answered_unanswerable"), c("unanswerable_count"), 0.0),
        "correct_abstention_rate": ratio(c("correct_abstentions"), c("unanswerable_count"), 0.0),
    }
    return counts, rates


def selective_metrics(df: DataFrame, by: Sequence[str] = (), decision: str = "decision", answerable: str = "is_answerable", correct: str = "is_correct", exact: str = "exact_match", f1: str = "token_f1") -> DataFrame:
    """Counts and rates of answers and abstentions, for all rows or for groups; a rate over no rows is 0."""
    counts, rates = selective_rates(decision, answerable, correct, exact, f1)
    out = df.groupBy(*by).agg(*(c.alias(n) for n, c in counts.items()))
    return out.select(*by, *(n for n in counts if n[0] != "_"), *(r.alias(n) for n, r in rates.items()))


def by_answerability(df: DataFrame, answerable: str = "is_answerable", **columns: str) -> DataFrame:
    """The metrics over all rows, the answerable and the unanswerable ones, in one pass: every row counts in its subset and in `all`."""
    subset = F.explode(F.array(F.lit("all"), F.when(F.col(answerable), "answerable").otherwise("unanswerable"))).alias("subset")
    return selective_metrics(df.select("*", subset), ["subset"], answerable=answerable, **columns)


def system_metrics(df: DataFrame, answers: dict[str, Column], correct: str = "correct", answerable: str = "is_answerable", exact: str = "exact_match", f1: str = "token_f1") -> DataFrame:
    """For systems that answer where their predicate holds: counts, coverage, selective accuracy and risk (0 without answers), routing accuracy."""
    long = df.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("system"), F.coalesce(p, F.lit(False)).alias("answer")) for n, p in answers.items()))).alias("_s"))
    long = long.select("*", "_s.system", "_s.answer").drop("_s")
    a, right, can = F.col("answer"), F.col(correct), F.col(answerable)
    out = long.groupBy("system").agg(
        F.count("*").alias("total"), count_of(a).alias("answered"), count_of(a & right).alias("answered_correct"), count_of(a & ~right).alias("answered_wrong"),
        count_of(~a & right).alias("abstained_correct"), count_of(~a & ~right).alias("abstained_wrong"), count_of((a & right) | (~a & ~right)).alias("_routed"), count_of(a & ~can).alias("answered_unanswerable"),
        *([F.avg(F.when(a, F.col(exact)).otherwise(0.0)).alias("mean_exact_match"), F.avg(F.when(a, F.col(f1)).otherwise(0.0)).alias("mean_token_f1")] if exact in df.columns and f1 in df.columns else []),
    )
    return out.select(
        *(c for c in out.columns if c != "_routed"), ratio(F.col("answered"), F.col("total"), 0.0).alias("coverage"), ratio(F.col("answered_correct"), F.col("answered"), 0.0).alias("selective_accuracy"),
        ratio(F.col("answered_wrong"), F.col("answered"), 0.0).alias("selective_risk"), ratio(F.col("_routed"), F.col("total"), 0.0).alias("routing_accuracy"),
    )


def group_metrics(df: DataFrame, key: str, domain: Sequence[str], correct: str = "correct", means: Sequence[str] = ()) -> DataFrame:
    """Count, rate, correct count, accuracy and risk of each value of a fixed domain; rates of empty groups are null."""
    found = df.groupBy(key).agg(F.count("*").alias("count"), count_of(F.col(correct)).alias("correct_count"), *(F.avg(m).alias(f"mean_{m}") for m in means))
    total = df.agg(F.count("*").alias("_total"))
    every = df.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    out = every.join(F.broadcast(found), key, "left").join(F.broadcast(total))
    n, right = F.coalesce("count", F.lit(0).cast("long")), F.coalesce("correct_count", F.lit(0).cast("long"))
    return out.select(key, n.alias("count"), ratio(n, F.col("_total")).alias("rate"), right.alias("correct_count"), ratio(right, n).alias("accuracy"), ratio(n - right, n).alias("risk"), *(f"mean_{m}" for m in means))


def policy_comparison(df: DataFrame, before: str = "threshold_decision", after: str = "final_decision", correct: str = "correct") -> DataFrame:
    """One row: accuracy of all rows, coverage and accuracy of the rows answered before and after resolution, and the changes."""
    a, b, right = F.col(after) == "ANSWER", F.col(before) == "ANSWER", F.col(correct)
    one = df.agg(F.count("*").alias("total"), count_of(right).alias("_right"), count_of(b).alias("_nb"), count_of(b & right).alias("_cb"), count_of(a).alias("_na"), count_of(a & right).alias("_ca"))
    c = F.col
    return one.select(
        "total", ratio(c("_right"), c("total")).alias("baseline_accuracy"), ratio(c("_nb"), c("total")).alias("threshold_coverage"), ratio(c("_cb"), c("_nb")).alias("threshold_accuracy"),
        ratio(c("_na"), c("total")).alias("final_coverage"), ratio(c("_ca"), c("_na")).alias("final_accuracy"), (ratio(c("_na"), c("total")) - ratio(c("_nb"), c("total"))).alias("coverage_change"),
        (ratio(c("_ca"), c("_na")) - ratio(c("_cb"), c("_nb"))).alias("accuracy_change"),
    )


def verify_impact(df: DataFrame, category: str = "diagnostic_category") -> DataFrame:
    """One row: what became of VERIFY rows, as counts and rates; rates over no rows are null."""
    names = [f"verify_{c}_{w}" for c in ("correct", "incorrect") for w in ("promoted_to_answer", "blocked", "preserved")]
    one = df.agg(*(count_of(F.col(category) == n).alias(n) for n in names))
    c = F.col
    promoted, blocked, preserved = (c(f"verify_correct_{w}") + c(f"verify_incorrect_{w}") for w in ("promoted_to_answer", "blocked", "preserved"))
    right, wrong = (sum((c(f"verify_{x}_{w}") for w in ("blocked", "preserved")), c(f"verify_{x}_promoted_to_answer")) for x in ("correct", "incorrect"))
    return one.select(
        (right + wrong).alias("verify_predictions"), *names, ratio(c("verify_correct_promoted_to_answer"), promoted).alias("promotion_precision"), ratio(c("verify_incorrect_blocked"), wrong).alias("beneficial_block_rate"),
        ratio(c("verify_correct_blocked"), right).alias("harmful_block_rate"), ratio(promoted + blocked, right + wrong).alias("resolved_rate"), ratio(preserved, right + wrong).alias("preserved_rate"),
    )


def value_counts(df: DataFrame, key: str, default: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key), F.lit(default)).alias(key)).count()


def group_impact(df: DataFrame, keys: Sequence[str], correct: str = "correct", means: Sequence[str] = ()) -> DataFrame:
    """Counts, rates, risk and signal means for every value of each key, over rows repeated for each key; summaries.grouped_report does it by grouping sets."""
    long = df.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("value")) for k in keys))).alias("_g")).select("*", "_g.grouping", "_g.value")
    out = long.groupBy("grouping", "value").agg(F.count("*").alias("count"), count_of(F.col(correct)).alias("correct_count"), *(F.avg(m).alias(f"mean_{m}") for m in means))
    total = F.broadcast(df.agg(F.count("*").alias("_total")))
    n, right = F.col("count"), F.col("correct_count")
    return out.join(total).select("grouping", "value", n, ratio(n, F.col("_total")).alias("rate"), right, ratio(n - right, n).alias("risk"), *(f"mean_{m}" for m in means))


def split_statistics(df: DataFrame, split: str = "split", answerable: str = "is_answerable") -> DataFrame:
    out = df.groupBy(split).agg(F.count("*").alias("total"), count_of(F.col(answerable).cast("boolean")).alias("answerable"))
    return out.select(split, "total", "answerable", (F.col("total") - F.col("answerable")).alias("unanswerable"), ratio(F.col("answerable"), F.col("total"), 0.0).alias("answerable_fraction"))


def decision_summary(df: DataFrame, decision: str = "decision") -> DataFrame:
    out = df.agg(F.count("*").alias("total"), count_of(F.col(decision) == "ANSWER").alias("answered"))
    return out.select("total", "answered", (F.col("total") - F.col("answered")).alias("abstained"), ratio(F.col("answered"), F.col("total"), 0.0).alias("coverage"))


def evidence_summary(df: DataFrame, label: str = "evidence_label") -> DataFrame:
    """Counts and rates of SUPPORTED and UNSUPPORTED; all others are uncertain."""
    one = df.agg(F.count("*").alias("total"), count_of(F.col(label) == "SUPPORTED").alias("supported"), count_of(F.col(label) == "UNSUPPORTED").alias("unsupported"))
    one = one.withColumn("uncertain", F.col("total") - F.col("supported") - F.col("unsupported"))
    return one.select("*", *(ratio(F.col(c), F.col("total"), 0.0).alias(f"{c}_rate") for c in ("supported", "unsupported", "uncertain")))


def error_summary(df: DataFrame, category: str = "error_category") -> DataFrame:
    """One row: unsafe answers among answers, unnecessary abstentions among abstentions (0 over none), and counts."""
    k = F.col(category)
    one = df.agg(
        F.count("*").alias("total"), count_of(k == "CORRECT_ANSWER").alias("correct_answers"), count_of(k == "UNSAFE_WRONG_ANSWER").alias("unsafe_answers"),
        count_of(k == "UNNECESSARY_ABSTENTION").alias("unnecessary_abstentions"), count_of(k.isin("PROTECTIVE_ABSTENTION", "CORRECT_UNANSWERABLE_ABSTENTION")).alias("useful_abstentions"), count_of(k.startswith("VERIFY")).alias("verify"),
    )
    c = F.col
    return one.select("*", ratio(c("unsafe_answers"), c("unsafe_answers") + c("correct_answers"), 0.0).alias("unsafe_rate"), ratio(c("unnecessary_abstentions"), c("unnecessary_abstentions") + c("useful_abstentions"), 0.0).alias("unnecessary_rate"))


def reason_counts(df: DataFrame, reasons: str = "qa_claim_validation_reasons", valid: str = "qa_claim_valid") -> DataFrame:
    """How often each reason stands at an invalid claim."""
    return df.where(~F.col(valid)).select(F.explode(reasons).alias("reason")).groupBy("reason").count()


def missing_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which each column is null or blank, one row per column."""
    one = df.agg(*(count_of(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in columns))
    return one.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") AS (field, missing)"))


def high_entailment(df: DataFrame, threshold: float = 0.8, entailment: str = "entailment", valid: str = "claim_valid", correct: str = "correct") -> DataFrame:
    """Valid and invalid claims, rows of high entailment, and the share of them that is wrong (null over none)."""
    high = F.col(entailment) >= threshold
    one = df.agg(count_of(F.col(valid)).alias("valid_claims"), count_of(~F.col(valid)).alias("invalid_claims"), count_of(high).alias("high_rows"), count_of(high & ~F.col(correct)).alias("high_wrong"))
    return one.select("*", ratio(F.col("high_wrong"), F.col("high_rows")).alias("high_wrong_share"))


def run_summary(df: DataFrame, by: str = "target_coverage", values: Sequence[str] = ("answer_accuracy", "selective_risk")) -> DataFrame:
    """Mean, population deviation, minimum and maximum over repeated runs."""
    return df.groupBy(by).agg(F.count("*").alias("runs"), *(f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))
