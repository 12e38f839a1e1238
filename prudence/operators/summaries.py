"""Reports over several groupings at once: one scan of the columns that they need, expanded to grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.functions.values import ratio
from prudence.operators.metrics import count_of, selective_rates

#: The section of all rows.
ALL = "all"


def grouped_report(df: DataFrame, sections: dict[str, Column], measures: dict[str, Column], needs: Sequence[str]) -> DataFrame:
    """section, value and measures of every value of each section, and of all rows (section `all`, value null).

    Only the sections' values and the needed columns go through the grouping sets; rows are counted map-side once for
    each section before anything moves. A null value is a group of its own.
    """
    names = [f"_s{i}" for i in range(len(sections))]
    narrow = df.select(*(c.cast("string").alias(n) for n, c in zip(names, sections.values(), strict=True)), *needs)
    sets = [[], *([F.col(n)] for n in names)]
    out = narrow.groupingSets(sets, *map(F.col, names)).agg(F.grouping_id(*names).alias("_g"), *(m.alias(k) for k, m in measures.items()))
    whole = (1 << len(names)) - 1
    section, value = F.when(F.col("_g") == whole, ALL), F.when(F.col("_g") == whole, F.lit(None).cast("string"))
    for i, (n, name) in enumerate(zip(names, sections, strict=True)):
        mine = F.col("_g") == whole - (1 << (len(names) - 1 - i))
        section, value = section.when(mine, name), value.when(mine, F.col(n))
    return out.select(section.alias("section"), value.alias("value"), *measures)


def with_rate(report: DataFrame, count: str = "count") -> DataFrame:
    """Add the share of all rows; the report, a row a group, is small."""
    total = F.max(F.when(F.col("section") == ALL, F.col(count))).over(W.partitionBy())
    return report.withColumn("rate", ratio(F.col(count), total))


def native_summary(df: DataFrame, decision: str = "decision", answerable: str = "is_answerable", correct: str = "is_correct", exact: str = "exact_match", f1: str = "token_f1") -> DataFrame:
    """Selective metrics of all rows, the answerable and the unanswerable ones, with system, model and split where the table has them; several of one raise."""
    counts, rates = selective_rates(decision, answerable, correct, exact, f1)
    about = [c for c in ("system", "model", "split") if c in df.columns]
    measures = counts | {c: F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")) for c in about}
    out = grouped_report(df, {"subset": F.when(F.col(answerable), "answerable").otherwise("unanswerable")}, measures, [decision, answerable, correct, exact, f1, *about])
    same = lambda c: F.when(F.col(f"{c}.lo").eqNullSafe(F.col(f"{c}.hi")), F.coalesce(F.col(f"{c}.lo"), F.lit("unknown"))).otherwise(F.raise_error(F.lit(f"several values of {c}")).cast("string")).alias(c)
    return out.select(F.coalesce("value", "section").alias("subset"), *map(same, about), *(n for n in counts if n[0] != "_"), *(r.alias(n) for n, r in rates.items()))


def verified_summary(df: DataFrame, before: str = "threshold_decision", after: str = "final_decision", correct: str = "correct") -> DataFrame:
    """One row: accuracy at full coverage; of the final decisions and of the threshold's own the counts, rates and accuracies of ANSWER, VERIFY and ABSTAIN and the risk; and the changes between them. Rates over no rows are null."""
    right = F.col(correct)
    kinds = ("answer", "verify", "abstain")
    measures = {"total_predictions": F.count("*"), "_right": count_of(right)}
    for p, column in (("verified", after), ("threshold", before)):
        for k in kinds:
            mine = F.upper(F.trim(F.col(column))) == k.upper()
            measures |= {f"{p}_{k}_count": count_of(mine), f"_{p}_{k}": count_of(mine & right)}
    one = df.agg(*(m.alias(n) for n, m in measures.items()))
    c, n = F.col, F.col("total_predictions")
    out = {"total_predictions": n, "full_coverage_baseline_accuracy": ratio(c("_right"), n)}
    for p in ("verified", "threshold"):
        for k in kinds:
            out |= {f"{p}_{k}_count": c(f"{p}_{k}_count"), f"{p}_{k}_rate": ratio(c(f"{p}_{k}_count"), n), f"{p}_{k}_accuracy": ratio(c(f"_{p}_{k}"), c(f"{p}_{k}_count"))}
        out[f"{p}_selective_risk"] = 1 - out[f"{p}_answer_accuracy"]
    for k in ("answer_rate", "answer_accuracy", "selective_risk"):
        out[f"{k}_change"] = out[f"verified_{k}"] - out[f"threshold_{k}"]
    return one.select(*(x.alias(k) for k, x in out.items()))


def question_aware_report(df: DataFrame, label: str = "qa_nli_label", valid: str = "claim_valid", entailment: str = "entailment", confidence: str = "confidence", correct: str = "correct", answerable: str = "is_answerable", high: float = 0.8, low: float = 0.2, bins: int = 10) -> DataFrame:
    """Where question-aware verification errs: by label, claim validity, answerability, entailment and confidence bins, and the four groups in which verifier and answer disagree.

    section, value, count, rate, correct_count, accuracy, mean_entailment, mean_confidence. A row in no group of
    disagreement is `none`; of several the first counts.
    """
    e, k, right = F.col(entailment), F.col(confidence), F.col(correct)
    bin_of = lambda x: F.least(F.floor(x * bins).cast("int"), F.lit(bins - 1))
    group = F.when(~right & (e >= high), "incorrect_high_entailment").when(right & (e <= low), "correct_low_entailment").when((k >= high) & (e <= low), "high_confidence_low_entailment").when((k <= low) & (e >= high), "low_confidence_high_entailment").otherwise("none")
    sections = {"label": F.col(label), "claim_valid": F.col(valid), "answerable": F.col(answerable), "entailment_bin": bin_of(e), "confidence_bin": bin_of(k), "disagreement": group}
    measures = {"count": F.count("*"), "correct_count": count_of(right), "mean_entailment": F.avg(entailment), "mean_confidence": F.avg(confidence)}
    out = with_rate(grouped_report(df, sections, measures, [correct, entailment, confidence]))
    return out.select("section", "value", "count", "rate", "correct_count", ratio(F.col("correct_count"), F.col("count")).alias("accuracy"), "mean_entailment", "mean_confidence")


def evidence_error_report(df: DataFrame, support: str = "evidence_support", category: str = "diagnostic_category", error: str = "answer_error_type", strict: str = "strict_correct", relaxed: str = "relaxed_correct") -> DataFrame:
    """Evidence against answers: rows by support, category and kind of answer error, right by the strict and the relaxed measure: section, value, count, rate, strict_correct, relaxed_correct, strict_accuracy, relaxed_accuracy."""
    sections = {"evidence_support": F.col(support), "category": F.col(category), "answer_error_type": F.col(error)}
    out = with_rate(grouped_report(df, sections, {"count": F.count("*"), "strict_correct": count_of(F.col(strict)), "relaxed_correct": count_of(F.col(relaxed))}, [strict, relaxed]))
    return out.select("section", "value", "count", "rate", "strict_correct", "relaxed_correct", *(ratio(F.col(f"{m}_correct"), F.col("count")).alias(f"{m}_accuracy") for m in ("strict", "relaxed")))


def investigation_summary(df: DataFrame, label: str = "qa_nli_label", valid: str = "claim_valid", entailment: str = "entailment", confidence: str = "confidence", correct: str = "correct", texts: Sequence[str] = ("question", "claim"), high: float = 0.8) -> DataFrame:
    """Wrong rows of high entailment by label and claim validity, with mean signals and how many lack each text: section, value, count, mean_entailment, mean_confidence, missing_<text>."""
    some = df.where(~F.col(correct) & (F.col(entailment) >= high))
    missing = {f"missing_{t}": count_of(F.coalesce(F.trim(F.col(t).cast("string")), F.lit("")) == "") for t in texts}
    return grouped_report(some, {"nli_label": F.col(label), "claim_validity": F.col(valid)}, {"count": F.count("*"), "mean_entailment": F.avg(entailment), "mean_confidence": F.avg(confidence)} | missing, [entailment, confidence, *texts])
