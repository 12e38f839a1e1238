"""Queries of the reports over several groupings, and of the checks' counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudence.functions.values import in_range
from prudence.operators import correctness, labels, summaries, validate
from prudence.plans import surrogate as S
from prudence.plans.catalog import _IMPACT, _TASK, WITH_D, _selective, answered_pairs, decided, impacted, query


@query(f"""{_TASK}, g AS (SELECT *, unnest(['all', CASE WHEN is_answerable THEN 'answerable' ELSE 'unanswerable' END]) AS subset FROM k), each AS ({_selective('subset,', 'g')} GROUP BY subset)
    SELECT 'pairs' AS system, 'lexical' AS model, 'unknown' AS split, * FROM each""")
def native_baseline_summary(spark, sf_dir):
    df = correctness.task_correctness(answered_pairs(spark, sf_dir)).withColumns({"system": F.lit("pairs"), "model": F.lit("lexical"), "split": F.lit(None).cast("string")})
    return summaries.native_summary(df)


def _policy(p: str, column: str) -> str:
    each = ", ".join(f"count(*) FILTER ({column} = '{k.upper()}') AS {p}_{k}_count, round(count(*) FILTER ({column} = '{k.upper()}') / count(*), 9) AS {p}_{k}_rate, round(count(*) FILTER ({column} = '{k.upper()}' AND correct) / nullif(count(*) FILTER ({column} = '{k.upper()}'), 0), 9) AS {p}_{k}_accuracy" for k in ("answer", "verify", "abstain"))
    return f"{each}, round(1 - {_accuracy(column)}, 9) AS {p}_selective_risk"


def _accuracy(column: str) -> str:
    return f"count(*) FILTER ({column} = 'ANSWER' AND correct) / nullif(count(*) FILTER ({column} = 'ANSWER'), 0)"


_DIFF = f"{_accuracy('final_decision')} - {_accuracy('threshold_decision')}"


@query(f"""{WITH_D} SELECT count(*) AS total_predictions, round(count(*) FILTER (correct) / count(*), 9) AS full_coverage_baseline_accuracy, {_policy('verified', 'final_decision')}, {_policy('threshold', 'threshold_decision')},
    round(count(*) FILTER (final_decision = 'ANSWER') / count(*) - count(*) FILTER (threshold_decision = 'ANSWER') / count(*), 9) AS answer_rate_change, round({_DIFF}, 9) AS answer_accuracy_change, round(-({_DIFF}), 9) AS selective_risk_change FROM d""")
def verified_system_summary(spark, sf_dir):
    return summaries.verified_summary(decided(spark, sf_dir))


def _sections(source: str, sections: dict[str, str]) -> str:
    """A row of source for each section, and one for all, as CTE s."""
    each = ", ".join(f"{{'section': '{n}', 'value': ({c})::VARCHAR}}" for n, c in sections.items())
    return f"s AS (SELECT *, u.section AS section, u.value AS value FROM (SELECT *, unnest([{{'section': 'all', 'value': NULL::VARCHAR}}, {each}]) AS u FROM {source}))"


_LABEL = "CASE WHEN contradiction >= 0.5 THEN 'CONTRADICTION' WHEN entailment >= 0.5 THEN 'ENTAILMENT' WHEN entailment = greatest(entailment, neutral, contradiction) THEN 'ENTAILMENT' WHEN neutral = greatest(entailment, neutral, contradiction) THEN 'NEUTRAL' ELSE 'CONTRADICTION' END"
_DISAGREE = "CASE WHEN NOT correct AND entailment >= 0.8 THEN 'incorrect_high_entailment' WHEN correct AND entailment <= 0.2 THEN 'correct_low_entailment' WHEN confidence >= 0.8 AND entailment <= 0.2 THEN 'high_confidence_low_entailment' WHEN confidence <= 0.2 AND entailment >= 0.8 THEN 'low_confidence_high_entailment' ELSE 'none' END"


def _bin(x: str) -> str:
    return f"least(floor({x} * 10), 9)::INTEGER"


def labelled(spark, sf_dir):
    return S.events(spark, sf_dir).withColumn("qa_nli_label", labels.nli_label_v2(F.col("entailment"), F.col("neutral"), F.col("contradiction")))


@query(f"""WITH {S.WITH_E}, {_sections('e', {'label': _LABEL, 'claim_valid': 'claim_valid', 'answerable': 'is_answerable', 'entailment_bin': _bin('entailment'), 'confidence_bin': _bin('confidence'), 'disagreement': _DISAGREE})}
    SELECT section, value, count(*) AS count, round(count(*) / (SELECT count(*) FROM e), 9) AS rate, count(*) FILTER (correct) AS correct_count, round(count(*) FILTER (correct) / count(*), 9) AS accuracy, round(avg(entailment), 9) AS mean_entailment, round(avg(confidence), 9) AS mean_confidence FROM s GROUP BY section, value""")
def question_aware_report(spark, sf_dir):
    return summaries.question_aware_report(labelled(spark, sf_dir))


_ERRORS = "CASE row_idx % 4 WHEN 0 THEN 'CORRECT_EXACT' WHEN 1 THEN 'MINOR_SPAN_MISMATCH' WHEN 2 THEN 'PARTIAL_ANSWER' ELSE 'WRONG_ANSWER' END"


@query(f"""{WITH_D}, {_IMPACT}, y AS (SELECT *, {_ERRORS} AS answer_error_type, correct AS strict, correct OR row_idx % 5 = 0 AS relaxed FROM x), {_sections('y', {'evidence_support': 'evidence_support', 'category': 'diagnostic_category', 'answer_error_type': 'answer_error_type'})}
    SELECT section, value, count(*) AS count, round(count(*) / (SELECT count(*) FROM y), 9) AS rate, count(*) FILTER (strict) AS strict_correct, count(*) FILTER (relaxed) AS relaxed_correct, round(count(*) FILTER (strict) / count(*), 9) AS strict_accuracy, round(count(*) FILTER (relaxed) / count(*), 9) AS relaxed_accuracy FROM s GROUP BY section, value""")
def evidence_error_report(spark, sf_dir):
    df = impacted(spark, sf_dir).withColumns({"answer_error_type": F.expr(_ERRORS), "strict_correct": F.col("correct"), "relaxed_correct": F.expr("correct OR row_idx % 5 = 0")})
    return summaries.evidence_error_report(df)


_NOTE = "CASE row_idx % 3 WHEN 0 THEN ' ' WHEN 1 THEN event_type END"


@query(f"""WITH {S.WITH_E}, w AS (SELECT *, {_NOTE} AS note FROM e WHERE NOT correct AND entailment >= 0.8), {_sections('w', {'nli_label': _LABEL, 'claim_validity': 'claim_valid'})}
    SELECT section, value, count(*) AS count, round(avg(entailment), 9) AS mean_entailment, round(avg(confidence), 9) AS mean_confidence, count(*) FILTER (trim(coalesce(event_type, '')) = '') AS missing_event_type, count(*) FILTER (trim(coalesce(note, '')) = '') AS missing_note FROM s GROUP BY section, value""")
def investigation_summary(spark, sf_dir):
    return summaries.investigation_summary(labelled(spark, sf_dir).withColumn("note", F.expr(_NOTE)), texts=("event_type", "note"))


@query(f"""{WITH_D}, c AS (SELECT *, CASE WHEN row_idx % 50 = 0 THEN confidence + 1 WHEN row_idx % 50 = 1 THEN NULL ELSE confidence END AS p, CASE WHEN row_idx % 30 = 0 THEN 'VERIFY' ELSE final_decision END AS f, CASE WHEN row_idx % 40 = 0 THEN '' ELSE lower(threshold_decision) END AS other FROM d),
    n AS (SELECT count(*) AS total, count(*) FILTER (NOT coalesce(p BETWEEN 0 AND 1, false)) AS a, count(*) FILTER (f <> final_decision) AS b, count(*) FILTER (other <> '' AND upper(other) <> threshold_decision) AS c, count(*) FILTER (NOT coalesce(abs(p - confidence) <= 1e-9, false)) AS e FROM c)
    SELECT unnest(['p between 0 and 1', 'final decisions follow the policy', 'decision fields agree', 'p equals its recomputation']) AS "check", unnest([a, b, c, e]) AS failed, total FROM n""")
def check_failures(spark, sf_dir):
    """Rows that break each of four checks, counted in one pass."""
    df = decided(spark, sf_dir).withColumn("p", F.expr("CASE WHEN row_idx % 50 = 0 THEN confidence + 1 WHEN row_idx % 50 = 1 THEN NULL ELSE confidence END"))
    df = df.withColumn("f", F.when(F.col("row_idx") % 30 == 0, "VERIFY").otherwise(F.col("final_decision"))).withColumn("other", F.when(F.col("row_idx") % 40 == 0, "").otherwise(F.lower("threshold_decision")))
    checks = {"p between 0 and 1": in_range(F.col("p"))} | validate.resolved_as_expected(after="f") | validate.agreeing_decisions(["threshold_decision", "other"]) | validate.recomputed("p", F.col("confidence"))
    return validate.failures(df, checks)
