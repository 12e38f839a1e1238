"""All registered queries of the reference's operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions.values import gated, geometric_mean, sigmoid, signed_to_unit
from prudence.operators import calibration, correctness, diagnostics, labels, lookup, metrics, ranking, reports, resample, validate
from prudence.plans import surrogate as S
from prudence.plans import text_sql as X
from prudence.streaming.counts import windowed_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COVERAGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SEEDS = tuple(range(20))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, since sums depend on their order."""
    return df.select(*(F.round(F.col(f"`{n}`"), 9).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def query(oracle: str | None = None):
    """Register a function as a query under its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- five methods over the labels ----------------------------------------------------------------------------------


def scores() -> dict[str, Column]:
    c, e, s = F.col("confidence"), gated(F.col("claim_valid"), F.col("entailment")), signed_to_unit(F.col("self_score"))
    return {"confidence": c, "question_aware": e, "confidence_question_aware": geometric_mean(c, e), "self_verifier": s, "confidence_self": geometric_mean(c, s)}


_GATED, _UNIT = "CASE WHEN claim_valid THEN entailment ELSE 0.0 END", "((self_score + 1) / 2)"
_SCORES = {"confidence": "confidence", "question_aware": _GATED, "confidence_question_aware": f"sqrt(confidence * {_GATED})", "self_verifier": _UNIT, "confidence_self": f"sqrt(confidence * {_UNIT})"}


def with_methods(source: str) -> str:
    """Common table expressions m (long form of the scores) and c (ranked prefixes)."""
    each = " UNION ALL ".join(f"SELECT row_idx, correct, '{n}' AS method, cast({s} AS double) AS score FROM {source}" for n, s in _SCORES.items())
    return f"""m AS ({each}),
        c AS MATERIALIZED (SELECT method, row_idx, score, row_number() OVER w AS answered, cast(sum(cast(correct AS int)) OVER (w ROWS UNBOUNDED PRECEDING) AS bigint) AS k, count(*) OVER (PARTITION BY method) AS n
              FROM m WINDOW w AS (PARTITION BY method ORDER BY score DESC, row_idx))"""


WITH_PM, WITH_EM = f"WITH {S.WITH_P}, {with_methods('p')}", f"WITH {S.WITH_E}, {with_methods('e')}"


def long(df: DataFrame) -> DataFrame:
    return ranking.methods(df, scores())


@query(f"{WITH_PM} SELECT method, row_idx, round(score, 9) AS score, answered, k AS correct_answered FROM c")
def rank_rows(spark, sf_dir):
    return ranking.ranked(long(S.labels(spark, sf_dir))).select("method", "row_idx", "score", "answered", "correct_answered")


@query(f"{WITH_PM} SELECT method, row_idx, answered, round(answered / n, 9) AS coverage, round(k / answered, 9) AS selective_accuracy, round((answered - k) / answered, 9) AS risk, answered - k AS wrong_answered, round(score, 9) AS minimum_score, n FROM c")
def risk_coverage_curve(spark, sf_dir):
    return ranking.risk_coverage(long(S.labels(spark, sf_dir)))


@query(f"""{WITH_PM} SELECT method, answered, round(answered / n, 9) AS coverage, round(k / answered, 9) AS selective_accuracy, round((answered - k) / answered, 9) AS risk, answered - k AS wrong_answered, n FROM c
    UNION ALL SELECT DISTINCT method, 0, 0.0, 1.0, 0.0, 0, n FROM c""")
def risk_coverage_with_zero(spark, sf_dir):
    return ranking.with_zero_point(ranking.risk_coverage(long(S.labels(spark, sf_dir)))).drop("row_idx", "minimum_score")


_SUMMARY = """, s AS (SELECT method, max(n) AS n, max(k) AS r, avg((answered - k) / answered) AS aurc FROM c GROUP BY method),
    h AS (SELECT s.*, (SELECT coalesce(sum((x - s.r) / x), 0) FROM range(s.r + 1, s.n + 1) g(x)) / n AS optimal FROM s)"""


@query(f"{WITH_EM}{_SUMMARY} SELECT method, n, round(aurc, 9) AS aurc FROM h")
def aurc_summary(spark, sf_dir):
    return ranking.aurc_summary(long(S.events(spark, sf_dir))).select("method", "n", "aurc")


@query(f"""{WITH_PM}{_SUMMARY} SELECT method, n, round(r / n, 9) AS accuracy, round(aurc, 9) AS aurc, round(optimal, 9) AS optimal_aurc, round(1 - r / n, 9) AS random_aurc,
    CASE WHEN abs(1 - r / n - optimal) > 1e-12 THEN round((aurc - optimal) / (1 - r / n - optimal), 9) END AS normalized_aurc FROM h""")
def normalized_aurc(spark, sf_dir):
    return ranking.aurc_summary(long(S.labels(spark, sf_dir)))


def _values(xs, name: str) -> str:
    return f"(SELECT unnest([{', '.join(f'{float(x)}e0' for x in xs)}]) AS {name})"


@query(f"""{WITH_EM}, w AS (SELECT method, n, target_coverage, cast(greatest(1, ceil(target_coverage * n)) AS bigint) AS answered, wrong FROM (SELECT method, count(*) AS n, count(*) FILTER (NOT correct) AS wrong FROM m GROUP BY method), {_values(COVERAGES, 'target_coverage')})
    SELECT c.method, target_coverage, c.n, c.answered, c.n - c.answered AS abstained, round(c.answered / c.n, 9) AS coverage, k AS correct_answered, c.answered - k AS wrong_answered, round(k / c.answered, 9) AS selective_accuracy,
    round((c.answered - k) / c.answered, 9) AS risk, wrong - (c.answered - k) AS wrong_rejected, c.n - c.answered - wrong + (c.answered - k) AS correct_rejected, round((wrong - (c.answered - k)) / nullif(wrong, 0), 9) AS wrong_rejected_share, round(score, 9) AS minimum_score
    FROM c JOIN w ON c.method = w.method AND c.answered = w.answered""")
def matched_coverage(spark, sf_dir):
    return ranking.matched_coverage(long(S.events(spark, sf_dir)), COVERAGES)


@query(f"""WITH {S.WITH_P}, o AS (SELECT *, row_number() OVER (ORDER BY md5('17:' || row_idx), row_idx) AS place FROM p), z AS (SELECT o.*, sample_size FROM o, (SELECT unnest([200, 500, 1000, 2000, 3000]) AS sample_size) WHERE place <= sample_size AND sample_size <= (SELECT count(*) FROM p)),
    c AS (SELECT sample_size, row_number() OVER w AS a, sum(cast(correct AS int)) OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM z WINDOW w AS (PARTITION BY sample_size ORDER BY confidence DESC, row_idx))
    SELECT sample_size, count(*) AS n, round(avg((a - k) / a), 9) AS aurc FROM c GROUP BY sample_size""")
def nested_sample_sizes(spark, sf_dir):
    rows = S.labels(spark, sf_dir)
    n = rows.count()
    # sizes beyond the table are left out; of one smaller than all, nothing is left
    nested = ranking.nested_samples(rows, [k for k in (200, 500, 1000, 2000, 3000) if k <= n] or [200]).where(F.col("sample_size") <= n)
    return ranking.risk_coverage(nested, ["sample_size"], "confidence").groupBy("sample_size").agg(F.count("*").alias("n"), F.avg("risk").alias("aurc"))


@query(f"WITH {S.WITH_P} SELECT row_idx, place FROM (SELECT row_idx, row_number() OVER (ORDER BY md5('17:' || row_idx), row_idx) AS place FROM p) WHERE place <= 50")
def nested_order(spark, sf_dir):
    return ranking.nested_samples(S.labels(spark, sf_dir), (50,)).select("row_idx", F.col("order_rank").cast("long").alias("place"))


_SWEEP = f"""SELECT threshold, count(*) AS total, count(*) FILTER (confidence >= threshold) AS answered, count(*) FILTER (confidence >= threshold AND correct) AS k FROM e, {_values(THRESHOLDS, 'threshold')} GROUP BY threshold"""


@query(f"""WITH {S.WITH_E}, s AS ({_SWEEP}) SELECT threshold, total, answered, total - answered AS abstained, round(answered / total, 9) AS coverage, CASE WHEN answered > 0 THEN round(k / answered, 9) ELSE 1.0 END AS selective_accuracy,
    CASE WHEN answered > 0 THEN round((answered - k) / answered, 9) ELSE 0.0 END AS selective_risk, k AS correct_answered, answered - k AS wrong_answered FROM s""")
def threshold_sweep(spark, sf_dir):
    return ranking.threshold_sweep(S.events(spark, sf_dir), THRESHOLDS, "confidence")


def sweep_points(spark, sf_dir) -> DataFrame:
    return ranking.threshold_sweep(S.events(spark, sf_dir), THRESHOLDS, "confidence").select("coverage", F.col("selective_risk").alias("risk"))


_POINTS = f"WITH {S.WITH_E}, s AS ({_SWEEP}), q AS (SELECT answered / total AS coverage, CASE WHEN answered > 0 THEN (answered - k) / answered ELSE 0.0 END AS risk FROM s)"
TARGETS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(f"""{_POINTS} SELECT target_coverage, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM q, {_values(TARGETS, 'target_coverage')}
    QUALIFY row_number() OVER (PARTITION BY target_coverage ORDER BY abs(coverage - target_coverage), coverage, risk) = 1""")
def nearest_coverage_low(spark, sf_dir):
    return ranking.nearest_coverage(sweep_points(spark, sf_dir), TARGETS, larger_on_tie=False)


@query(f"""{_POINTS} SELECT target_coverage, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM q, {_values(TARGETS, 'target_coverage')} WHERE coverage > 0
    QUALIFY row_number() OVER (PARTITION BY target_coverage ORDER BY abs(coverage - target_coverage), coverage DESC, risk) = 1""")
def nearest_coverage_high(spark, sf_dir):
    return ranking.nearest_coverage(sweep_points(spark, sf_dir), TARGETS, larger_on_tie=True, positive_only=True)


@query(f"{_POINTS}, d AS (SELECT DISTINCT coverage, risk FROM q), l AS (SELECT coverage - lag(coverage) OVER w AS dx, risk + lag(risk) OVER w AS y FROM d WINDOW w AS (ORDER BY coverage)) SELECT round(coalesce(sum(dx * y / 2), 0), 9) AS area FROM l")
def trapezoid_area(spark, sf_dir):
    return ranking.trapezoid_area(sweep_points(spark, sf_dir).distinct())


@query(f"""{WITH_EM}, w AS (SELECT method, target_coverage, cast(greatest(1, ceil(target_coverage * n)) AS bigint) AS answered FROM (SELECT DISTINCT method, n FROM c), {_values(COVERAGES, 'target_coverage')}),
    r AS (SELECT c.method, target_coverage, (c.answered - k) / c.answered AS risk FROM c JOIN w ON c.method = w.method AND c.answered = w.answered)
    SELECT target_coverage, method AS best_method, round(risk, 9) AS best_risk FROM r QUALIFY row_number() OVER (PARTITION BY target_coverage ORDER BY risk, list_position([{', '.join(repr(k) for k in _SCORES)}], method)) = 1""")
def best_method(spark, sf_dir):
    return ranking.best_method(ranking.matched_coverage(long(S.events(spark, sf_dir)), COVERAGES), list(_SCORES))


# --- text ------------------------------------------------------------------------------------------------------------

ANSWERABLE, DECISION = "(row_idx % 4 <> 0)", "CASE WHEN row_idx % 3 = 0 THEN 'ABSTAIN' ELSE 'ANSWER' END"
REFERENCES = "CASE WHEN row_idx % 4 = 0 THEN [] WHEN row_idx % 2 = 0 THEN [question, 'The ' || answer || '!'] ELSE [question, answer || ' indeed'] END"
WITH_R = f"WITH {S.WITH_T}, r AS (SELECT *, {ANSWERABLE} AS is_answerable, {DECISION} AS decision, {REFERENCES} AS refs FROM t)"


def answered_pairs(spark, sf_dir) -> DataFrame:
    refs = F.expr("CASE WHEN row_idx % 4 = 0 THEN cast(array() as array<string>) WHEN row_idx % 2 = 0 THEN array(question, concat('The ', answer, '!')) ELSE array(question, concat(answer, ' indeed')) END")
    return S.pairs(spark, sf_dir).select("row_idx", "question", F.col("answer").alias("prediction_text"), F.expr(ANSWERABLE).alias("is_answerable"), F.expr(DECISION).alias("decision"), refs.alias("reference_answers"))


@query(f"WITH {S.WITH_T} SELECT row_idx, array_to_string({X.answer_tokens('answer')}, ' ') AS normalized, array_to_string({X.plain_tokens('answer')}, ' ') AS plain, array_to_string({X.claim_tokens('answer')}, ' ') AS comparable FROM t")
def normalize_text(spark, sf_dir):
    a = F.col("answer")
    return S.pairs(spark, sf_dir).select("row_idx", T.normalize_answer(a).alias("normalized"), T.normalize_plain(a).alias("plain"), T.normalize_for_comparison(a).alias("comparable"))


@query(f"{WITH_R} SELECT row_idx, {X.exact_match('answer', 'refs')} AS exact_match FROM r")
def exact_match(spark, sf_dir):
    return answered_pairs(spark, sf_dir).select("row_idx", T.exact_match(F.col("prediction_text"), F.col("reference_answers")).alias("exact_match"))


@query(f"{WITH_R} SELECT row_idx, round({X.best_f1('answer', 'refs')}, 9) AS token_f1 FROM r")
def token_f1_list(spark, sf_dir):
    return answered_pairs(spark, sf_dir).select("row_idx", T.best_f1(F.col("prediction_text"), F.col("reference_answers")).alias("token_f1"))


@query(f"WITH {S.WITH_T} SELECT row_idx, round({X.f1('answer', 'question', 1)}, 9) AS token_f1 FROM t")
def token_f1_pair(spark, sf_dir):
    return S.pairs(spark, sf_dir).select("row_idx", T.f1_pair(F.col("answer"), F.col("question")).alias("token_f1"))


@query(f"WITH {S.WITH_T} SELECT row_idx, round({X.f1('answer', 'question', 0)}, 9) AS overlap_f1 FROM t")
def overlap_f1(spark, sf_dir):
    return S.pairs(spark, sf_dir).select("row_idx", T.overlap_f1(F.col("answer"), F.col("question")).alias("overlap_f1"))


_TASK = f"""{WITH_R}, s AS (SELECT *, CASE WHEN decision = 'ANSWER' AND is_answerable THEN {X.exact_match('answer', 'refs')} ELSE 0e0 END AS em, CASE WHEN decision = 'ANSWER' AND is_answerable THEN {X.best_f1('answer', 'refs')} ELSE 0e0 END AS f1 FROM r),
    k AS (SELECT *, CASE WHEN decision = 'ANSWER' THEN em = 1 ELSE NOT is_answerable END AS ok FROM s)"""


@query(f"{_TASK} SELECT row_idx, decision, is_answerable, em AS exact_match, round(f1, 9) AS token_f1, ok AS is_correct FROM k")
def task_correctness(spark, sf_dir):
    return correctness.task_correctness(answered_pairs(spark, sf_dir)).select("row_idx", "decision", "is_answerable", "exact_match", "token_f1", "is_correct")


@query(f"{WITH_R} SELECT row_idx, is_answerable AND {X.exact_match('answer', 'refs')} = 1 AS is_correct FROM r")
def forced_correctness(spark, sf_dir):
    return answered_pairs(spark, sf_dir).select("row_idx", correctness.forced_correctness(F.col("prediction_text"), F.col("reference_answers"), F.col("is_answerable")).alias("is_correct"))


@query(f"{WITH_R} SELECT row_idx, CASE WHEN is_answerable THEN {X.exact_match('answer', 'refs')} = 1 ELSE decision = 'ABSTAIN' END AS is_correct FROM r")
def inferred_correctness(spark, sf_dir):
    return answered_pairs(spark, sf_dir).select("row_idx", correctness.inferred_correctness(F.col("prediction_text"), F.col("reference_answers"), F.col("is_answerable"), F.col("decision")).alias("is_correct"))


@query(f"{WITH_R} SELECT row_idx, is_answerable AND ({X.exact_match('answer', 'refs')} = 1 OR {X.best_f1('answer', 'refs', 1)} >= 0.8) AS is_correct FROM r")
def relaxed_correctness(spark, sf_dir):
    return answered_pairs(spark, sf_dir).select("row_idx", correctness.relaxed_correctness(F.col("prediction_text"), F.col("reference_answers"), F.col("is_answerable")).alias("is_correct"))


@query(f"{WITH_R}, f AS (SELECT row_idx, is_answerable, {X.exact_match('answer', 'refs')} AS em, {X.best_f1('answer', 'refs')} AS f1 FROM r) SELECT row_idx, {X.error_type('is_answerable', 'em', 'f1')} AS error_type FROM f")
def answer_error_types(spark, sf_dir):
    df = answered_pairs(spark, sf_dir)
    p, r = F.col("prediction_text"), F.col("reference_answers")
    return df.select("row_idx", labels.answer_error_type(F.col("is_answerable"), T.exact_match(p, r), T.best_f1(p, r)).alias("error_type"))


def _selective(group: str, source: str = "k") -> str:
    a, b = "decision = 'ANSWER'", "decision = 'ABSTAIN'"
    n = lambda c: f"count(*) FILTER ({c})"
    over = lambda x, y: f"round(coalesce({x} / nullif({y}, 0), 0), 9)"
    total, answered, can, cannot = "count(*)", n(a), n("is_answerable"), n("NOT is_answerable")
    return f"""SELECT {group} {total} AS total, {answered} AS answered, {n(b)} AS abstained, {can} AS answerable_count, {cannot} AS unanswerable_count, {n('ok')} AS total_correct, {n(f'ok AND {a}')} AS answered_correct,
        {n(f'{b} AND NOT is_answerable')} AS correct_abstentions, {n(f'{b} AND is_answerable')} AS unnecessary_abstentions, {n(f'{a} AND NOT is_answerable')} AS answered_unanswerable, {over(n('ok'), total)} AS accuracy, {over(answered, total)} AS coverage,
        {over(n(b), total)} AS abstention_rate, {over(n(f'ok AND {a}'), answered)} AS answered_accuracy, CASE WHEN {answered} > 0 THEN round(1 - {n(f'ok AND {a}')} / {answered}, 9) ELSE 0.0 END AS selective_risk, {over('coalesce(sum(em), 0)', total)} AS exact_match,
        {over('coalesce(sum(f1), 0)', total)} AS token_f1, {over(f'coalesce(sum(em) FILTER ({a}), 0)', answered)} AS answered_exact_match, {over(f'coalesce(sum(f1) FILTER ({a}), 0)', answered)} AS answered_token_f1, {over(n(f'{b} AND is_answerable'), can)} AS unnecessary_abstention_rate,
        {over(n(f'{a} AND NOT is_answerable'), cannot)} AS unanswerable_answer_rate, {over(n(f'{b} AND NOT is_answerable'), cannot)} AS correct_abstention_rate FROM {source}"""


@query(f"{_TASK} {_selective('')}")
def selective_metrics(spark, sf_dir):
    return metrics.selective_metrics(correctness.task_correctness(answered_pairs(spark, sf_dir)))


@query(f"{_TASK}, g AS (SELECT *, unnest(['all', CASE WHEN is_answerable THEN 'answerable' ELSE 'unanswerable' END]) AS subset FROM k) {_selective('subset,', 'g')} GROUP BY subset")
def metrics_by_answerability(spark, sf_dir):
    return metrics.by_answerability(correctness.task_correctness(answered_pairs(spark, sf_dir)))


#: Claims of four kinds: the question, the template, the answer, and the answer with a number.
CLAIM = "CASE row_idx % 4 WHEN 0 THEN question WHEN 1 THEN 'The answer to the question \"' || question || '\" is \"' || answer || '\".' WHEN 2 THEN answer ELSE answer || ' 12' END"


def claims(spark, sf_dir) -> DataFrame:
    return S.pairs(spark, sf_dir).select("row_idx", "question", F.col("answer").alias("prediction_text"), F.expr(CLAIM).alias("qa_claim"))


WITH_C = f"WITH {S.WITH_T}, c AS (SELECT row_idx, question, answer, {CLAIM} AS claim FROM t)"
_CLAIM = f"{WITH_C}, v AS (SELECT row_idx, {X.claim_fields('question', 'answer', 'claim')} FROM c)"


@query(f"{_CLAIM} SELECT row_idx, len(reasons) = 0 AS qa_claim_valid, array_to_string(reasons, ',') AS reasons, round(coverage, 9) AS qa_claim_answer_token_coverage, round(copied, 9) AS qa_claim_question_copy_ratio, n AS qa_claim_token_count FROM v")
def claim_validation(spark, sf_dir):
    out = labels.validated_claims(claims(spark, sf_dir))
    return out.select("row_idx", "qa_claim_valid", F.array_join("qa_claim_validation_reasons", ",").alias("reasons"), "qa_claim_answer_token_coverage", "qa_claim_question_copy_ratio", F.col("qa_claim_token_count").cast("long"))


@query(f"{_CLAIM}, u AS (SELECT unnest(reasons) AS reason FROM v) SELECT reason, count(*) AS count FROM u GROUP BY reason")
def reason_counts(spark, sf_dir):
    return metrics.reason_counts(labels.validated_claims(claims(spark, sf_dir)))


@query(f"{WITH_C} SELECT row_idx, {X.numbers_kept('answer', 'claim')} AS kept FROM c")
def number_preservation(spark, sf_dir):
    return claims(spark, sf_dir).select("row_idx", T.numbers_preserved(F.col("prediction_text"), F.col("qa_claim")).alias("kept"))


@query(f"{WITH_C} SELECT row_idx, {X.negation_kept('question', 'answer', 'claim')} AS kept FROM c")
def negation_preservation(spark, sf_dir):
    return claims(spark, sf_dir).select("row_idx", T.negation_preserved(F.col("question"), F.col("prediction_text"), F.col("qa_claim")).alias("kept"))


@query(f"""WITH {S.WITH_T}, a AS (SELECT *, cast(row_idx % 7 AS double) / 6 AS score, CASE WHEN row_idx % 3 = 0 THEN '' WHEN row_idx % 3 = 1 THEN answer ELSE question END AS other FROM t), f AS (SELECT *, trim(other) = '' AS none, CASE WHEN trim(other) = '' THEN 0.0 ELSE {X.f1('answer', 'other', 0)} END AS f1 FROM a)
    SELECT row_idx, round(f1, 9) AS f1, CASE WHEN none AND score >= 0.5 THEN 'UNSUPPORTED' WHEN none THEN 'UNCERTAIN' WHEN f1 >= 0.8 AND score >= 0.3 THEN 'SUPPORTED' WHEN f1 < 0.2 AND score >= 0.5 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS label FROM f""")
def qa_agreement(spark, sf_dir):
    df = S.pairs(spark, sf_dir).withColumn("score", F.expr("cast(row_idx % 7 as double) / 6")).withColumn("other", F.expr("CASE WHEN row_idx % 3 = 0 THEN '' WHEN row_idx % 3 = 1 THEN answer ELSE question END"))
    return df.withColumn("e", labels.qa_agreement(F.col("answer"), F.col("other"), F.col("score"))).select("row_idx", "e.f1", "e.label")


@query(f"""WITH x AS (SELECT b.item_id, d.doc_id, b.text AS answer, d.text AS context, strpos(lower(d.text), lower(trim(b.text))) - 1 AS place FROM documents d JOIN benchmark b ON strpos(lower(d.text), lower(trim(b.text))) > 0),
    w AS (SELECT *, {X.window('context', 'place', 'place + length(trim(answer))')} AS evidence FROM x),
    s AS (SELECT *, {X.context_score('answer', 'context')} AS cs, {X.overlap('answer', 'evidence')} AS qo FROM w)
    SELECT item_id, doc_id, round(cs, 9) AS answer_context_score, round(qo, 9) AS question_evidence_overlap, round(0.65 * cs + 0.35 * qo, 9) AS evidence_score, CASE WHEN cs >= 1 AND qo >= 0.45 AND 0.65 * cs + 0.35 * qo >= 0.75 THEN 'SUPPORTED' WHEN cs >= 0.5 AND 0.65 * cs + 0.35 * qo >= 0.4 THEN 'WEAK' ELSE 'UNSUPPORTED' END AS evidence_support FROM s""")
def lexical_evidence(spark, sf_dir):
    """Benchmark items as answers (and questions) and the documents that hold them as contexts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("context"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("prediction_text"), F.col("text").alias("question"))
    held = lookup.containing(docs, items, text="prediction_text")
    return labels.lexical_evidence(held).select("item_id", "doc_id", "answer_context_score", "question_evidence_overlap", "evidence_score", "evidence_support")


# --- decisions over events -------------------------------------------------------------------------------------------

_SUPPORT = "CASE WHEN lexical >= 0.7 THEN 'SUPPORTED' WHEN lexical >= 0.4 THEN 'WEAK' ELSE 'UNSUPPORTED' END"
_ROUTE = "CASE WHEN confidence >= 0.7 THEN 'ANSWER' WHEN confidence <= 0.3 THEN 'ABSTAIN' ELSE 'VERIFY' END"
_RESOLVED = f"CASE WHEN threshold_decision <> 'VERIFY' THEN threshold_decision WHEN evidence_support = 'SUPPORTED' THEN 'ANSWER' WHEN evidence_support = 'WEAK' THEN 'VERIFY' ELSE 'ABSTAIN' END"
WITH_D = f"WITH {S.WITH_E}, d AS (SELECT *, {_RESOLVED} AS final_decision FROM (SELECT *, {_ROUTE} AS threshold_decision, {_SUPPORT} AS evidence_support FROM e))"


def decided(spark, sf_dir) -> DataFrame:
    df = S.events(spark, sf_dir).withColumn("threshold_decision", labels.route(F.col("confidence"), 0.3, 0.7)).withColumn("evidence_support", F.expr(_SUPPORT))
    return df.withColumn("final_decision", labels.resolve(F.col("threshold_decision"), F.col("evidence_support")))


@query(f"WITH {S.WITH_E}, x AS (SELECT confidence >= 0.5 AS a FROM e) SELECT count(*) AS total, count(*) FILTER (a) AS answered, count(*) FILTER (NOT a) AS abstained, round(count(*) FILTER (a) / count(*), 9) AS coverage FROM x")
def confidence_threshold(spark, sf_dir):
    df = S.events(spark, sf_dir).select(F.col("confidence").alias("pipeline_score"), F.lit("x").alias("prediction_text"))
    return metrics.decision_summary(correctness.threshold_answer(df, 0.5))


@query(f"{WITH_D} SELECT threshold_decision, count(*) AS count FROM d GROUP BY threshold_decision")
def route_three_way(spark, sf_dir):
    return metrics.value_counts(decided(spark, sf_dir), "threshold_decision")


@query(f"{WITH_D} SELECT row_idx, final_decision FROM d")
def resolve_verify(spark, sf_dir):
    return decided(spark, sf_dir).select("row_idx", "final_decision")


def _group(key: str, domain) -> str:
    return f"""g AS (SELECT {key}, count(*) AS n, count(*) FILTER (correct) AS r, avg(confidence) AS mc FROM d GROUP BY {key})
    SELECT x.{key}, coalesce(n, 0) AS count, round(coalesce(n, 0) / (SELECT count(*) FROM d), 9) AS rate, coalesce(r, 0) AS correct_count, round(r / n, 9) AS accuracy, round((n - r) / n, 9) AS risk, round(mc, 9) AS mean_confidence
    FROM (SELECT unnest({list(domain)}) AS {key}) x LEFT JOIN g ON x.{key} = g.{key}"""


@query(f"{WITH_D}, {_group('final_decision', labels.DECISIONS)}")
def decision_groups(spark, sf_dir):
    return metrics.group_metrics(decided(spark, sf_dir), "final_decision", labels.DECISIONS, means=["confidence"])


@query(f"{WITH_D}, {_group('evidence_support', labels.SUPPORT)}")
def evidence_groups(spark, sf_dir):
    return metrics.group_metrics(decided(spark, sf_dir), "evidence_support", labels.SUPPORT, means=["confidence"])


@query(f"""{WITH_D}, o AS (SELECT count(*) AS n, count(*) FILTER (correct) AS r, count(*) FILTER (threshold_decision = 'ANSWER') AS nb, count(*) FILTER (threshold_decision = 'ANSWER' AND correct) AS cb, count(*) FILTER (final_decision = 'ANSWER') AS na, count(*) FILTER (final_decision = 'ANSWER' AND correct) AS ca FROM d)
    SELECT n AS total, round(r / n, 9) AS baseline_accuracy, round(nb / n, 9) AS threshold_coverage, round(cb / nb, 9) AS threshold_accuracy, round(na / n, 9) AS final_coverage, round(ca / na, 9) AS final_accuracy, round(na / n - nb / n, 9) AS coverage_change, round(ca / na - cb / nb, 9) AS accuracy_change FROM o""")
def policy_comparison(spark, sf_dir):
    return metrics.policy_comparison(decided(spark, sf_dir))


_SYSTEMS = {"confidence": "confidence >= 0.5", "lexical": "lexical >= 0.7", "entailment": "entailment >= 0.7"}


@query(f"""WITH {S.WITH_E}, x AS ({' UNION ALL '.join(f"SELECT '{n}' AS system, {c} AS a, correct, is_answerable FROM e" for n, c in _SYSTEMS.items())})
    SELECT system, count(*) AS total, count(*) FILTER (a) AS answered, count(*) FILTER (a AND correct) AS answered_correct, count(*) FILTER (a AND NOT correct) AS answered_wrong, count(*) FILTER (NOT a AND correct) AS abstained_correct, count(*) FILTER (NOT a AND NOT correct) AS abstained_wrong, count(*) FILTER (a AND NOT is_answerable) AS answered_unanswerable,
    round(count(*) FILTER (a) / count(*), 9) AS coverage, round(count(*) FILTER (a AND correct) / count(*) FILTER (a), 9) AS selective_accuracy, round(count(*) FILTER (a AND NOT correct) / count(*) FILTER (a), 9) AS selective_risk, round(count(*) FILTER (a = correct) / count(*), 9) AS routing_accuracy FROM x GROUP BY system""")
def system_metrics(spark, sf_dir):
    return metrics.system_metrics(S.events(spark, sf_dir), {n: F.expr(c) for n, c in _SYSTEMS.items()})


_CATEGORY = """CASE WHEN final_decision = 'ANSWER' THEN CASE WHEN correct THEN 'CORRECT_ANSWER' ELSE 'UNSAFE_WRONG_ANSWER' END WHEN final_decision = 'ABSTAIN' THEN CASE WHEN NOT is_answerable THEN 'CORRECT_UNANSWERABLE_ABSTENTION' WHEN correct THEN 'UNNECESSARY_ABSTENTION' ELSE 'PROTECTIVE_ABSTENTION' END
    WHEN correct THEN 'VERIFY_CORRECT_PREDICTION' ELSE 'VERIFY_INCORRECT_PREDICTION' END"""


def categorised(spark, sf_dir) -> DataFrame:
    df = decided(spark, sf_dir)
    return df.withColumn("error_category", labels.error_category(F.col("final_decision"), F.col("is_answerable"), F.col("correct")))


@query(f"{WITH_D}, x AS (SELECT {_CATEGORY} AS error_category FROM d) SELECT error_category, count(*) AS count FROM x GROUP BY error_category")
def error_categories(spark, sf_dir):
    return metrics.value_counts(categorised(spark, sf_dir), "error_category")


@query(f"""{WITH_D}, x AS (SELECT {_CATEGORY} AS k FROM d), o AS (SELECT count(*) AS total, count(*) FILTER (k = 'CORRECT_ANSWER') AS correct_answers, count(*) FILTER (k = 'UNSAFE_WRONG_ANSWER') AS unsafe_answers, count(*) FILTER (k = 'UNNECESSARY_ABSTENTION') AS unnecessary_abstentions,
    count(*) FILTER (k IN ('PROTECTIVE_ABSTENTION', 'CORRECT_UNANSWERABLE_ABSTENTION')) AS useful_abstentions, count(*) FILTER (k LIKE 'VERIFY%') AS verify FROM x) SELECT *, round(coalesce(unsafe_answers / nullif(unsafe_answers + correct_answers, 0), 0), 9) AS unsafe_rate, round(coalesce(unnecessary_abstentions / nullif(unnecessary_abstentions + useful_abstentions, 0), 0), 9) AS unnecessary_rate FROM o""")
def error_summary(spark, sf_dir):
    return metrics.error_summary(categorised(spark, sf_dir))


@query(f"{WITH_D} SELECT CASE WHEN correct THEN 'CORRECT_' ELSE 'WRONG_' END || evidence_support AS evidence_category, count(*) AS count FROM d GROUP BY 1")
def evidence_categories(spark, sf_dir):
    df = decided(spark, sf_dir).withColumn("evidence_category", labels.evidence_category(F.col("correct"), F.col("evidence_support")))
    return metrics.value_counts(df, "evidence_category")


_CASE = "CASE WHEN threshold_decision <> 'VERIFY' THEN 'other_transition' ELSE 'verify_' || CASE WHEN correct THEN 'correct' ELSE 'incorrect' END || CASE final_decision WHEN 'ANSWER' THEN '_promoted_to_answer' WHEN 'ABSTAIN' THEN '_blocked' ELSE '_preserved' END END"
_IMPACT = f"x AS (SELECT *, threshold_decision || '_TO_' || final_decision AS transition, {_CASE} AS diagnostic_category FROM d)"


def impacted(spark, sf_dir) -> DataFrame:
    b, a = F.col("threshold_decision"), F.col("final_decision")
    return decided(spark, sf_dir).withColumn("transition", labels.transition(b, a)).withColumn("diagnostic_category", labels.transition_case(b, a, F.col("correct")))


@query(f"{WITH_D}, {_IMPACT} SELECT transition, count(*) AS count FROM x GROUP BY transition")
def transitions(spark, sf_dir):
    return metrics.value_counts(impacted(spark, sf_dir), "transition")


@query(f"""{WITH_D}, {_IMPACT}, y AS (SELECT 'transition' AS grouping, transition AS value, * FROM x UNION ALL SELECT 'evidence_support', evidence_support, * FROM x UNION ALL SELECT 'diagnostic_category', diagnostic_category, * FROM x)
    SELECT "grouping", value, count(*) AS count, round(count(*) / (SELECT count(*) FROM d), 9) AS rate, count(*) FILTER (correct) AS correct_count, round(count(*) FILTER (NOT correct) / count(*), 9) AS risk, round(avg(confidence), 9) AS mean_confidence, round(avg(lexical), 9) AS mean_lexical FROM y GROUP BY "grouping", value""")
def evidence_impact(spark, sf_dir):
    return metrics.group_impact(impacted(spark, sf_dir), ["transition", "evidence_support", "diagnostic_category"], means=["confidence", "lexical"])


_V = {f"{c}_{w}": f"count(*) FILTER (diagnostic_category = 'verify_{c}_{w}')" for c in ("correct", "incorrect") for w in ("promoted_to_answer", "blocked", "preserved")}


@query(f"""{WITH_D}, {_IMPACT}, o AS (SELECT {', '.join(f'{v} AS verify_{k}' for k, v in _V.items())} FROM x), s AS (SELECT *, verify_correct_promoted_to_answer + verify_correct_blocked + verify_correct_preserved AS r, verify_incorrect_promoted_to_answer + verify_incorrect_blocked + verify_incorrect_preserved AS w FROM o)
    SELECT r + w AS verify_predictions, * EXCLUDE (r, w), round(verify_correct_promoted_to_answer / nullif(verify_correct_promoted_to_answer + verify_incorrect_promoted_to_answer, 0), 9) AS promotion_precision, round(verify_incorrect_blocked / nullif(w, 0), 9) AS beneficial_block_rate, round(verify_correct_blocked / nullif(r, 0), 9) AS harmful_block_rate,
    round((verify_correct_promoted_to_answer + verify_incorrect_promoted_to_answer + verify_correct_blocked + verify_incorrect_blocked) / nullif(r + w, 0), 9) AS resolved_rate, round((verify_correct_preserved + verify_incorrect_preserved) / nullif(r + w, 0), 9) AS preserved_rate FROM s""")
def verify_impact(spark, sf_dir):
    return metrics.verify_impact(impacted(spark, sf_dir))


# --- labels of verifiers over events ---------------------------------------------------------------------------------

_HYBRID = "least(greatest(0.25e0 * confidence + 0.25e0 * lexical + 0.5e0 * entailment, 0.0), 1.0)"


@query(f"WITH {S.WITH_E}, h AS (SELECT *, {_HYBRID} AS s FROM e) SELECT row_idx, round(s, 9) AS hybrid_score, CASE WHEN contradiction >= 0.7 THEN 'UNSUPPORTED' WHEN s >= 0.7 THEN 'SUPPORTED' WHEN s >= 0.4 THEN 'WEAK' ELSE 'UNSUPPORTED' END AS hybrid_support FROM h")
def hybrid_score(spark, sf_dir):
    s = labels.hybrid_score(F.col("confidence"), F.col("lexical"), F.col("entailment"))
    return S.events(spark, sf_dir).select("row_idx", s.alias("hybrid_score"), labels.hybrid_support(s, F.col("contradiction")).alias("hybrid_support"))


def _ablation(name: str) -> str:
    *w, against = diagnostics.ABLATIONS[name]
    a, b, c = (f"{x / sum(w)!r}e0" for x in w)
    s = f"least(greatest({a} * confidence + {b} * lexical + {c} * entailment, 0.0), 1.0)"
    return f"SELECT '{name}' AS config, correct, {s} AS s, {'contradiction < 0.7 AND' if against else ''} {s} >= 0.7 AS a FROM e"


@query(f"""WITH {S.WITH_E}, x AS ({' UNION ALL '.join(map(_ablation, diagnostics.ABLATIONS))}), o AS (SELECT config, count(*) AS total, count(*) FILTER (a) AS answered, count(*) FILTER (a AND correct) AS answered_correct, avg(s) AS ms FROM x GROUP BY config),
    r AS (SELECT *, answered / total AS c, coalesce((answered - answered_correct) / nullif(answered, 0), 0) AS k FROM o), f AS (SELECT c AS fc, k AS fk FROM r WHERE config = 'full_hybrid')
    SELECT config, total, answered, answered_correct, round(ms, 9) AS mean_score, round(c, 9) AS coverage, round(k, 9) AS selective_risk, round(c - fc, 9) AS coverage_change, round(k - fk, 9) AS risk_change FROM r, f""")
def hybrid_ablation(spark, sf_dir):
    return diagnostics.hybrid_ablation(S.events(spark, sf_dir))


_THREE = ("entailment", "neutral", "contradiction")


def _argmax(order: str) -> str:
    best = "greatest(entailment, neutral, contradiction)"
    return "CASE WHEN contradiction >= 0.5 THEN 'CONTRADICTION' WHEN entailment >= 0.5 THEN 'ENTAILMENT' " + " ".join(f"WHEN {n} = {best} THEN '{n.upper()}'" for n in order.split()) + " END"


@query(f"WITH {S.WITH_E} SELECT row_idx, {_argmax('contradiction entailment neutral')} AS label FROM e")
def nli_label_v1(spark, sf_dir):
    return S.events(spark, sf_dir).select("row_idx", labels.nli_label_v1(*map(F.col, _THREE)).alias("label"))


@query(f"WITH {S.WITH_E} SELECT row_idx, {_argmax('entailment neutral contradiction')} AS label FROM e")
def nli_label_v2(spark, sf_dir):
    return S.events(spark, sf_dir).select("row_idx", labels.nli_label_v2(*map(F.col, _THREE)).alias("label"))


@query(f"WITH {S.WITH_E} SELECT row_idx, round(entailment - contradiction, 9) AS score, CASE WHEN contradiction >= 0.7 THEN 'REJECTED' WHEN entailment >= 0.7 THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS label FROM e")
def self_label(spark, sf_dir):
    e, c = F.col("entailment"), F.col("contradiction")
    return S.events(spark, sf_dir).select("row_idx", labels.self_score(e, c).alias("score"), labels.self_label(e, c).alias("label"))


_DIRECTION = "CASE WHEN {0} IN ('SUPPORTED', 'ENTAILMENT', 'ANSWER') THEN 1 WHEN {0} IN ('UNSUPPORTED', 'CONTRADICTION', 'ABSTAIN') THEN -1 ELSE 0 END"


@query(f"""{WITH_D}, x AS (SELECT row_idx, [{_DIRECTION.format('evidence_support')}, {_DIRECTION.format(f"({_argmax('entailment neutral contradiction')})")}, {_DIRECTION.format('final_decision')}] AS v FROM d),
    y AS (SELECT row_idx, v, greatest(len(list_filter(v, lambda k: k = 1)), len(list_filter(v, lambda k: k = -1)), len(list_filter(v, lambda k: k = 0))) / 3 AS s FROM x)
    SELECT row_idx, round(s, 9) AS consistency_score, CASE WHEN list_contains(v, 1) AND list_contains(v, -1) THEN 'CONFLICTING' WHEN s >= 0.75 THEN 'CONSISTENT' ELSE 'MIXED' END AS consistency_label FROM y""")
def consistency(spark, sf_dir):
    df = decided(spark, sf_dir).withColumn("semantic_label", labels.nli_label_v2(*map(F.col, _THREE)))
    return labels.consistency(df).select("row_idx", "consistency_score", "consistency_label")


# --- calibration -----------------------------------------------------------------------------------------------------

_EDGES = calibration.edges(10)
_BIN = f"len(list_filter([{', '.join(f'{e!r}e0' for e in _EDGES[1:-1])}], lambda x: x <= confidence))"


@query(f"""WITH {S.WITH_E}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(confidence) AS mc, avg(cast(correct AS int)) AS acc FROM e GROUP BY 1), x AS (SELECT cast(unnest(range(10)) AS int) AS bin, unnest([{', '.join(f'{e!r}e0' for e in _EDGES[:-1])}]) AS lo, unnest([{', '.join(f'{e!r}e0' for e in _EDGES[1:])}]) AS hi)
    SELECT x.bin, round(lo, 9) AS bin_start, round(hi, 9) AS bin_end, coalesce(n, 0) AS count, round(mc, 9) AS mean_confidence, round(acc, 9) AS accuracy, round(abs(mc - acc), 9) AS gap FROM x LEFT JOIN b ON x.bin = b.bin""")
def calibration_bins(spark, sf_dir):
    return calibration.calibration_bins(S.events(spark, sf_dir))


@query(f"""WITH {S.WITH_P}, q AS (SELECT *, cast(correct AS int) AS y, least(greatest(confidence, 1e-12), 1 - 1e-12) AS z, {_BIN} AS bin FROM p), b AS (SELECT bin, count(*) AS k, abs(sum(confidence) - sum(y)) AS g FROM q GROUP BY bin),
    t AS (SELECT sum(g) / sum(k) AS ece, max(g / k) AS mce FROM b) SELECT count(*) AS n, round(avg(y), 9) AS accuracy, round(avg(confidence), 9) AS mean_confidence, round(abs(avg(confidence) - avg(y)), 9) AS confidence_gap, round(any_value(ece), 9) AS ece, round(any_value(mce), 9) AS mce,
    round(avg((confidence - y) * (confidence - y)), 9) AS brier, round(avg(-(y * ln(z) + (1 - y) * ln(1 - z))), 9) AS nll FROM q, t""")
def ece_mce_brier_nll(spark, sf_dir):
    return calibration.calibration_report(S.labels(spark, sf_dir))


_MARGIN = "((confidence - 0.5) * 8)"


@query(f"WITH {S.WITH_E} SELECT row_idx, round(1 / (1 + exp(-{_MARGIN} / 2.5)), 9) AS calibrated_confidence, round(1 / (1 + exp(-{_MARGIN})), 9) AS uncalibrated_confidence FROM e")
def apply_temperature(spark, sf_dir):
    df = S.events(spark, sf_dir).select("row_idx", F.expr(_MARGIN).alias("answer_null_margin"))
    return calibration.apply_temperature(df, 2.5).select("row_idx", "calibrated_confidence", "uncalibrated_confidence")


_FITTED = f"{_MARGIN} + CASE WHEN correct THEN 1.5 ELSE 0.0 END"


@query(f"""WITH RECURSIVE {S.WITH_E}, v AS MATERIALIZED (SELECT {_FITTED} AS x, cast(correct AS int) AS y FROM e),
    step(n, b) AS (SELECT 0, 0e0 UNION ALL SELECT n + 1, b + greatest(-1, least(1, CASE WHEN k > 1e-12 THEN -g / k ELSE -0.5 * sign(g) END)) FROM (
        SELECT n, b, avg((1 / (1 + exp(-exp(b) * x)) - y) * x) * exp(b) AS g, avg(x * x / (1 + exp(-exp(b) * x)) / (1 + exp(exp(b) * x))) * exp(2 * b) + avg((1 / (1 + exp(-exp(b) * x)) - y) * x) * exp(b) AS k FROM step, v WHERE n < 40 GROUP BY n, b)),
    t AS (SELECT exp(-b) AS t FROM step WHERE n = 40)
    SELECT round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 9) AS nll_before, round(avg(greatest(x / t, 0) - x / t * y + ln(1 + exp(-abs(x / t)))), 9) AS nll_after, round(any_value(t), 9) AS temperature FROM v, t""")
def fit_temperature(spark, sf_dir):
    df = S.events(spark, sf_dir).select("row_idx", "correct", (F.expr(_MARGIN) + F.when(F.col("correct"), 1.5).otherwise(0.0)).alias("answer_null_margin"))
    t = calibration.fit_temperature(df)
    before = calibration.temperature_nll(df).withColumnRenamed("nll", "nll_before")
    return before.join(calibration.temperature_nll(df, t).withColumnRenamed("nll", "nll_after")).withColumn("temperature", F.lit(t))


_QUANTILES = f"SELECT DISTINCT candidate FROM (SELECT unnest(quantile_cont(confidence, [{', '.join(f'{i / 100!r}' for i in range(101))}]) || [0.0, 1.0]) AS candidate FROM e)"


@query(f"WITH {S.WITH_E} SELECT DISTINCT round(candidate, 9) AS candidate FROM ({_QUANTILES})")
def quantile_candidates(spark, sf_dir):
    return calibration.quantile_candidates(S.events(spark, sf_dir)).select(F.round("candidate", 9).alias("candidate")).distinct()


@query(f"""WITH {S.WITH_E}, q AS ({_QUANTILES}), n AS (SELECT count(*) AS n FROM e), pr AS (SELECT a.candidate AS lo, b.candidate AS hi FROM q a, q b WHERE a.candidate < b.candidate),
    s AS (SELECT lo, hi, count(*) AS n, count(*) FILTER (confidence >= hi) AS an, count(*) FILTER (confidence >= hi AND correct) AS ac, count(*) FILTER (confidence <= lo) AS bn, count(*) FILTER (confidence <= lo AND correct) AS bc FROM pr, e GROUP BY lo, hi),
    r AS (SELECT *, (an - ac) / an AS risk, bc / bn AS bad FROM s WHERE an >= greatest(1, ceil(n * 0.05e0)) AND bn >= greatest(1, ceil(n * 0.05e0))),
    v AS (SELECT *, greatest(0, risk - 0.1) + greatest(0, bad - 0.25) AS broken, risk <= 0.1 AND bad <= 0.25 AS ok FROM r)
    SELECT round(lo, 9) AS abstain_threshold, round(hi, 9) AS answer_threshold, an AS answer_count, bn AS abstain_count, round(risk, 9) AS answer_risk, round(bad, 9) AS abstain_correct_rate, round(broken, 9) AS total_constraint_violation, ok AS constraints_satisfied FROM v
    ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE broken END, an DESC, an + bn DESC, CASE WHEN ok THEN risk ELSE 0 END, CASE WHEN ok THEN bad ELSE 0 END, lo, hi LIMIT 1""")
def threshold_search(spark, sf_dir):
    best = calibration.select_thresholds(S.events(spark, sf_dir))
    return best.select("abstain_threshold", "answer_threshold", "answer_count", "abstain_count", "answer_risk", "abstain_correct_rate", "total_constraint_violation", "constraints_satisfied")


_FUSED = "CASE WHEN alpha = 1 THEN confidence WHEN alpha = 0 THEN entailment WHEN confidence = 0 OR entailment = 0 THEN 0.0 ELSE exp(alpha * ln(confidence) + (1 - alpha) * ln(entailment)) END"


_GRID = f"""WITH {S.WITH_P}, g AS (SELECT cast(x AS double) / 100 AS alpha FROM range(101) r(x)), f AS (SELECT row_idx, correct, alpha, {_FUSED.replace('ln(confidence)', 'ln(nullif(confidence, 0))').replace('ln(entailment)', 'ln(nullif(entailment, 0))')} AS score FROM p, g),
    c AS (SELECT alpha, row_number() OVER w AS a, sum(cast(correct AS int)) OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM f WINDOW w AS (PARTITION BY alpha ORDER BY round(least(score, 1.0), 12) DESC, row_idx)), z AS (SELECT alpha, avg((a - k) / a) AS aurc FROM c GROUP BY alpha)"""


@query(f"{_GRID} SELECT round(alpha, 9) AS alpha, round(aurc, 9) AS aurc FROM z")
def alpha_grid(spark, sf_dir):
    return calibration.alpha_grid(S.labels(spark, sf_dir), digits=12)


@query(f"{_GRID} SELECT round(alpha, 9) AS alpha, round(aurc, 9) AS aurc FROM (SELECT alpha, round(aurc, 12) AS aurc FROM z) ORDER BY aurc, alpha DESC LIMIT 1")
def best_alpha(spark, sf_dir):
    return calibration.best_alpha(calibration.alpha_grid(S.labels(spark, sf_dir), digits=12).withColumn("aurc", F.round("aurc", 12)))


# --- diagnostics -----------------------------------------------------------------------------------------------------


@query(f"""WITH {S.WITH_P}, f AS (SELECT correct, confidence AS a, sqrt(confidence * {_UNIT}) AS b FROM p) SELECT cast(sign(r.a - w.a) AS int) AS baseline, cast(sign(r.b - w.b) AS int) AS alternative, count(*) AS pairs FROM f r JOIN f w ON r.correct AND NOT w.correct GROUP BY 1, 2""")
def rank_flips(spark, sf_dir):
    df = S.labels(spark, sf_dir).withColumn("fused", geometric_mean(F.col("confidence"), signed_to_unit(F.col("self_score"))))
    return diagnostics.rank_flips(df)


@query(f"""WITH {S.WITH_E}, f AS (SELECT correct, confidence AS a, sqrt(confidence * {_UNIT}) AS b FROM e), d AS (SELECT correct, a, b, count(*) AS n FROM f GROUP BY ALL),
    k AS (SELECT sign(r.a - w.a) AS x, sign(r.b - w.b) AS y, cast(sum(r.n * w.n) AS bigint) AS n FROM d r JOIN d w ON r.correct AND NOT w.correct GROUP BY 1, 2),
    t AS (SELECT coalesce(sum(n), 0) AS pairs, coalesce(sum(n) FILTER (x = -1 AND y = 1), 0) AS fixes, coalesce(sum(n) FILTER (x = 1 AND y = -1), 0) AS harms, sum(n) FILTER (x = -1) AS bad, sum(n) FILTER (x = 1) AS good FROM k)
    SELECT cast(pairs AS bigint) AS pairs, cast(fixes AS bigint) AS fixes, cast(harms AS bigint) AS harms, round(fixes / bad, 9) AS fix_rate, round(harms / good, 9) AS harm_rate FROM t""")
def rank_flip_summary(spark, sf_dir):
    df = S.events(spark, sf_dir).withColumn("fused", geometric_mean(F.col("confidence"), signed_to_unit(F.col("self_score"))))
    return diagnostics.flip_summary(diagnostics.rank_flips(df))


@query(f"WITH {S.WITH_P} SELECT cast(least(floor(entailment * 10), 9) AS int) AS bin, count(*) AS count, count(*) FILTER (correct) AS correct_count, round(avg(entailment), 9) AS mean_entailment FROM p GROUP BY 1")
def entailment_bins(spark, sf_dir):
    df = S.labels(spark, sf_dir).withColumn("bin", calibration.scaled_bin(F.col("entailment")))
    return df.groupBy("bin").agg(F.count("*").alias("count"), F.count_if("correct").alias("correct_count"), F.avg("entailment").alias("mean_entailment"))


@query(f"WITH {S.WITH_P} SELECT lang AS label, count(*) AS count, count(*) FILTER (correct) AS correct_count, round(avg(entailment), 9) AS mean_entailment, round(count(*) FILTER (correct) / count(*), 9) AS accuracy FROM p GROUP BY lang")
def label_tables(spark, sf_dir):
    return diagnostics.label_table(S.labels(spark, sf_dir), "lang", value="entailment")


def _ranks(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query(f"""WITH {S.WITH_P}, v AS (SELECT cast(correct AS int) AS correct, confidence, entailment FROM p), k AS (SELECT *, {_ranks('confidence')} AS rc, {_ranks('entailment')} AS re, {_ranks('correct')} AS ry FROM v)
    SELECT 'entailment' AS x, 'y' AS y, count(*) AS n, round(corr(entailment, correct), 9) AS pearson, round(corr(re, ry), 9) AS spearman FROM k UNION ALL SELECT 'confidence', 'entailment', count(*), round(corr(confidence, entailment), 9), round(corr(rc, re), 9) FROM k""")
def pearson_spearman(spark, sf_dir):
    df = S.labels(spark, sf_dir).withColumn("y", F.col("correct").cast("double"))
    return diagnostics.correlations(df, [("entailment", "y"), ("confidence", "entailment")])


_NEAR = "confidence * (1 + cast(row_idx % 6 AS double) * 3e-10)"


@query(f"""WITH RECURSIVE {S.WITH_P}, v AS (SELECT row_idx, {_NEAR} AS v FROM p), d AS MATERIALIZED (SELECT v, count(*) AS n, row_number() OVER (ORDER BY v) AS i FROM v GROUP BY v),
    g(i, v, anchor) AS (SELECT i, v, v FROM d WHERE i = 1
        UNION ALL SELECT d.i, d.v, CASE WHEN abs(d.v - anchor) <= greatest(1e-9 * greatest(abs(d.v), abs(anchor)), 1e-15) THEN anchor ELSE d.v END FROM g JOIN d ON d.i = g.i + 1),
    s AS (SELECT anchor, sum(n) AS n FROM g JOIN d USING (i) GROUP BY anchor), r AS (SELECT anchor, coalesce(sum(n) OVER (ORDER BY anchor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS place FROM s)
    SELECT row_idx, cast(place AS double) AS place FROM v JOIN g USING (v) JOIN r USING (anchor)""")
def near_tie_ranks(spark, sf_dir):
    df = S.labels(spark, sf_dir).select("row_idx", F.expr(_NEAR).alias("v"))
    return diagnostics.average_rank(df, "v", "place").drop("v")


_GROUPS = {"incorrect_high_entailment": ("NOT correct AND entailment >= 0.8", "entailment DESC"), "correct_low_entailment": ("correct AND entailment <= 0.2", "entailment"), "high_confidence_low_entailment": ("confidence >= 0.8 AND entailment <= 0.2", "confidence - entailment DESC"), "low_confidence_high_entailment": ("confidence <= 0.2 AND entailment >= 0.8", "entailment - confidence DESC")}


@query(f"WITH {S.WITH_P} " + " UNION ALL ".join(f"(SELECT '{n}' AS \"group\", cast(row_number() OVER (ORDER BY {o}, row_idx) AS int) AS rank, row_idx FROM p WHERE {c} ORDER BY rank LIMIT 20)" for n, (c, o) in _GROUPS.items()))
def topk_examples(spark, sf_dir):
    return diagnostics.top_examples(S.labels(spark, sf_dir), diagnostics.disagreements(), 20).select("group", "rank", "row_idx")


@query(f"WITH {S.WITH_E} SELECT count(*) FILTER (claim_valid) AS valid_claims, count(*) FILTER (NOT claim_valid) AS invalid_claims, count(*) FILTER (entailment >= 0.8) AS high_rows, count(*) FILTER (entailment >= 0.8 AND NOT correct) AS high_wrong, round(count(*) FILTER (entailment >= 0.8 AND NOT correct) / count(*) FILTER (entailment >= 0.8), 9) AS high_wrong_share FROM e")
def high_entailment(spark, sf_dir):
    return metrics.high_entailment(S.events(spark, sf_dir))


@query(f"WITH {S.WITH_E}, x AS (SELECT CASE WHEN lexical >= 0.7 THEN 'SUPPORTED' WHEN lexical < 0.4 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS l FROM e), o AS (SELECT count(*) AS total, count(*) FILTER (l = 'SUPPORTED') AS supported, count(*) FILTER (l = 'UNSUPPORTED') AS unsupported, count(*) FILTER (l = 'UNCERTAIN') AS uncertain FROM x) SELECT *, round(supported / total, 9) AS supported_rate, round(unsupported / total, 9) AS unsupported_rate, round(uncertain / total, 9) AS uncertain_rate FROM o")
def evidence_summary(spark, sf_dir):
    df = S.events(spark, sf_dir).select(F.expr("CASE WHEN lexical >= 0.7 THEN 'SUPPORTED' WHEN lexical < 0.4 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END").alias("evidence_label"))
    return metrics.evidence_summary(df)


# --- sampling --------------------------------------------------------------------------------------------------------

_SPLIT = f"WITH {S.WITH_P}, h AS (SELECT row_idx, correct, is_answerable, row_number() OVER (PARTITION BY correct ORDER BY md5('17:' || row_idx)) AS place, count(*) OVER (PARTITION BY correct) AS n FROM p), s AS (SELECT *, CASE WHEN place <= floor(n * 0.6e0) THEN 'calibration' ELSE 'test' END AS split FROM h)"


def split_rows(spark, sf_dir) -> DataFrame:
    return resample.stratified_split(S.labels(spark, sf_dir), 0.6, label="correct")


@query(f"{_SPLIT} SELECT row_idx, split FROM s")
def stratified_split(spark, sf_dir):
    return split_rows(spark, sf_dir).select("row_idx", "split")


@query(f"{_SPLIT} SELECT split, count(*) AS total, count(*) FILTER (is_answerable) AS answerable, count(*) FILTER (NOT is_answerable) AS unanswerable, round(count(*) FILTER (is_answerable) / count(*), 9) AS answerable_fraction FROM s GROUP BY split")
def split_statistics(spark, sf_dir):
    return metrics.split_statistics(split_rows(spark, sf_dir))


_RANDOM = f"""WITH {S.WITH_P}, z AS (SELECT x AS seed, row_idx, correct, row_number() OVER (PARTITION BY x ORDER BY md5(x || ':' || row_idx)) AS place FROM p, range({len(SEEDS)}) r(x)), n AS (SELECT count(*) AS n FROM p),
    t AS (SELECT target_coverage, cast(round_even(n * target_coverage, 0) AS bigint) AS answered, n FROM n, {_values(COVERAGES, 'target_coverage')}),
    o AS (SELECT seed, target_coverage, answered, n, count(*) FILTER (correct) AS k FROM z JOIN t ON place <= answered GROUP BY seed, target_coverage, answered, n)"""


def random_runs(spark, sf_dir) -> DataFrame:
    return resample.random_abstention(S.labels(spark, sf_dir), COVERAGES, SEEDS)


@query(f"{_RANDOM} SELECT cast(seed AS int) AS seed, target_coverage, answered, k AS answered_correct, round(answered / n, 9) AS actual_coverage, round(k / answered, 9) AS answer_accuracy, round(1 - k / answered, 9) AS selective_risk, round(1 - answered / n, 9) AS abstain_rate FROM o")
def random_abstention(spark, sf_dir):
    return random_runs(spark, sf_dir)


@query(f"{_RANDOM} SELECT target_coverage, count(*) AS runs, " + ", ".join(f"round({f}({x}), 9) AS {n}_{v}" for v, x in (("answer_accuracy", "k / answered"), ("selective_risk", "1 - k / answered")) for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM o GROUP BY target_coverage")
def multi_seed_summary(spark, sf_dir):
    return metrics.run_summary(random_runs(spark, sf_dir))


def _drawn(replicates: int, seed: int = 17) -> str:
    """CTEs over ranked prefixes c: the area of every method in every replicate, by the same draws."""
    p = resample.PRIME
    fifth = lambda x: f"{x} * {x} % {p} * ({x} * {x} % {p}) % {p} * {x} % {p}"
    times = " + ".join(f"CASE WHEN x >= {t} THEN 1 ELSE 0 END" for t in resample.DRAWN)
    return f"""b AS (SELECT row_idx, correct, r AS replicate, (row_idx % {p} * {resample.ROW} + r * {resample.REPLICATE} + {seed * resample.SEED + 1}) % {p} AS x FROM (SELECT row_idx, any_value(correct) AS correct FROM m GROUP BY row_idx), range({replicates}) g(r)),
        b2 AS (SELECT row_idx, correct, replicate, {fifth('x')} AS x FROM b),
        d AS MATERIALIZED (SELECT row_idx, correct, replicate, {times} AS t FROM b2 WHERE x >= {resample.DRAWN[0]}),
        o AS (SELECT method, replicate, t, CASE WHEN d.correct THEN 0 ELSE 1 END AS w, sum(t) OVER k AS n1, sum(CASE WHEN d.correct THEN 0 ELSE t END) OVER k AS w1 FROM d JOIN c USING (row_idx) WINDOW k AS (PARTITION BY method, replicate ORDER BY answered ROWS UNBOUNDED PRECEDING)),
        areas AS MATERIALIZED (SELECT method, replicate, sum(list_sum(list_transform(range(t::BIGINT), lambda k: (w1 - k * w) / (n1 - k)))) / sum(t) AS aurc FROM o GROUP BY method, replicate)"""


@query(f"""{WITH_PM}, {_drawn(5000)}, j AS (SELECT a.*, a.aurc - s.aurc AS diff FROM areas a JOIN areas s ON a.replicate = s.replicate AND s.method = 'confidence')
    SELECT method, count(*) AS replicates, round(avg(aurc), 9) AS mean_aurc, round(quantile_cont(aurc, 0.025), 9) AS low, round(quantile_cont(aurc, 0.975), 9) AS high, round(avg(diff), 9) AS mean_difference,
        round(quantile_cont(diff, 0.025), 9) AS difference_low, round(quantile_cont(diff, 0.975), 9) AS difference_high, round(count(*) FILTER (diff < 0) / count(*), 9) AS share_better FROM j GROUP BY method""")
def paired_bootstrap(spark, sf_dir):
    draws = resample.paired_bootstrap(S.labels(spark, sf_dir), scores())
    return resample.bootstrap_summary(draws, "confidence")


# --- model stages and streams ----------------------------------------------------------------------------------------


@query(f"""WITH {S.WITH_E}, x AS (SELECT date_trunc('hour', v.ts) AS window_start, confidence >= 0.5 AS a, correct FROM e JOIN events v ON e.row_idx = v.event_id) SELECT window_start, count(*) AS total, count(*) FILTER (a) AS answered, count(*) FILTER (a AND correct) AS answered_correct, round(count(*) FILTER (a) / count(*), 9) AS coverage,
    CASE WHEN count(*) FILTER (a) > 0 THEN round(1 - count(*) FILTER (a AND correct) / count(*) FILTER (a), 9) ELSE 0.0 END AS selective_risk FROM x GROUP BY 1""")
def windowed_counts(spark, sf_dir):
    df = S.table(spark, sf_dir, "SELECT ts, CASE WHEN " + S.EVENTS["confidence"] + " >= 0.5 THEN 'ANSWER' ELSE 'ABSTAIN' END AS decision, " + S.EVENTS["correct"] + " AS correct FROM {events}", ("events",))
    return windowed_metrics(df)


@query(f"WITH {S.WITH_E} SELECT row_idx, round(1 / (1 + exp(-{_MARGIN})), 9) AS p, round(ln(1 + exp(-abs({_MARGIN}))) + greatest({_MARGIN}, 0) - CASE WHEN correct THEN {_MARGIN} ELSE 0 END, 9) AS loss FROM e")
def logistic_loss(spark, sf_dir):
    from prudence.functions.values import logit_loss

    df = validate.require(S.events(spark, sf_dir), validate.probability("confidence"))
    x = F.expr(_MARGIN)
    return df.select("row_idx", sigmoid(x).alias("p"), logit_loss(x, F.col("correct").cast("double")).alias("loss"))


# --- reports ---------------------------------------------------------------------------------------------------------

_FINAL = "CASE row_idx % 3 WHEN 0 THEN 'ANSWER' WHEN 1 THEN 'ABSTAIN' ELSE 'VERIFY' END"


@query(f"""{WITH_R}, f AS (SELECT row_idx, is_answerable, {_FINAL} AS d, CASE WHEN is_answerable THEN {X.exact_match('answer', 'refs')} ELSE 0e0 END AS em, CASE WHEN is_answerable THEN {X.best_f1('answer', 'refs', 1)} ELSE 0e0 END AS f1 FROM r), g AS (SELECT *, is_answerable AND (em = 1 OR f1 >= 0.8) AS correct, d AS final_decision FROM f)
    SELECT row_idx, {X.error_type('is_answerable', 'em', 'f1')} AS answer_error_type, correct AS prediction_correct, {_CATEGORY} AS category FROM g""")
def error_cases(spark, sf_dir):
    df = answered_pairs(spark, sf_dir).withColumn("final_decision", F.expr(_FINAL))
    return reports.error_cases(df).select("row_idx", "answer_error_type", "prediction_correct", "category")


@query(f"{_TASK}, b AS ({_selective('')}) SELECT 'pairs' AS system, 'unknown' AS model, 's' || (SELECT min(row_idx) FROM k) AS split, * FROM b")
def baseline_summary(spark, sf_dir):
    df = correctness.task_correctness(answered_pairs(spark, sf_dir)).withColumn("system", F.lit("pairs")).withColumn("split", F.concat(F.lit("s"), F.col("row_idx").cast("string")))
    return reports.baseline_summary(df)


def _lookup(score: str, name: str) -> str:
    return f"""{name} AS (SELECT target_coverage, coverage, risk FROM (SELECT answered / total AS coverage, CASE WHEN answered > 0 THEN (answered - k) / answered ELSE 0.0 END AS risk FROM ({_SWEEP.replace('confidence', score)})), {_values(TARGETS, 'target_coverage')} WHERE coverage > 0
        QUALIFY row_number() OVER (PARTITION BY target_coverage ORDER BY abs(coverage - target_coverage), coverage DESC, risk) = 1)"""


@query(f"""WITH {S.WITH_E}, {_lookup('confidence', 'a')}, {_lookup('lexical', 'b')} SELECT a.target_coverage, round(a.coverage, 9) AS confidence_coverage, round(a.risk, 9) AS confidence_risk, round(b.coverage, 9) AS lexical_coverage, round(b.risk, 9) AS lexical_risk, round(b.coverage - a.coverage, 9) AS coverage_difference, round(b.risk - a.risk, 9) AS risk_difference
    FROM a JOIN b ON a.target_coverage = b.target_coverage""")
def curves_side_by_side(spark, sf_dir):
    df = S.events(spark, sf_dir)
    a, b = (ranking.threshold_sweep(df, THRESHOLDS, c).select("coverage", F.col("selective_risk").alias("risk")) for c in ("confidence", "lexical"))
    return reports.side_by_side(a, b, TARGETS, ("confidence", "lexical"))


@query(f"WITH {S.WITH_P} SELECT 'case_' || row_idx AS case_id, row_idx, CASE WHEN is_answerable THEN '' ELSE '[UNANSWERABLE]' END AS \"references\", cast(is_answerable AS varchar) AS is_answerable, cast(claim_valid AS varchar) AS claim_valid, format('{{:.6f}}', entailment) AS entailment_probability, '' AS error_type FROM p WHERE NOT correct AND entailment >= 0.8")
def investigation_rows(spark, sf_dir):
    rows = reports.annotation_template(reports.investigation_rows(S.labels(spark, sf_dir)))
    return rows.select("case_id", "row_idx", "references", "is_answerable", "claim_valid", "entailment_probability", "error_type")
