"""Queries of the model stages: reading, entailment, agreement. Their default models are lexical, so SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudence.operators import inference, reading
from prudence.plans import surrogate as S
from prudence.plans import text_sql as X
from prudence.plans.catalog import query

_SPACE = "e' \\t\\n\\x0b\\x0c\\r'"
_WORD, _GAP = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]*"


def read(with_null: bool, spec: reading.Spec = reading.Spec()) -> str:
    """CTEs over q(row_idx, question, context): win (windows), x (their tokens with logits s and e), z (their totals), best (spans by place in their context)."""
    none = "none" if with_null else "-1e300"
    asked = f"regexp_extract_all(question, '{_WORD}')[:{spec.max_question}]"
    return f"""
    asked AS MATERIALIZED (SELECT row_idx, context, {spec.max_length - spec.marks} - len({asked}) AS room, len({asked}) AS n_asked, list_transform({asked}, lambda w: lower(w)) AS words, regexp_extract_all(context, '{_GAP}{_WORD}') AS pieces FROM q),
    piece AS (SELECT row_idx, generate_subscripts(pieces, 1) - 1 AS i, unnest(pieces) AS piece FROM asked),
    tok AS MATERIALIZED (SELECT row_idx, i, ltrim(piece, {_SPACE}) AS t, sum(length(piece)) OVER (PARTITION BY row_idx ORDER BY i) AS b FROM piece),
    win AS MATERIALIZED (SELECT row_idx, room, n_asked, words, unnest(range(CASE WHEN len(pieces) > room THEN 1 + (len(pieces) - room + room - {spec.stride} - 1) // (room - {spec.stride}) ELSE 1 END)) AS w FROM asked),
    hits AS MATERIALIZED (SELECT row_idx, w, n_asked, i, i - w * (room - {spec.stride}) AS k, t, b - length(t) AS a, b, CASE WHEN list_contains(words, lower(t)) THEN 1e0 ELSE 0e0 END AS hit
        FROM win JOIN tok USING (row_idx) WHERE i >= w * (room - {spec.stride}) AND i < w * (room - {spec.stride}) + room),
    near AS (SELECT *, coalesce(sum(hit) OVER (o ROWS BETWEEN {reading.NEAR} PRECEDING AND 1 PRECEDING), 0) AS bef, coalesce(sum(hit) OVER (o ROWS BETWEEN 1 FOLLOWING AND {reading.NEAR} FOLLOWING), 0) AS aft,
        2 + sum(hit) OVER (PARTITION BY row_idx, w) / 32 AS none FROM hits WINDOW o AS (PARTITION BY row_idx, w ORDER BY i)),
    x AS MATERIALIZED (SELECT row_idx, w, n_asked, k, a, b, none, bef + aft / 2 - 2 * hit + (length(t) % 7) / 7 AS s, aft + bef / 2 - 2 * hit + (length(t) % 5) / 5 AS e FROM near),
    z AS MATERIALIZED (SELECT row_idx, w, coalesce(any_value(none), 2.0) AS none, coalesce(ln(sum(exp(s)) + exp(any_value({none}))), any_value(2.0)) AS zs, coalesce(ln(sum(exp(e)) + exp(any_value({none}))), any_value(2.0)) AS ze FROM win LEFT JOIN x USING (row_idx, w) GROUP BY row_idx, w),
    spans AS (SELECT l.row_idx, l.w, l.k AS i, r.k AS j, l.a, r.b, round((l.s - zs) + (r.e - ze), {reading.DIGITS}) + 0e0 AS p FROM x l JOIN x r ON l.row_idx = r.row_idx AND l.w = r.w AND r.k BETWEEN l.k AND l.k + {spec.max_answer - 1} JOIN z ON z.row_idx = l.row_idx AND z.w = l.w),
    best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY p DESC, w, i, j) AS place FROM spans QUALIFY place <= {spec.top_k})"""


@query(f"WITH {S.WITH_Q}, {read(False)} SELECT row_idx, place::INTEGER AS place, w::INTEGER AS \"window\", i::INTEGER AS first, j::INTEGER AS last, a::INTEGER AS start, b::INTEGER AS \"end\", p AS log_score FROM best")
def qa_n_best(spark, sf_dir):
    return reading.best_spans(S.questions(spark, sf_dir), reading.lexical_reader)


@query(f"""WITH {S.WITH_Q}, {read(False)} SELECT q.row_idx, substring(context, a::INTEGER + 1, (b - a)::INTEGER) AS prediction_text, round(exp(p), 9) AS pipeline_score, a::INTEGER AS start, b::INTEGER AS "end", 'ANSWER' AS decision FROM q LEFT JOIN best ON best.row_idx = q.row_idx AND place = 1""")
def qa_forced_answers(spark, sf_dir):
    """Texts without a word have no span to answer with; their answer is null."""
    return reading.forced_answers(S.questions(spark, sf_dir), reading.lexical_reader, strict=False).drop("question", "context")


_NATIVE = f"""{read(True)}, least_none AS (SELECT row_idx, min(round(CASE WHEN zs = 2.0 AND ze = 2.0 AND none = 2.0 THEN 0 ELSE (none - zs) + (none - ze) END, {reading.DIGITS})) AS n FROM z GROUP BY row_idx),
    native AS (SELECT q.row_idx, question, context, coalesce(p >= n, false) AS answers, a, b, p, n FROM q JOIN least_none USING (row_idx) LEFT JOIN best ON best.row_idx = q.row_idx AND place = 1),
    chosen AS (SELECT row_idx, question, context, CASE WHEN answers THEN trim(substring(context, a::INTEGER + 1, (b - a)::INTEGER)) ELSE '' END AS text, exp(CASE WHEN answers THEN p ELSE n END) AS score, (CASE WHEN answers THEN a ELSE 0 END)::INTEGER AS start, (CASE WHEN answers THEN b ELSE 0 END)::INTEGER AS stop FROM native)"""


@query(f"WITH {S.WITH_Q}, {_NATIVE} SELECT row_idx, text AS prediction_text, round(score, 9) AS pipeline_score, start, stop AS \"end\", CASE WHEN text <> '' THEN 'ANSWER' ELSE 'ABSTAIN' END AS decision FROM chosen")
def qa_native_answers(spark, sf_dir):
    return reading.native_answers(S.questions(spark, sf_dir), reading.lexical_reader).drop("question", "context")


@query(f"""WITH {S.WITH_Q}, {read(False)}, y AS (SELECT x.row_idx, x.w, x.k, x.n_asked, s, e, x.a <= f.a AND f.a < x.b AS begins, x.a < f.b AND f.b <= x.b AS ends FROM x JOIN best f ON f.row_idx = x.row_idx AND f.place = 1),
    held AS (SELECT row_idx, w, any_value(n_asked) AS n_asked, min(k) FILTER (begins) AS i, min(k) FILTER (ends) AS j, min(s) FILTER (begins) + min(e) FILTER (ends) AS logit FROM y GROUP BY row_idx, w HAVING i <= j),
    top AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY logit DESC, w) = 1), least_none AS (SELECT row_idx, min(2 * none) AS n FROM z GROUP BY row_idx)
    SELECT row_idx, round(logit, 9) AS answer_span_logit, round(n, 9) AS null_logit, round(logit - n, 9) AS answer_null_margin, round(1 / (1 + exp(n - logit)), 9) AS confidence, w::INTEGER AS confidence_chunk, (i + n_asked + 2)::INTEGER AS first_token, (j + n_asked + 2)::INTEGER AS last_token FROM top JOIN least_none USING (row_idx)""")
def qa_span_confidence(spark, sf_dir):
    """The confidence of every forced answer there is."""
    answered = reading.forced_answers(S.questions(spark, sf_dir), reading.lexical_reader, strict=False).where("start IS NOT NULL")
    out = reading.span_confidence(answered, reading.lexical_reader)
    return out.select("row_idx", "answer_span_logit", "null_logit", "answer_null_margin", "confidence", "confidence_chunk", F.col("confidence_token_span")[0].alias("first_token"), F.col("confidence_token_span")[1].alias("last_token"))


# --- entailment -------------------------------------------------------------------------------------------------------


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))"


def entailed(premise: str, claim: str, source: str) -> str:
    """CTEs over a table of premises and claims: nli adds ent, neu and con, the probabilities of the lexical model."""
    words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '{_WORD}'))"
    return f"""shares AS (SELECT *, CASE WHEN len({words(claim)}) > 0 THEN len(list_intersect({words(claim)}, {words(premise)})) / len({words(claim)}) ELSE 0e0 END AS share FROM {source}),
    raw AS (SELECT *, exp(8 * share - 4) AS l_e, exp(0.5) AS l_n, exp(2 - 4 * share) AS l_c FROM shares),
    nli AS MATERIALIZED (SELECT *, l_e / (l_e + l_n + l_c) AS ent, l_n / (l_e + l_n + l_c) AS neu, l_c / (l_e + l_n + l_c) AS con FROM raw)"""


_PREDICTED = "CASE WHEN row_idx % 5 = 0 THEN '' WHEN row_idx % 3 = 0 THEN substring(question, 1, 20) ELSE answer END"
_CLAIM = f"""'The answer to the question "' || {clean('question')} || '" is "' || {clean('predicted')} || '".'"""
_ROWS = f"WITH {S.WITH_T}, g AS MATERIALIZED (SELECT row_idx, question, {_PREDICTED} AS predicted FROM t), h AS (SELECT *, {clean('question')} AS premise, {_CLAIM} AS claim FROM g WHERE {clean('predicted')} <> '')"


def predicted(spark, sf_dir):
    """Every exchange of a conversation with its question as context; some answers are empty, some stand in the context."""
    return S.pairs(spark, sf_dir).select("row_idx", "question", F.col("question").alias("context"), F.expr(_PREDICTED).alias("prediction_text"))


def largest(names: str) -> str:
    columns = {"ENTAILMENT": "ent", "NEUTRAL": "neu", "CONTRADICTION": "con"}
    return "CASE " + " ".join(f"WHEN {columns[n]} = greatest(ent, neu, con) THEN '{n}'" for n in names.split()) + " END"


@query(f"""{_ROWS}, {entailed('premise', 'claim', 'h')} SELECT row_idx, CASE WHEN con >= 0.7 THEN 'REJECTED' WHEN ent >= 0.7 THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS self_verification_label, round(ent - con, 9) AS self_verification_score FROM nli
    UNION ALL SELECT row_idx, 'REJECTED', -1.0 FROM g WHERE {clean('predicted')} = ''""")
def stub_inference(spark, sf_dir):
    return inference.self_verified(predicted(spark, sf_dir)).select("row_idx", "self_verification_label", "self_verification_score")


@query(f"""{_ROWS}, v AS (SELECT *, {X.claim_fields('question', 'predicted', 'claim')} FROM h), {entailed('premise', 'claim', 'v')}
    SELECT row_idx, len(reasons) = 0 AS qa_claim_valid, CASE WHEN len(reasons) > 0 THEN 'INVALID_CLAIM' WHEN con >= 0.5 THEN 'CONTRADICTION' WHEN ent >= 0.5 THEN 'ENTAILMENT' ELSE {largest('ENTAILMENT NEUTRAL CONTRADICTION')} END AS qa_nli_label,
        CASE WHEN len(reasons) > 0 THEN 0.0 ELSE round(ent, 9) END AS qa_entailment_probability FROM nli
    UNION ALL SELECT row_idx, false, 'EMPTY_ANSWER', 0.0 FROM g WHERE {clean('predicted')} = ''""")
def question_verification(spark, sf_dir):
    return inference.question_verified(predicted(spark, sf_dir)).select("row_idx", "qa_claim_valid", "qa_nli_label", "qa_entailment_probability")


@query(f"""{_ROWS}, {entailed('premise', 'claim', 'h')} SELECT row_idx, claim AS qa_claim, CASE WHEN con >= 0.5 THEN 'CONTRADICTION' WHEN ent >= 0.5 THEN 'ENTAILMENT' ELSE {largest('CONTRADICTION ENTAILMENT NEUTRAL')} END AS qa_nli_label, round(greatest(ent, neu, con), 9) AS qa_nli_confidence, round(ent, 9) AS qa_entailment_probability FROM nli
    UNION ALL SELECT row_idx, NULL, 'EMPTY_ANSWER', 1.0, 0.0 FROM g WHERE {clean('predicted')} = ''""")
def question_verification_v1(spark, sf_dir):
    out = inference.question_verified_v1(predicted(spark, sf_dir))
    return out.select("row_idx", "qa_claim", "qa_nli_label", "qa_nli_confidence", "qa_entailment_probability")


@query(f"""{_ROWS}, k AS (SELECT *, CASE WHEN row_idx % 2 = 0 THEN {clean('substring(question, 1, 240)')} ELSE premise END AS evidence FROM h), {entailed('evidence', 'claim', 'k')}
    SELECT row_idx, {largest('ENTAILMENT NEUTRAL CONTRADICTION')} AS semantic_label, round(greatest(ent, neu, con), 9) AS semantic_confidence, round(ent, 9) AS entailment_probability, round(neu, 9) AS neutral_probability, round(con, 9) AS contradiction_probability FROM nli""")
def semantic_verification(spark, sf_dir):
    df = predicted(spark, sf_dir).where("trim(prediction_text) <> ''").withColumn("evidence_text", F.expr("CASE WHEN row_idx % 2 = 0 THEN substring(question, 1, 240) ELSE ' ' END"))
    return inference.semantically_verified(df).select("row_idx", "semantic_label", "semantic_confidence", "entailment_probability", "neutral_probability", "contradiction_probability")


@query(f"""WITH {S.WITH_Q}, {_NATIVE}, a AS (SELECT row_idx, text, score, CASE WHEN row_idx % 3 = 0 THEN text WHEN row_idx % 3 = 1 THEN substring(context, 1, 30) ELSE text || ' ' || substring(context, 1, 10) END AS given FROM chosen),
    f AS (SELECT *, trim(text) = '' AS none, CASE WHEN trim(text) = '' THEN 0.0 ELSE {X.f1('given', 'text', 0)} END AS f1 FROM a)
    SELECT row_idx, text AS verifier_answer, round(score, 9) AS verifier_score, round(f1, 9) AS answer_match_f1, CASE WHEN none AND score >= 0.5 THEN 'UNSUPPORTED' WHEN none THEN 'UNCERTAIN' WHEN f1 >= 0.8 AND score >= 0.3 THEN 'SUPPORTED' WHEN f1 < 0.2 AND score >= 0.5 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS evidence_label FROM f""")
def agreement_verification(spark, sf_dir):
    """A second reader against answers that repeat its own, open the context, or do both."""
    df = S.questions(spark, sf_dir)
    own = reading.native_answers(df, reading.lexical_reader).select("row_idx", "question", "context", "prediction_text")
    given = F.expr("CASE WHEN row_idx % 3 = 0 THEN prediction_text WHEN row_idx % 3 = 1 THEN substring(context, 1, 30) ELSE prediction_text || ' ' || substring(context, 1, 10) END")
    return inference.agreement_verified(own.withColumn("prediction_text", given)).select("row_idx", "verifier_answer", "verifier_score", "answer_match_f1", "evidence_label")
