"""Queries of flags, reasons, correctness in all its forms, and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions.values import variant_flag
from prudence.operators import correctness, labels, metrics, ranking, reports
from prudence.plans import surrogate as S
from prudence.plans import text_sql as X
from prudence.plans.catalog import COVERAGES, ORACLES, WITH_R, answered_pairs, long, query, random_runs

#: JSON of a flag as rows of every event carry it.
_FLAGS = ("true", "false", "1", "0", "2", "1.0", "0.0", '" Yes "', '"no"', '"1.0"', '"correct"', '"incorrect"', '"valid"', '"invalid"', '"maybe"', "null")
_FLAG = "CASE row_idx % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FLAGS)) + " END"


def _flag_sql(words: str, negative: str, real: bool) -> str:
    """The flag of a JSON text f: booleans, whole numbers, fractions if `real`, and words."""
    w = "lower(trim(trim(f, '\"')))"
    return f"CASE WHEN f IN ('true', 'false') THEN f = 'true' WHEN f IN ('1', '0') THEN f = '1' WHEN f IN ('1.0', '0.0') THEN CASE WHEN {real} THEN f = '1.0' END WHEN f LIKE '\"%' THEN CASE WHEN {w} IN ({words}) THEN true WHEN {w} IN ({negative}) THEN false END END"


@query(f"""WITH {S.WITH_E}, v AS (SELECT row_idx, {_FLAG} AS f FROM e) SELECT row_idx, {_flag_sql("'true', '1', 'yes'", "'false', '0', 'no'", False)} AS answerability, {_flag_sql("'true', '1', 'yes', 'correct', '1.0'", "'false', '0', 'no', 'incorrect', '0.0'", True)} AS correctness,
    {_flag_sql("'true', '1', 'yes', 'correct'", "'false', '0', 'no', 'incorrect'", True)} AS decision, {_flag_sql("'true', '1', 'yes', 'correct', '1.0', 'valid'", "'false', '0', 'no', 'incorrect', '0.0', 'invalid'", True)} AS validity FROM v""")
def typed_flags(spark, sf_dir):
    """Four readings of flags that are booleans, numbers and words in one column."""
    df = S.events(spark, sf_dir).select("row_idx", F.parse_json(F.expr(_FLAG)).alias("v"))
    return df.select("row_idx", *(variant_flag(F.col("v"), k).alias(k) for k in ("answerability", "correctness", "decision", "validity")))


_A, _B = "'too short ' || row_idx % 7", "'Question  form'"
_REASONS = f"""CASE row_idx % 6 WHEN 0 THEN {_A} || '; ' || {_B} || ' |' WHEN 1 THEN '["' || {_A} || '", ["' || {_B} || '", null]]' WHEN 2 THEN '{{"' || {_A} || '": true, "off": "no"}}' WHEN 3 THEN '"' || {_A} || '"' WHEN 4 THEN '[{{"' || {_A} || '": 1}}, 5]' END"""


@query(f"WITH {S.WITH_E} SELECT row_idx, CASE row_idx % 6 WHEN 0 THEN 'TOO_SHORT_' || row_idx % 7 || ' QUESTION_FORM' WHEN 1 THEN 'TOO_SHORT_' || row_idx % 7 || ' QUESTION_FORM' WHEN 2 THEN 'TOO_SHORT_' || row_idx % 7 WHEN 3 THEN 'TOO_SHORT_' || row_idx % 7 WHEN 4 THEN 'TOO_SHORT_' || row_idx % 7 || ' 5' ELSE '' END AS reasons FROM e")
def claim_reasons(spark, sf_dir):
    """Reasons that are texts, JSON lists, dictionaries of flags and JSON texts in one column."""
    df = S.events(spark, sf_dir).select("row_idx", F.expr(_REASONS).alias("r"))
    return df.select("row_idx", F.concat_ws(" ", T.parse_reasons(F.col("r"))).alias("reasons"))


@query(f"""{WITH_R} SELECT row_idx, is_answerable AND len(list_filter(refs, lambda y: {X.answer_tokens('y')} <> [] AND {X.answer_tokens('y')} = {X.answer_tokens('answer')})) > 0 AS diagnostic,
    CASE WHEN is_answerable THEN {X.exact_match('answer', 'refs')} ELSE 0e0 END AS forced_em, CASE WHEN is_answerable THEN {X.exact_match('answer', 'refs')} = 1 ELSE false END AS forced_correct FROM r""")
def diagnostic_and_forced(spark, sf_dir):
    """Diagnostic correctness, and task correctness with every row answered."""
    df = answered_pairs(spark, sf_dir).withColumn("diagnostic", correctness.diagnostic_correctness(F.col("prediction_text"), F.col("reference_answers"), F.col("is_answerable")))
    return correctness.forced_answers(df).select("row_idx", "diagnostic", F.col("exact_match").alias("forced_em"), F.when(F.col("is_answerable"), F.col("is_correct")).otherwise(False).alias("forced_correct"))


@query(f"WITH {S.WITH_E} SELECT row_idx, CASE WHEN row_idx % 4 = 0 THEN NULL WHEN row_idx % 4 = 1 THEN correct WHEN row_idx % 4 = 2 THEN row_idx % 3 = 0 ELSE true END AS stored FROM e")
def stored_correctness(spark, sf_dir):
    """The first of several stored columns, of several types, that reads as a flag."""
    r = F.col("row_idx") % 4
    df = S.events(spark, sf_dir).select(
        "row_idx", F.when(r == 1, F.col("correct")).alias("is_correct"), F.when(r == 2, F.when(F.col("row_idx") % 3 == 0, " Yes").otherwise("incorrect")).when(r == 0, "?").alias("exact_match"), F.when(r == 3, 1.0).when(r == 0, 0.5).alias("em")
    )
    return df.select("row_idx", correctness.stored_correctness(df).alias("stored"))


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))"


def _plain(x: str) -> str:
    return f"array_to_string({X.plain_tokens(x)}, ' ')"


_SAID = "CASE row_idx % 4 WHEN 0 THEN 'Claim: \"' || answer || '\"' WHEN 1 THEN 'Final statement:  ' || substring(answer, 1, 30) WHEN 2 THEN ' ' ELSE substring(answer, 1, 25) || '?' END"
_BARE = f"""trim(trim(regexp_replace({_clean('said')}, '^({'|'.join(T.CLAIM_PREFIXES)})', '', 'i')), '"'' ')"""


@query(f"""WITH {S.WITH_T}, v AS (SELECT *, {_SAID} AS said FROM t), b AS (SELECT *, {_BARE} AS bare, replace({_clean("substring(answer, 1, 60) || ' | ' || row_idx")}, '|', '\\|') AS cell FROM v)
    SELECT row_idx, {_plain('question')} || '. ' || {_plain('answer')} AS prompt, CASE WHEN bare = '' OR right(bare, 1) IN ('.', '!', '?') THEN bare ELSE bare || '.' END AS claim, CASE WHEN length(cell) <= 40 THEN cell ELSE rtrim(substring(cell, 1, 39)) || '…' END AS cell FROM b""")
def claim_texts(spark, sf_dir):
    """Input of the claim generator, its output made a sentence, and a cell of a Markdown report."""
    df = S.pairs(spark, sf_dir).withColumn("said", F.expr(_SAID))
    cell = T.markdown_cell(F.concat(F.substring("answer", 1, 60), F.lit(" | "), F.col("row_idx").cast("string")), 40)
    return df.select("row_idx", T.qa2d_prompt(F.col("question"), F.col("answer")).alias("prompt"), T.normalise_claim(F.col("said")).alias("claim"), cell.alias("cell"))


_STORED = "CASE row_idx % 6 WHEN 0 THEN ' entailment ' WHEN 1 THEN 'Contradiction (strong)' WHEN 2 THEN 'is NEUTRAL' WHEN 3 THEN 'other' END"
_MOST = "CASE WHEN entailment = greatest(entailment, neutral, contradiction) THEN 'ENTAILMENT' WHEN neutral = greatest(entailment, neutral, contradiction) THEN 'NEUTRAL' ELSE 'CONTRADICTION' END"


@query(f"WITH {S.WITH_E} SELECT row_idx, upper(trim(coalesce({_STORED}, ''))) AS stored, CASE WHEN NOT claim_valid THEN 'INVALID_CLAIM' WHEN row_idx % 6 = 0 THEN 'ENTAILMENT' WHEN row_idx % 6 = 1 THEN 'CONTRADICTION' WHEN row_idx % 6 = 2 THEN 'NEUTRAL' WHEN row_idx % 6 = 5 THEN 'UNKNOWN' ELSE {_MOST} END AS label FROM e")
def inferred_labels(spark, sf_dir):
    """Labels from what is stored, else from the probabilities, where there are any."""
    df = S.events(spark, sf_dir).withColumn("s", F.expr(_STORED))
    known = lambda c: F.when(F.col("row_idx") % 6 != 5, F.col(c))
    label = labels.inferred_nli_label(F.col("claim_valid"), F.col("s"), known("entailment"), known("neutral"), known("contradiction"))
    return df.select("row_idx", T.upper_label(F.col("s")).alias("stored"), label.alias("label"))


@query(f"SELECT p.method, p.target_coverage, p.risk, r.mean_selective_risk AS random_risk FROM ({ORACLES['matched_coverage']}) p JOIN ({ORACLES['multi_seed_summary']}) r ON round(p.target_coverage, 10) = round(r.target_coverage, 10)")
def gain_over_random(spark, sf_dir):
    """Every method's risk beside the mean risk of random abstention at the same coverage."""
    points = ranking.matched_coverage(long(S.events(spark, sf_dir)), COVERAGES)
    return reports.against_random(points, metrics.run_summary(random_runs(spark, sf_dir))).select("method", "target_coverage", "risk", "random_risk")
