"""Row labels: evidence, entailment, consistency, decisions, error categories. Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions.values import clamp

#: Directions of labels and aliases of signals, in order of preference.
POSITIVE, NEGATIVE = ("SUPPORTED", "ENTAILMENT", "ANSWER"), ("UNSUPPORTED", "CONTRADICTION", "ABSTAIN")
SIGNALS = {"lexical": ("evidence_support", "evidence_label"), "semantic": ("semantic_label",), "hybrid": ("hybrid_evidence_support",), "decision": ("final_decision", "threshold_decision", "decision")}
DECISIONS, SUPPORT = ("ANSWER", "VERIFY", "ABSTAIN"), ("SUPPORTED", "WEAK", "UNSUPPORTED")


def answer_context_score(answer: Column, context: Column) -> Column:
    """1 if the answer stands in the context, else the share of its content words that do."""
    a, c = T.normalize_plain(answer), T.normalize_plain(context)
    return F.when(a == "", 0.0).when(F.contains(c, a), 1.0).otherwise(_found(answer, context))


def _found(text: Column, where: Column) -> Column:
    """Share of a text's content words that stand in another; 0 without content words."""
    return T.let(T.content_words(text), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(w, T.content_words(where))) / F.size(w)))


def question_overlap(question: Column, evidence: Column) -> Column:
    """Share of the question's content words that stand in the evidence; 0 without content words."""
    return _found(question, evidence)


def combined_evidence(context_score: Column, overlap: Column) -> Column:
    return F.lit(0.65) * context_score + F.lit(0.35) * overlap


def lexical_support(context_score: Column, overlap: Column, supported: float = 0.75, weak: float = 0.40, least_overlap: float = 0.45) -> Column:
    combined = combined_evidence(context_score, overlap)
    return F.when((context_score >= 1.0) & (overlap >= least_overlap) & (combined >= supported), "SUPPORTED").when((context_score >= 0.5) & (combined >= weak), "WEAK").otherwise("UNSUPPORTED")


def lexical_evidence(df: DataFrame, question: str = "question", context: str = "context", answer: str = "prediction_text", window: int = 120, start: str | None = None, end: str | None = None) -> DataFrame:
    """Add evidence_text, answer_context_score, question_evidence_overlap, evidence_score and evidence_support.

    The span is start and end if given, which must lie in the context, else the answer's first place in it.
    """
    size = F.length(context)
    if start and end:
        ok = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= size)
        begin = F.when(ok, F.col(start)).otherwise(F.raise_error(F.lit("stored answer span lies outside the context")).cast("int"))
        finish = F.col(end)
    else:
        begin = T.answer_position(F.col(context), F.col(answer))
        finish = begin + F.length(F.trim(F.col(answer)))
    df = df.withColumn("_begin", begin).withColumn("_end", finish)
    found = F.col("_begin").isNotNull()
    df = df.withColumn("evidence_text", F.when(found, T.evidence_window(F.col(context), F.col("_begin"), F.col("_end"), window)).otherwise(""))
    df = df.withColumn("answer_context_score", answer_context_score(F.col(answer), F.col(context))).withColumn("question_evidence_overlap", F.when(found, question_overlap(F.col(question), F.col("evidence_text"))).otherwise(0.0))
    scores = F.col("answer_context_score"), F.col("question_evidence_overlap")
    return df.withColumn("evidence_score", combined_evidence(*scores)).withColumn("evidence_support", lexical_support(*scores)).drop("_begin", "_end")


def qa_agreement(answer: Column, verifier_answer: Column, verifier_score: Column, supported_score: float = 0.30, high_f1: float = 0.80, strong_score: float = 0.50, low_f1: float = 0.20) -> Column:
    """Struct of label, reason and f1 from a second model's answer."""
    f1 = T.overlap_f1(answer, verifier_answer)
    none = T.clean_text(verifier_answer) == ""

    def out(label: str, reason: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), F.when(none, 0.0).otherwise(f1).alias("f1"))

    return (
        F.when(none & (verifier_score >= strong_score), out("UNSUPPORTED", "verifier_no_answer"))
        .when(none, out("UNCERTAIN", "verifier_uncertain_no_answer"))
        .when((f1 >= high_f1) & (verifier_score >= supported_score), out("SUPPORTED", "answers_agree"))
        .when((f1 < low_f1) & (verifier_score >= strong_score), out("UNSUPPORTED", "answers_disagree"))
        .otherwise(out("UNCERTAIN", "insufficient_agreement"))
    )


def hybrid_score(confidence: Column, lexical: Column, entailment: Column, weights: tuple[float, float, float] = (0.25, 0.25, 0.50)) -> Column:
    """Weighted mean of three scores, weights scaled to a sum of 1."""
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, nor all 0")
    a, b, c = (w / sum(weights) for w in weights)
    return clamp(F.lit(a) * confidence + F.lit(b) * lexical + F.lit(c) * entailment)


def hybrid_support(score: Column, contradiction: Column, supported: float = 0.70, weak: float = 0.40, contradicted: float = 0.70) -> Column:
    if not 0 <= weak <= supported <= 1 or not 0 <= contradicted <= 1:
        raise ValueError("0 <= weak <= supported <= 1 and 0 <= contradicted <= 1 must hold")
    return F.when(contradiction >= contradicted, "UNSUPPORTED").when(score >= supported, "SUPPORTED").when(score >= weak, "WEAK").otherwise("UNSUPPORTED")


def largest(named: list[tuple[str, Column]]) -> Column:
    """Name of the largest value, the first among equals."""
    best = F.greatest(*(c for _, c in named))
    out = F.when(named[0][1] == best, named[0][0])
    for name, c in named[1:]:
        out = out.when(c == best, name)
    return out


def nli_label_v2(entailment: Column, neutral: Column, contradiction: Column, entailed: float = 0.5, contradicted: float = 0.5) -> Column:
    """Contradiction first, then entailment, else the largest in the order entailment, neutral, contradiction."""
    return F.when(contradiction >= contradicted, "CONTRADICTION").when(entailment >= entailed, "ENTAILMENT").otherwise(largest([("ENTAILMENT", entailment), ("NEUTRAL", neutral), ("CONTRADICTION", contradiction)]))


def nli_label_v1(entailment: Column, neutral: Column, contradiction: Column, entailed: float = 0.5, contradicted: float = 0.5) -> Column:
    """Like v2 with ties in the order contradiction, entailment, neutral."""
    return F.when(contradiction >= contradicted, "CONTRADICTION").when(entailment >= entailed, "ENTAILMENT").otherwise(largest([("CONTRADICTION", contradiction), ("ENTAILMENT", entailment), ("NEUTRAL", neutral)]))


def inferred_nli_label(valid: Column, stored: Column, entailment: Column, neutral: Column, contradiction: Column) -> Column:
    """INVALID_CLAIM, else what the stored label says, else the largest probability, else UNKNOWN."""
    label = T.upper_label(stored)
    named = [(n, F.coalesce(c, F.lit(-1.0))) for n, c in (("ENTAILMENT", entailment), ("NEUTRAL", neutral), ("CONTRADICTION", contradiction))]
    some = F.coalesce(entailment, neutral, contradiction).isNotNull()
    out = F.when(~F.coalesce(valid, F.lit(True)), "INVALID_CLAIM")
    for n in ("ENTAILMENT", "NEUTRAL", "CONTRADICTION"):
        out = out.when(F.contains(label, F.lit(n)), n)
    return out.when(some, largest(named)).otherwise("UNKNOWN")


def self_score(entailment: Column, contradiction: Column) -> Column:
    return clamp(entailment - contradiction, -1.0, 1.0)


def self_label(entailment: Column, contradiction: Column, supported: float = 0.70, rejected: float = 0.70) -> Column:
    return F.when(contradiction >= rejected, "REJECTED").when(entailment >= supported, "SUPPORTED").otherwise("UNCERTAIN")


def direction(label: Column) -> Column:
    """1 for labels in favour of answering, -1 for those against, 0 for all others."""
    return F.when(T.upper_label(label).isin(*POSITIVE), 1).when(T.upper_label(label).isin(*NEGATIVE), -1).otherwise(0)


def signals(columns: list[str]) -> Column:
    """Map of the signals that a row has: the first alias that isn't null, if it isn't blank then."""
    entries = []
    for name, aliases in SIGNALS.items():
        have = [F.when(T.upper_label(F.col(a)) != "", T.upper_label(F.col(a))) for a in aliases if a in columns]
        entries += [F.lit(name), F.coalesce(*have) if have else F.lit(None).cast("string")]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def consistency(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Add consistency_signals, consistency_score (share of the commonest direction) and consistency_label."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    df = df.withColumn("consistency_signals", signals(df.columns)).withColumn("_d", F.transform(F.map_values("consistency_signals"), direction))
    n = F.size("_d")

    def many(k: int) -> Column:
        return F.size(F.filter("_d", lambda x: x == k))

    most = F.greatest(many(1), many(-1), many(0))
    score = F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(most / n)
    df = df.withColumn("consistency_score", score)
    label = F.when(n == 0, "MIXED").when(F.array_contains("_d", 1) & F.array_contains("_d", -1), "CONFLICTING").when(F.col("consistency_score") >= threshold, "CONSISTENT").otherwise("MIXED")
    return df.withColumn("consistency_label", label).drop("_d")


def route(confidence: Column, abstain: float, answer: float) -> Column:
    """ANSWER at or over the upper threshold, ABSTAIN at or under the lower, else VERIFY."""
    if not abstain < answer:
        raise ValueError("the abstain threshold must be less than the answer threshold")
    return F.when(confidence >= answer, "ANSWER").when(confidence <= abstain, "ABSTAIN").otherwise("VERIFY")


def resolve(decision: Column, support: Column) -> Column:
    """Final decision: VERIFY follows the evidence, the others stay."""
    return F.when(decision != "VERIFY", decision).when(support == "SUPPORTED", "ANSWER").when(support == "WEAK", "VERIFY").when(support == "UNSUPPORTED", "ABSTAIN")


def error_category(decision: Column, answerable: Column, correct: Column) -> Column:
    return (
        F.when((decision == "ANSWER") & correct, "CORRECT_ANSWER")
        .when(decision == "ANSWER", "UNSAFE_WRONG_ANSWER")
        .when((decision == "ABSTAIN") & ~answerable, "CORRECT_UNANSWERABLE_ABSTENTION")
        .when((decision == "ABSTAIN") & correct, "UNNECESSARY_ABSTENTION")
        .when(decision == "ABSTAIN", "PROTECTIVE_ABSTENTION")
        .when((decision == "VERIFY") & correct, "VERIFY_CORRECT_PREDICTION")
        .when(decision == "VERIFY", "VERIFY_INCORRECT_PREDICTION")
        .otherwise(F.raise_error(F.lit("unsupported decision")).cast("string"))
    )


def evidence_category(correct: Column, support: Column) -> Column:
    return F.concat_ws("_", F.when(correct, "CORRECT").otherwise("WRONG"), support)


def answer_error_type(answerable: Column, exact: Column, f1: Column, relaxed: float = 0.80, partial: float = 0.50) -> Column:
    return F.when(~answerable, "UNANSWERABLE_FORCED_ANSWER_CANDIDATE").when(exact == 1, "CORRECT_EXACT").when(f1 >= relaxed, "MINOR_SPAN_MISMATCH").when(f1 >= partial, "PARTIAL_ANSWER").otherwise("WRONG_ANSWER")


def transition(before: Column, after: Column) -> Column:
    return F.concat_ws("_TO_", before, after)


def transition_case(before: Column, after: Column, correct: Column) -> Column:
    """What became of a VERIFY row, by correctness; other_transition for all others."""
    what = F.when(after == "ANSWER", "promoted_to_answer").when(after == "ABSTAIN", "blocked").otherwise("preserved")
    return F.when(before == "VERIFY", F.concat_ws("_", F.lit("verify"), F.when(correct, "correct").otherwise("incorrect"), what)).otherwise("other_transition")


def validated_claims(df: DataFrame, question: str = "question", answer: str = "prediction_text", claim: str = "qa_claim", least_coverage: float = 0.80, least_tokens: int = 4, most_copied: float = 0.98) -> DataFrame:
    """Add validity, reasons in their fixed order and the measures behind them for generated claims."""
    q, a, c = F.col(question), F.col(answer), T.clean_text(F.col(claim))
    count, coverage, copied = F.size(T.tokenize(c)), T.token_coverage(a, c), T.copy_ratio(q, c)
    asked, kept_numbers, kept_negation = T.looks_like_question(c), T.numbers_preserved(a, c), T.negation_preserved(q, a, c)
    df = df.withColumns(
        {
            "qa_claim_answer_token_coverage": coverage, "qa_claim_question_copy_ratio": copied, "qa_claim_token_count": count,
            "qa_claim_content_token_count": F.size(T.tokenize(c, True)), "qa_claim_number_preserved": kept_numbers, "qa_claim_negation_preserved": kept_negation,
        }
    )
    same_answer = (T.normalize_for_comparison(a) != "") & (T.normalize_for_comparison(c) == T.normalize_for_comparison(a))
    same_question = (T.normalize_for_comparison(q) != "") & (T.normalize_for_comparison(c) == T.normalize_for_comparison(q))
    tests = (
        (c == "", "EMPTY_CLAIM"), (asked, "QUESTION_FORM"), (same_answer, "ANSWER_ONLY_FRAGMENT"), (same_question, "QUESTION_REPEATED"),
        (F.col("qa_claim_token_count") < least_tokens, "TOO_SHORT"), (F.col("qa_claim_answer_token_coverage") < least_coverage, "ANSWER_NOT_PRESERVED"),
        (~F.col("qa_claim_number_preserved"), "NUMBER_NOT_PRESERVED"), (~F.col("qa_claim_negation_preserved"), "NEGATION_NOT_PRESERVED"),
        ((F.col("qa_claim_question_copy_ratio") >= most_copied) & asked, "EXCESSIVE_QUESTION_COPY"),
    )
    reasons = F.array_compact(F.array(*(F.when(t, name) for t, name in tests)))
    return df.withColumn("qa_claim_validation_reasons", reasons).withColumn("qa_claim_valid", F.size("qa_claim_validation_reasons") == 0)
