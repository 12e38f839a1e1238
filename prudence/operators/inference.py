"""Model stages: batched functions at a mapInPandas boundary, fed only with the rows that need them.

Every stage takes a loader of its model; the default ones are lexical and need no training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions.values import sigmoid
from prudence.operators import labels, reading
from prudence.operators.entailment import EntailmentModel, lexical_entailment, with_entailment

#: A loader makes a scorer once a worker; a scorer takes equally long lists and gives a list of tuples.
Scorer = Callable[..., list[tuple]]


def scored(df: DataFrame, load: Callable[[], Scorer], inputs: list[str], outputs: str) -> DataFrame:
    """Add the outputs (a DDL string) of a model to every row, batch by batch; columns of the same names are replaced."""
    names = [f.strip().split()[0] for f in outputs.split(",")]
    kept = df.drop(*names)
    columns = kept.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = model(*(batch[c].tolist() for c in inputs))
            yield pd.concat([batch[columns], pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    return kept.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), outputs]))


def chunk_confidence(chunks: DataFrame, key: str = "id", span: str = "answer_span_logit", null: str = "null_logit") -> DataFrame:
    """Confidence from the chunks of a context: the best span logit minus the least null logit, and its sigmoid."""
    out = chunks.groupBy(key).agg(F.max(span).alias(span), F.min(null).alias(null), F.max_by(F.struct(*[c for c in chunks.columns if c not in (key, span, null)]), span).alias("chunk")) if len(chunks.columns) > 3 else chunks.groupBy(key).agg(F.max(span).alias(span), F.min(null).alias(null))
    return out.withColumn("answer_null_margin", F.col(span) - F.col(null)).withColumn("confidence", sigmoid(F.col("answer_null_margin"))).withColumn("confidence_is_calibrated", F.lit(False))


def self_verified(df: DataFrame, load: Callable[[], EntailmentModel] = lexical_entailment, question: str = "question", context: str = "context", answer: str = "prediction_text") -> DataFrame:
    """Answer support by entailment of a template claim. Empty answers skip the model: REJECTED, -1, contradiction 1, no claim."""
    empty = T.clean_text(F.col(answer)) == ""
    ready = df.where(~empty).withColumn("self_verification_claim", T.claim_template(F.col(question), F.col(answer))).withColumn("_premise", T.clean_text(F.col(context)))
    out = with_entailment(ready, load, "_premise", "self_verification_claim", ("self_entailment_probability", "self_neutral_probability", "self_contradiction_probability")).drop("_premise")
    e, c = F.col("self_entailment_probability"), F.col("self_contradiction_probability")
    out = out.withColumn("self_verification_score", labels.self_score(e, c)).withColumn("self_verification_label", labels.self_label(e, c))
    rest = df.where(empty).withColumn("self_verification_claim", F.lit(None).cast("string")).withColumn("self_entailment_probability", F.lit(0.0)).withColumn("self_neutral_probability", F.lit(0.0)).withColumn("self_contradiction_probability", F.lit(1.0))
    return out.unionByName(rest.withColumn("self_verification_score", F.lit(-1.0)).withColumn("self_verification_label", F.lit("REJECTED")))


def question_verified(df: DataFrame, load: Callable[[], EntailmentModel] = lexical_entailment, generate: Callable[[], Scorer] | None = None, question: str = "question", context: str = "context", answer: str = "prediction_text") -> DataFrame:
    """Question-aware verification: claims are generated for answers that aren't empty and checked; only valid ones are scored."""
    empty = T.clean_text(F.col(answer)) == ""
    zero = {f"qa_{n}_probability": F.lit(0.0) for n in ("entailment", "neutral", "contradiction")}
    some = df.where(~empty)
    if generate:
        some = scored(some.withColumn("_prompt", T.qa2d_prompt(F.col(question), F.col(answer))), generate, ["_prompt"], "qa_claim string").drop("_prompt")
        some = some.withColumn("qa_claim", T.normalise_claim(F.col("qa_claim")))
    else:
        some = some.withColumn("qa_claim", T.claim_template(F.col(question), F.col(answer)))
    # a filter by validity would work the checks out once more on each side of it
    checked = labels.validated_claims(some, question, answer, "qa_claim").withColumn("_premise", T.clean_text(F.col(context)))
    told = with_entailment(checked, load, "_premise", "qa_claim", tuple(zero), where="qa_claim_valid").drop("_premise")
    told = told.withColumn("qa_nli_label", F.when(F.col("qa_claim_valid"), labels.nli_label_v2(*(F.col(n) for n in zero))).otherwise("INVALID_CLAIM"))
    none = df.where(empty).withColumns(zero).withColumn("qa_claim", F.lit(None).cast("string")).withColumn("qa_claim_valid", F.lit(False)).withColumn("qa_nli_label", F.lit("EMPTY_ANSWER"))
    return told.unionByName(none, allowMissingColumns=True)


def premise(evidence: str = "evidence_text", context: str = "context"):
    """The evidence if there is any, else the context."""
    return F.coalesce(F.nullif(T.clean_text(F.col(evidence)), F.lit("")), T.clean_text(F.col(context)))


def question_verified_v1(df: DataFrame, load: Callable[[], EntailmentModel] = lexical_entailment, generate: Callable[[], Scorer] | None = None, model: str = "", generator: str = "", question: str = "question", context: str = "context", answer: str = "prediction_text", entailed: float = 0.5, contradicted: float = 0.5) -> DataFrame:
    """The first form of question-aware verification: every claim of a non-empty answer is scored, valid or not.

    Adds qa_claim, qa_claim_question, qa_claim_answer, qa_nli_label, qa_nli_confidence (the largest probability), the
    three probabilities and the models' names. Empty answers skip both models: EMPTY_ANSWER, confidence and neutral 1,
    no claim.
    """
    if not 0 <= entailed <= 1 or not 0 <= contradicted <= 1:
        raise ValueError("thresholds must lie between 0 and 1")
    names = tuple(f"qa_{n}_probability" for n in ("entailment", "neutral", "contradiction"))
    df = df.withColumns({"qa_claim_question": T.clean_text(F.col(question)), "qa_claim_answer": T.clean_text(F.col(answer)), "qa_nli_model": F.lit(model), "qa_claim_generator_model": F.lit(generator)})
    some = df.where("qa_claim_answer <> ''")
    if generate:
        some = scored(some.withColumn("_prompt", T.qa2d_prompt(F.col(question), F.col(answer))), generate, ["_prompt"], "qa_claim string").drop("_prompt")
        some = some.withColumn("qa_claim", T.normalise_claim(F.col("qa_claim")))
    else:
        some = some.withColumn("qa_claim", T.claim_template(F.col(question), F.col(answer)))
    some = with_entailment(some.withColumn("_premise", T.clean_text(F.col(context))), load, "_premise", "qa_claim", names).drop("_premise")
    e, n, c = (F.col(x) for x in names)
    some = some.withColumns({"qa_nli_label": labels.nli_label_v1(e, n, c, entailed, contradicted), "qa_nli_confidence": F.greatest(e, n, c)})
    none = df.where("qa_claim_answer = ''").withColumns({"qa_claim": F.lit(None).cast("string"), **dict(zip(names, map(F.lit, (0.0, 1.0, 0.0)), strict=True)), "qa_nli_label": F.lit("EMPTY_ANSWER"), "qa_nli_confidence": F.lit(1.0)})
    return some.unionByName(none)


def semantically_verified(df: DataFrame, load: Callable[[], EntailmentModel] = lexical_entailment, model: str = "", question: str = "question", context: str = "context", answer: str = "prediction_text", evidence: str = "evidence_text") -> DataFrame:
    """Entailment of a template claim by the evidence, or the context where there is none.

    Adds semantic_hypothesis, semantic_label (the largest of entailment, neutral, contradiction, the first among
    equals), semantic_confidence (its probability), the three probabilities and semantic_verifier_model. Labels are
    resolved by their exact names. A row without question or answer raises, as it has no claim.
    """
    names = ("entailment_probability", "neutral_probability", "contradiction_probability")
    text = premise(evidence, context) if evidence in df.columns else T.clean_text(F.col(context))
    lacks = (T.clean_text(F.col(question)) == "") | (T.clean_text(F.col(answer)) == "")
    claim = F.when(lacks, F.raise_error(F.lit("a row has no question or no answer")).cast("string")).otherwise(T.claim_template(F.col(question), F.col(answer)))
    out = with_entailment(df.withColumns({"semantic_hypothesis": claim, "_premise": text}), load, "_premise", "semantic_hypothesis", names, exact=True).drop("_premise")
    e, n, c = (F.col(x) for x in names)
    return out.withColumns({"semantic_label": labels.largest([("ENTAILMENT", e), ("NEUTRAL", n), ("CONTRADICTION", c)]), "semantic_confidence": F.greatest(e, n, c), "semantic_verifier_model": F.lit(model)})


def agreement_verified(df: DataFrame, load: Callable[[], reading.Reader] = reading.lexical_reader, spec: reading.Spec = reading.Spec(), model: str = "", key: str = "row_idx", question: str = "question", context: str = "context", answer: str = "prediction_text", **thresholds: float) -> DataFrame:  # noqa: B008
    """A second reader that may abstain answers the same questions; where it agrees, an answer is supported.

    Adds verifier_answer, verifier_score, answer_match_f1, evidence_label, evidence_reason, verifier_model.
    """
    # the second answers are read beside the rows and not joined to them, so what the rows come from isn't worked out twice
    own = {c: f"_own_{c}" for c in ("prediction_text", "pipeline_score", "start", "end", "decision") if c in df.columns}
    key, question, context = (own.get(c, c) for c in (key, question, context))
    out = reading.native_answers(df.drop("verifier_answer", "verifier_score").withColumnsRenamed(own), load, spec, key=key, question=question, context=context).drop("start", "end", "decision")
    out = out.withColumnsRenamed({"prediction_text": "verifier_answer", "pipeline_score": "verifier_score"}).withColumnsRenamed({b: a for a, b in own.items()})
    out = out.withColumn("_x", labels.qa_agreement(F.col(answer), F.col("verifier_answer"), F.col("verifier_score"), **thresholds))
    return out.withColumns({"answer_match_f1": F.col("_x.f1"), "evidence_label": F.col("_x.label"), "evidence_reason": F.col("_x.reason"), "verifier_model": F.lit(model)}).drop("_x")
