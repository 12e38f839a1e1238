"""Row correctness. The definitions differ on purpose and are never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions.values import flag_column

#: Aliases of stored correctness, in order of preference.
STORED = ("is_correct", "correct", "prediction_correct", "answer_correct", "exact_match_correct", "exact_match", "em", "qa_correct", "correctness", "is_prediction_correct", "label_correct")


def is_answerable(answers: Column) -> Column:
    """1 if the example has an answer text, else 0."""
    return (F.coalesce(F.size(answers.getField("text")), F.lit(0)) > 0).cast("int")


def first_candidate(candidates: Column) -> Column:
    """First candidate with text and a span of positive length; raises if there is none."""
    usable = F.filter(candidates, lambda c: (F.trim(c["answer"]) != "") & (c["end"] > c["start"]))
    return F.coalesce(F.get(usable, F.lit(0)), F.when(F.lit(True), F.raise_error(F.lit("no usable candidate")).cast("struct<answer:string,score:double,start:int,end:int>")))


def native_decision(prediction: Column) -> Column:
    return F.when(F.trim(F.coalesce(prediction, F.lit(""))) != "", "ANSWER").otherwise("ABSTAIN")


def threshold_answer(df: DataFrame, threshold: float, score: str = "pipeline_score", text: str = "prediction_text") -> DataFrame:
    """Answer where the raw score reaches the threshold, else the refusal text."""
    answered = F.col(score) >= threshold
    return df.withColumn("decision", F.when(answered, "ANSWER").otherwise("ABSTAIN")).withColumn(text, F.when(answered, F.col(text)).otherwise("I do not know"))


def task_correctness(df: DataFrame, prediction: str = "prediction_text", references: str = "reference_answers", answerable: str = "is_answerable", decision: str = "decision") -> DataFrame:
    """Add exact_match, token_f1 and is_correct: an answer is right if it matches an answerable row's reference, an abstention if the row is unanswerable.

    Decisions other than ANSWER and ABSTAIN raise.
    """
    choice = T.upper_label(F.col(decision))
    choice = F.when(choice.isin("ANSWER", "ABSTAIN"), choice).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), choice)).cast("string"))
    can = flag_column(df, answerable, "answerability", strict=True)
    df = df.withColumn(decision, choice).withColumn(answerable, can)
    scored = (F.col(decision) == "ANSWER") & F.col(answerable)
    df = df.withColumn("exact_match", F.when(scored, T.exact_match(F.col(prediction), F.col(references))).otherwise(0.0))
    df = df.withColumn("token_f1", F.when(scored, T.best_f1(F.col(prediction), F.col(references))).otherwise(0.0))
    return df.withColumn("is_correct", F.when(F.col(decision) == "ANSWER", F.col("exact_match") == 1.0).otherwise(~F.col(answerable)))


def forced_answers(df: DataFrame, **columns: str) -> DataFrame:
    """Task correctness as if every row were answered."""
    return task_correctness(df.withColumn(columns.get("decision", "decision"), F.lit("ANSWER")), **columns)


def forced_correctness(prediction: Column, references: Column, answerable: Column) -> Column:
    """Unanswerable rows are wrong; else the normalised prediction is among the normalised references, empty ones with them."""
    return F.when(~answerable, False).otherwise(F.coalesce(F.array_contains(F.transform(references, T.normalize_answer), T.normalize_answer(prediction)), F.lit(False)))


def inferred_correctness(prediction: Column, references: Column, answerable: Column | None = None, decision: Column | None = None) -> Column:
    """Exact match to a reference that doesn't normalise to nothing; an unanswerable row is right if it abstains, or has no decision and a blank prediction.

    A flag that contradicts the references raises, as does a decision other than ANSWER and ABSTAIN of an unanswerable row.
    """
    usable = F.filter(F.transform(references, T.normalize_answer), lambda r: r != "")
    some = F.coalesce(F.exists(references, lambda r: T.normalize_answer(r) != ""), F.lit(False))
    can = some if answerable is None else F.coalesce(answerable, some)
    choice = F.lit("") if decision is None else T.upper_label(decision)
    fail = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    return (
        F.when(can & ~some, fail("answerable without a usable reference"))
        .when(~can & some, fail("unanswerable with references"))
        .when(can, F.array_contains(usable, T.normalize_answer(prediction)))
        .when(choice == "", T.clean_text(prediction) == "")
        .when(choice.isin("ANSWER", "ABSTAIN"), choice == "ABSTAIN")
        .otherwise(fail("decision must be ANSWER or ABSTAIN"))
    )


def diagnostic_correctness(prediction: Column, references: Column, answerable: Column) -> Column:
    """As inferred, but an unanswerable row is always wrong."""
    return F.when(~answerable, False).otherwise(inferred_correctness(prediction, references, answerable))


def relaxed_correctness(prediction: Column, references: Column, answerable: Column, least_f1: float = 0.80) -> Column:
    """Answerable, and an exact match or a pairwise F1 of at least least_f1."""
    return answerable & ((T.exact_match(prediction, references) == 1.0) | (T.best_f1_pair(prediction, references) >= least_f1))


def stored_correctness(df: DataFrame) -> Column:
    """First stored flag that reads as one; null if none does."""
    have = [flag_column(df, c, "correctness") for c in STORED if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("boolean")
