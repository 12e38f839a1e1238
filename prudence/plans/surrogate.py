"""Prediction tables derived from the driver's tables by arithmetic that every engine evaluates alike.

The column expressions are SQL that Spark and DuckDB both read, so queries and their oracles share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def unit(key: str, factor: int, modulus: int) -> str:
    return f"(cast(({key} * {factor}) % {modulus} as double) / {modulus - 1})"


LABELS = {
    "row_idx": "d.doc_id", "correct": "(quality = 1)", "is_answerable": "(toxic = 0)", "confidence": "(cast(n_chars % 1009 as double) / 1008)", "entailment": unit("d.doc_id", 7919, 1009),
    "claim_valid": "(d.doc_id % 9 <> 0)", "self_score": "(cast((d.doc_id * 104729) % 2001 - 1000 as double) / 1000)", "lang": "lang",
}
EVENTS = {
    "row_idx": "event_id", "correct": "(event_type IN ('purchase', 'signup'))", "is_answerable": "(event_type <> 'error')", "confidence": unit("event_id", 7919, 1009), "entailment": unit("event_id", 104729, 1013),
    "claim_valid": "(event_id % 9 <> 0)", "self_score": "(cast((event_id * 15485863) % 2001 - 1000 as double) / 1000)", "lexical": unit("event_id", 31337, 997),
    "against": "(cast(event_id % 11 as double) / 10)", "event_type": "event_type", "user_id": "user_id",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


#: Queries of the surrogate tables, with names of tables that stand for Parquet files.
LABELS_SQL = _select(LABELS, "{labels} l JOIN {documents} d ON l.doc_id = d.doc_id")
EVENTS_SQL = "SELECT *, (1 - entailment) * against AS contradiction, (1 - entailment) * (1 - against) AS neutral FROM (" + _select(EVENTS, "{events}") + ") t"
PAIRS_SQL = "SELECT q.conv_id * 100 + q.turn AS row_idx, q.text AS question, a.text AS answer FROM {conversations} q JOIN {conversations} a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"

#: Every document as a context, with the first thing that the user of some conversation says as its question.
QUESTIONS_SQL = "SELECT d.doc_id AS row_idx, coalesce(q.text, '') AS question, coalesce(d.text, '') AS context FROM {documents} d LEFT JOIN (SELECT conv_id, min_by(text, turn) AS text FROM {conversations} WHERE role = 'user' GROUP BY conv_id) q ON q.conv_id = d.doc_id % 100"


def table(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...]) -> DataFrame:
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **frames)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, LABELS_SQL, ("labels", "documents"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, EVENTS_SQL, ("events",))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PAIRS_SQL, ("conversations",))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, QUESTIONS_SQL, ("documents", "conversations"))


def _named(sql: str, *names: str) -> str:
    return sql.format(**{n: n for n in names})


#: The same as DuckDB common table expressions p (labels), e (events), t (text pairs) and q (questions).
WITH_P = f"p AS MATERIALIZED ({_named(LABELS_SQL, 'labels', 'documents')})"
WITH_E = f"e AS MATERIALIZED ({_named(EVENTS_SQL, 'events')})"
WITH_T = f"t AS MATERIALIZED ({_named(PAIRS_SQL, 'conversations')})"
WITH_Q = f"q AS MATERIALIZED ({_named(QUESTIONS_SQL, 'documents', 'conversations')})"
