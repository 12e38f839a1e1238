"""Sources and sinks: JSON lines, JSON and CSV reports, prepared splits, prediction tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from prudence.operators.resample import stratified_split
from prudence.operators.validate import InvalidRows, require
from prudence.sources.stages import stored

EXAMPLE = "id string, question string, context string, answers struct<text: array<string>, answer_start: array<int>>"
PREDICTION = "row_idx bigint, id string, split string, question string, context string, prediction_text string, reference_answers array<string>, is_answerable boolean, decision string, confidence double"
CURVE = "coverage double, risk double, selective_accuracy double, threshold double"


def read_jsonl(spark: SparkSession, path: str, schema: S.StructType | str | None = None) -> DataFrame:
    """JSON objects, one a line; blank lines are passed over. Malformed lines and lines that aren't objects raise, and so does an empty input."""
    reader = spark.read.option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    if df.isEmpty():
        raise InvalidRows(f"{path} has no records")
    return df


def with_row_index(df: DataFrame, order: Sequence[str] = (), name: str = "row_idx") -> DataFrame:
    """Number rows from 0, with JVM columns only.

    With order: by those columns; the rows are dealt by ranges, sorted inside them and stored. Without: in the order of
    the files by path and of the rows inside them, for a table as it is read from files. Either way the parts' counts,
    a table of a row a part, give the offsets.
    """
    if order:
        df = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_start": F.lit(0).cast("long"), "_at": F.monotonically_increasing_id()}), "ordered")
    else:
        df = df.select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    parts = df.groupBy("_part", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.orderBy("_part", "_start").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return df.join(F.broadcast(parts), ["_part", "_start"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_start", "_at", "_shift")


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables read from files, side by side by their place; tables of different lengths raise."""
    a, b = with_row_index(left), with_row_index(right)
    both = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), "row_idx", "full")
    whole = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("row_idx")).otherwise(F.raise_error(F.lit("the tables have different numbers of rows")).cast("long"))
    return both.withColumn("row_idx", whole).drop("_l", "_r")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A table of one row as a JSON object in a local file."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise InvalidRows("a report has one row")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows[0].asDict(recursive=True), indent=4, default=str), encoding="utf-8")


def read_report(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """Points of a curve from CSV, all of them finite numbers."""
    df = spark.read.schema(CURVE).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return require(df, {c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in df.columns}).orderBy("coverage")


def read_random_runs(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of random abstention by coverage, rounded to ten places."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema("results array<struct<target_coverage: double, summary: struct<mean_selective_risk: double, mean_answer_accuracy: double>>>").json(path)
    return df.select(F.inline("results")).select(F.round("target_coverage", 10).alias("target_coverage"), "summary.*")


def prepare_examples(examples: DataFrame, path: str, fraction: float = 0.5, seed: int = 17, overwrite: bool = False) -> None:
    """Label examples, split them by label and write them as Parquet by split. An existing target is only replaced if asked for."""
    labelled = examples.withColumn("label", (F.coalesce(F.size("answers.text"), F.lit(0)) > 0).cast("int"))
    stratified_split(labelled, fraction, seed, "id", "label").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows of one split; only its files are read. With limit the first ones by order."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    if limit is None:
        return df
    if limit < 1:
        raise ValueError("limit must be positive")
    return df.orderBy(order).limit(limit)


def complete(spark: SparkSession, path: str, rows: int) -> bool:
    """Whether a stage's output is there with as many rows as wanted, so that the stage can be passed over."""
    try:
        return spark.read.parquet(path).count() == rows
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def markdown(df: DataFrame, columns: Sequence[str], limit: int = 50) -> str:
    """The first rows of a table, a bounded report, as Markdown."""
    rows = df.select(*columns).limit(limit).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def merged(base: dict, other: dict) -> dict:
    """Settings of two levels; the later wins, dictionaries are merged."""
    out = dict(base)
    for k, v in other.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
