"""Selective metrics over streams. Counts are incremental; curves need a global order and aren't offered here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(stream: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes", decision: str = "decision", correct: str = "correct") -> DataFrame:
    """Counts, coverage and risk of each time window; rows later than `late` behind the newest are dropped. Works on batches too."""
    a = F.col(decision) == "ANSWER"
    right = F.col(correct)
    out = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w")).agg(F.count("*").alias("total"), F.count_if(a).alias("answered"), F.count_if(a & right).alias("answered_correct"))
    n, k = F.col("answered"), F.col("answered_correct")
    return out.select(F.col("w.start").alias("window_start"), "total", n, k, (n / F.col("total")).alias("coverage"), F.when(n > 0, 1 - k / n).otherwise(0.0).alias("selective_risk"))
