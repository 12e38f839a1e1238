"""Ranked prefixes: risk-coverage curves and what is read off them.

A global order would be one task. Rows are dealt into score cells instead, of equal width in log odds, so that scores
crowded near 0 or 1 are told apart; a score that many rows share is a cell of its own, dealt further by ranges of
row_idx, as many as its rows need. Ranks and running sums are taken inside each part, and the parts' sums, a small
table, give the offsets. Ties rank by row_idx.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.functions.values import ratio

#: Cells for each unit of log odds, the log odds beyond which scores share a cell, and rows of one score from which it is dealt further.
CELLS, FARTHEST, TIE_ROWS = 1024, 40, 100_000
EULER = 0.5772156649015329


def score_cell(score: Column, cells: int = CELLS) -> Column:
    """A number that never falls as a score in [0, 1] falls: its place by log odds."""
    odds = F.least(F.greatest(F.ln(1 - score) - F.ln(score), F.lit(-float(FARTHEST))), F.lit(float(FARTHEST)))
    return F.when(score >= 1, -FARTHEST * cells - 1).when(score <= 0, FARTHEST * cells + 1).otherwise(F.floor(odds * cells))


def ranked(df: DataFrame, by: Sequence[str] = ("method",), score: str = "score", row_idx: str = "row_idx", correct: str = "correct", cells: int = CELLS, tie_rows: int = TIE_ROWS) -> DataFrame:
    """Add answered (rank by falling score) and correct_answered (right rows up to it). Scores must lie in [0, 1]; others raise."""
    by = list(by)
    good = ~F.isnan(score) & F.col(score).between(0, 1)
    bucket = F.when(good, score_cell(F.col(score), cells)).otherwise(F.raise_error(F.lit("scores must lie between 0 and 1")).cast("long"))
    df = df.withColumn("_b", bucket).withColumn("_c", F.col(correct).cast("long"))
    ties = df.groupBy(*by, "_b", score).count().where(F.col("count") > tie_rows).groupBy(*by, "_b").agg(F.collect_list(F.struct(F.col(score).alias("v"), F.col("count").alias("n"))).alias("_ties"))
    reach = df.agg(F.min(row_idx).alias("_lo"), F.max(row_idx).alias("_hi"))
    # at most one score in tie_rows rows is tied that often, and the groups are few: both sides are small
    df = df.join(ties, [*by, "_b"], "left").join(F.broadcast(reach))
    rows = F.get(F.filter("_ties", lambda t: t["v"] == F.col(score)), F.lit(0))["n"]
    tied = rows.isNotNull()
    above = F.coalesce(F.size(F.filter("_ties", lambda t: t["v"] > F.col(score))), F.lit(0))
    part = F.when(tied, F.floor((F.col(row_idx) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1).cast("double") * F.ceil(rows / F.lit(float(tie_rows))))).otherwise(0)
    df = df.withColumn("_s", F.greatest(above, F.lit(0)) * 2 + tied.cast("int")).withColumn("_p", part).drop("_ties", "_lo", "_hi")
    key = [*by, "_b", "_s", "_p"]
    sums = df.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_c").alias("_k"))
    before = W.partitionBy(*by).orderBy("_b", "_s", "_p").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"))
    inside = W.partitionBy(*key).orderBy(F.desc(score), row_idx)
    df = df.withColumn("_r", F.row_number().over(inside)).withColumn("_t", F.sum("_c").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    out = df.join(sums, key).withColumn("answered", (F.col("_r") + F.col("_n0")).cast("long")).withColumn("correct_answered", F.col("_t") + F.col("_k0"))
    return out.drop("_b", "_s", "_p", "_r", "_t", "_n0", "_k0", "_c")


def risk_coverage(df: DataFrame, by: Sequence[str] = ("method",), score: str = "score", row_idx: str = "row_idx", correct: str = "correct") -> DataFrame:
    """A row for every non-empty prefix: answered, coverage, selective_accuracy, risk, wrong_answered, minimum_score, n."""
    total = F.broadcast(df.groupBy(*by).agg(F.count("*").alias("n")))
    c = F.col
    out = ranked(df, by, score, row_idx, correct).join(total, list(by))
    return out.select(*by, row_idx, "answered", (c("answered") / c("n")).alias("coverage"), (c("correct_answered") / c("answered")).alias("selective_accuracy"), ((c("answered") - c("correct_answered")) / c("answered")).alias("risk"), (c("answered") - c("correct_answered")).alias("wrong_answered"), c(score).alias("minimum_score"), "n")


def with_zero_point(curve: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """The curve and, for each group, the point of no coverage: risk 0, accuracy 1."""
    zero = curve.select(*by, "n").distinct().select(*by, "n", F.lit(0).cast("long").alias("answered"), F.lit(0.0).alias("coverage"), F.lit(1.0).alias("selective_accuracy"), F.lit(0.0).alias("risk"), F.lit(0).cast("long").alias("wrong_answered"))
    return curve.unionByName(zero, allowMissingColumns=True)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 64, beyond by its asymptotic series, whose error is under 1e-16."""
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(64)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)
    x = F.greatest(n, F.lit(1)).cast("double")
    many = F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return F.when(n <= 0, 0.0).when(n <= 64, few).otherwise(many)


def optimal_aurc(n: Column, right: Column) -> Column:
    """Area under the curve of an order with all right rows first."""
    return ((n - right) - right * (harmonic(n) - harmonic(right))) / n


def aurc_summary(df: DataFrame, by: Sequence[str] = ("method",), score: str = "score", row_idx: str = "row_idx", correct: str = "correct") -> DataFrame:
    """n, accuracy, aurc (mean risk of the prefixes), and the areas of a perfect and a random order with the normalised area (null if they agree)."""
    curve = risk_coverage(df, by, score, row_idx, correct)
    one = curve.groupBy(*by).agg(F.max("n").alias("n"), F.avg("risk").alias("aurc"), F.max(F.when(F.col("answered") == F.col("n"), F.col("n") - F.col("wrong_answered"))).alias("_right"))
    c = F.col
    one = one.withColumn("accuracy", c("_right") / c("n")).withColumn("optimal_aurc", optimal_aurc(c("n"), c("_right"))).withColumn("random_aurc", 1 - c("accuracy"))
    gap = c("random_aurc") - c("optimal_aurc")
    return one.select(*by, "n", "accuracy", "aurc", "optimal_aurc", "random_aurc", F.when(F.abs(gap) > 1e-12, (c("aurc") - c("optimal_aurc")) / gap).alias("normalized_aurc"))


def matched_coverage(df: DataFrame, coverages: Sequence[float], by: Sequence[str] = ("method",), score: str = "score", row_idx: str = "row_idx", correct: str = "correct") -> DataFrame:
    """The top max(1, ceil(coverage n)) rows for each coverage."""
    if not all(0 < x <= 1 for x in coverages):
        raise ValueError("coverages must lie in (0, 1]")
    curve = risk_coverage(df, by, score, row_idx, correct)
    totals = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col(correct)).alias("_wrong"))
    wanted = totals.select(*by, "n", "_wrong", F.explode(F.array(*map(F.lit, map(float, coverages)))).alias("target_coverage"))
    wanted = wanted.withColumn("answered", F.greatest(F.lit(1), F.ceil(F.col("target_coverage") * F.col("n"))).cast("long")).drop("n")
    c = F.col
    out = curve.join(F.broadcast(wanted), [*by, "answered"])
    return out.select(
        *by, "target_coverage", "n", "answered", (c("n") - c("answered")).alias("abstained"), "coverage", (c("answered") - c("wrong_answered")).alias("correct_answered"), "wrong_answered",
        "selective_accuracy", "risk", (c("_wrong") - c("wrong_answered")).alias("wrong_rejected"), (c("n") - c("answered") - c("_wrong") + c("wrong_answered")).alias("correct_rejected"), ratio(c("_wrong") - c("wrong_answered"), c("_wrong")).alias("wrong_rejected_share"), "minimum_score",
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], score: str = "score", correct: str = "correct", by: Sequence[str] = ()) -> DataFrame:
    """Answers at score >= threshold, for each threshold. Without answers accuracy is 1 and risk 0. Rows are counted once, by the last threshold that they reach; sums from above give the rest."""
    if not all(0 <= t <= 1 for t in thresholds):
        raise ValueError("thresholds must lie between 0 and 1")
    levels = sorted(set(map(float, thresholds)))
    reached = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col(score)))
    counts = df.groupBy(*by, reached.alias("_level")).agg(F.count("*").alias("_n"), F.count_if(F.col(correct)).alias("_c"))
    every = df.sparkSession.createDataFrame(list(enumerate(levels, 1)), "_level int, threshold double")
    every = F.broadcast(every)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("total"))
    grid = total.join(every).join(counts, [*by, "_level"], "left")
    down = W.partitionBy(*by).orderBy(F.desc("_level")).rowsBetween(W.unboundedPreceding, 0)
    c = F.col
    out = grid.withColumn("answered", F.coalesce(F.sum("_n").over(down), F.lit(0))).withColumn("correct_answered", F.coalesce(F.sum("_c").over(down), F.lit(0)))
    some = c("answered") > 0
    return out.select(*by, "threshold", "total", "answered", (c("total") - c("answered")).alias("abstained"), (c("answered") / c("total")).alias("coverage"), F.when(some, c("correct_answered") / c("answered")).otherwise(1.0).alias("selective_accuracy"), F.when(some, (c("answered") - c("correct_answered")) / c("answered")).otherwise(0.0).alias("selective_risk"), "correct_answered", (c("answered") - c("correct_answered")).alias("wrong_answered"))


def threshold_list(start: float, end: float, step: float) -> list[float]:
    """start, start + step, ... up to end, by repeated addition, rounded to 10 places."""
    out, x = [], start
    while x <= end + 1e-12:
        out.append(round(x, 10))
        x += step
    return out


def nearest_coverage(points: DataFrame, targets: Sequence[float], larger_on_tie: bool, by: Sequence[str] = (), positive_only: bool = False, coverage: str = "coverage", risk: str = "risk") -> DataFrame:
    """The point nearest to each target coverage: on a tie the smaller coverage, or the larger and then the lower risk."""
    used = points.where(F.col(coverage) > 0) if positive_only else points
    goal = F.explode(F.array(*map(F.lit, map(float, targets)))).alias("target_coverage")
    far = F.abs(F.col(coverage) - F.col("target_coverage"))
    order = F.struct(far, -F.col(coverage), F.col(risk)) if larger_on_tie else F.struct(far, F.col(coverage), F.col(risk))
    out = used.select(*by, coverage, risk, goal).groupBy(*by, "target_coverage").agg(F.min_by(F.struct(coverage, risk), order).alias("_m"))
    return out.select(*by, "target_coverage", F.col("_m")[coverage].alias("coverage"), F.col("_m")[risk].alias("risk"))


def trapezoid_area(points: DataFrame, by: Sequence[str] = (), x: str = "coverage", y: str = "risk") -> DataFrame:
    """Area under the polygon of sorted points. Points must be few (a table of coverages)."""
    w = W.partitionBy(*by).orderBy(x)
    step = points.select(*by, ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("_a"))
    return step.groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def best_method(points: DataFrame, priority: Sequence[str], key: str = "target_coverage", method: str = "method", risk: str = "risk") -> DataFrame:
    """The method of least risk at each coverage; among equals the one that stands first in priority."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(method))
    return points.groupBy(key).agg(F.min_by(method, F.struct(F.col(risk), place)).alias("best_method"), F.min(risk).alias("best_risk"))


def methods(df: DataFrame, scores: dict[str, Column], keep: Sequence[str] = ("row_idx", "correct")) -> DataFrame:
    """Long form: a row for each method and row, with its score."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("method"), s.cast("double").alias("score")) for n, s in scores.items()))).alias("_m")).select(*keep, "_m.method", "_m.score")


def nested_samples(df: DataFrame, sizes: Sequence[int], seed: int = 17, row_idx: str = "row_idx") -> DataFrame:
    """Nested samples: the first N rows in the order of a hash of the seed and the row, for each N. The order is by md5, so other engines can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_idx).cast("string")))
    first = df.select(row_idx, digest.alias("_h")).orderBy("_h", row_idx).limit(max(sizes))
    order = W.orderBy("_h", row_idx)
    # the largest sample is bounded by the sizes asked for, so its order may be taken in one task
    places = first.withColumn("order_rank", F.row_number().over(order)).drop("_h")
    return df.join(F.broadcast(places), row_idx).select("*", F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("sample_size")).where(F.col("order_rank") <= F.col("sample_size"))
