"""Diagnostics: rank flips, correlations, examples, ablations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.functions.values import place_among, ratio
from prudence.operators import labels
from prudence.operators.ranks import average_rank, correlations  # noqa: F401, part of the diagnostics
from prudence.sources.stages import stored

#: Most stripes into which each score is cut for counting flips, and distinct score pairs of a stripe.
STRIPES, STRIPE_ROWS = 1024, 200_000
SIGNS = pa.schema([("baseline", pa.int32()), ("alternative", pa.int32()), ("pairs", pa.int64())])


def _cuts(found: list[float] | None) -> list[float]:
    """Bounds of stripes from rising quantiles; a value that stands more than once among them is a stripe of its own."""
    found = found or []
    return sorted({*found, *(math.nextafter(x, math.inf) for x, y in zip(found, found[1:], strict=False) if x == y)})


def signs(a: np.ndarray, b: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Numbers of (right, wrong) pairs by the signs of their differences in a and in b, each from -1 to 1, over weighted points.

    Points differ in a from the highest bit in which their ranks differ on, so each level of bits takes in the pairs
    that it parts, with one sort by b: d log^2 d for d points, and no pair is looked at alone.
    """
    ra, rb = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (a, b))
    width = int(rb.max(initial=0)) + 1
    out = np.zeros((3, 3), np.int64)

    def met(group: np.ndarray, mine: np.ndarray, theirs: np.ndarray, weight: np.ndarray, other: np.ndarray) -> tuple[int, int, int]:
        """Pairs of points of `mine` with points of `theirs` in the same group whose b is less, equal or greater."""
        key = group[theirs] * width + rb[theirs]
        order = np.argsort(key, kind="stable")
        key, upto = key[order], np.concatenate([[0], np.cumsum(other[theirs][order])])
        at = group[mine] * width
        begin, low, high, end = (upto[np.searchsorted(key, at + x, "left")] for x in (0, rb[mine], rb[mine] + 1, width))
        w = weight[mine]
        return int((w * (low - begin)).sum()), int((w * (high - low)).sum()), int((w * (end - high)).sum())

    some_r, some_w = np.flatnonzero(right), np.flatnonzero(wrong)
    for k in range(int(ra.max(initial=0)).bit_length()):
        group, half = ra >> (k + 1), (ra >> k) & 1
        for row, side in ((2, 1), (0, 0)):  # the right point has the greater a, or the smaller
            out[row, ::-1] += met(group, some_r[half[some_r] == side], some_w[half[some_w] != side], right, wrong)
    out[1, ::-1] += met(ra, some_r, some_w, right, wrong)
    return out


def rank_flips(df: DataFrame, baseline: str = "confidence", alternative: str = "fused", correct: str = "correct", stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """How two scores order every (right, wrong) pair: baseline, alternative (-1, 0, 1 by the sign of right minus wrong) and pairs.

    Equal pairs of scores are counted first. Both scores are cut into stripes of like many distinct pairs, a common
    value being a stripe of its own. Pairs that differ in both stripes follow from running sums over the grid of
    stripes, as do pairs that share a stripe of one value and differ in the other. What shares a stripe of several
    values is counted inside it by halves, a stripe at a time. No two rows and no two score pairs are compared.
    """
    c = F.col
    points = df.groupBy(c(baseline).cast("double").alias("a"), c(alternative).cast("double").alias("b")).agg(F.count_if(c(correct)).alias("right"), F.count_if(~c(correct)).alias("wrong"))
    points = stored(points, "points")
    g = max(2, min(STRIPES, -(-points.count() // stripe_rows)))
    places = [i / g for i in range(1, g)]
    quantiles = points.agg(*(F.percentile_approx(x, places, 100 * STRIPES).alias(x) for x in ("a", "b"))).first()
    bounds = {x: _cuts(quantiles[x]) for x in ("a", "b")}
    points = stored(points.withColumns({"i": place_among(F.col("a"), bounds["a"]), "j": place_among(F.col("b"), bounds["b"])}), "stripes")
    for x, i, flat in (("a", "i", "flat_i"), ("b", "j", "flat_j")):
        points = points.join(F.broadcast(points.groupBy(i).agg((F.min(x) == F.max(x)).alias(flat))), i)
    cells = points.groupBy("i", "j", "flat_i", "flat_j").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"))
    cells = stored(cells, "cells")
    n = len(bounds["a"]) + 1, len(bounds["b"]) + 1

    # sums of wrong rows over stripes up to (i, j), from -1
    grid = df.sparkSession.range((n[0] + 1) * (n[1] + 1)).select((F.floor(c("id") / (n[1] + 1)) - 1).cast("int").alias("i"), (c("id") % (n[1] + 1) - 1).cast("int").alias("j"))
    sums = grid.join(cells.select("i", "j", c("wrong").alias("n")), ["i", "j"], "left").na.fill(0, ["n"])
    upto = lambda by, order: W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("n", F.sum("n").over(upto("i", "j"))).withColumn("s", F.sum("n").over(upto("j", "i")))
    before, over = W.partitionBy("j").orderBy("i"), W.partitionBy("i").orderBy("j")
    # what lies under a cell, left of it, in both; and the totals of its row, its column and all
    sums = sums.select("i", "j", c("s").alias("mm"), F.lag("s").over(before).alias("lm"), F.lag("s").over(over).alias("ml"), F.max("s").over(W.partitionBy("i")).alias("ma"), F.max("s").over(W.partitionBy("j")).alias("am"))
    sums = sums.withColumns({"ll": F.lag("ml").over(before), "la": F.lag("ma").over(before), "al": F.lag("am").over(over)})
    total = cells.agg(F.coalesce(F.sum("wrong"), F.lit(0)).alias("aa"))
    met = cells.where("right > 0").join(sums, ["i", "j"]).join(F.broadcast(total))
    here = c("mm") - c("lm") - c("ml") + c("ll")
    below, above_b, above_a, beyond = c("ll"), c("la") - c("lm"), c("al") - c("ml"), c("aa") - c("ma") - c("am") + c("mm")
    left, right_of = c("lm") - c("ll"), c("am") - c("al") - c("lm") + c("ll") - here  # the same stripe of b, other stripes of a
    under, on_top = c("ml") - c("ll"), c("ma") - c("la") - c("ml") + c("ll") - here  # the same stripe of a
    when = lambda flat, x: F.when(c(flat), x).otherwise(0)
    rows = [(1, 1, below), (1, -1, above_b), (-1, 1, above_a), (-1, -1, beyond), (1, 0, when("flat_j", left)), (-1, 0, when("flat_j", right_of)), (0, 1, when("flat_i", under)), (0, -1, when("flat_i", on_top))]
    far = met.select(F.inline(F.array(*(F.struct(F.lit(x).alias("baseline"), F.lit(y).alias("alternative"), (c("right") * k).alias("pairs")) for x, y, k in rows)))).where("pairs > 0")

    # of a stripe of one value only a cell's own points remain: they differ in the other score alone
    inside = points.where("flat_i")
    by_b = W.partitionBy("i", "j").orderBy("b")
    inside = inside.select("right", "wrong", F.coalesce(F.sum("wrong").over(by_b.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("less"), F.sum("wrong").over(W.partitionBy("i", "j")).alias("all"))
    alone = inside.where("right > 0").select(F.inline(F.array(*(F.struct(F.lit(0).alias("baseline"), F.lit(y).alias("alternative"), (c("right") * k).alias("pairs")) for y, k in ((1, c("less")), (0, c("wrong")), (-1, c("all") - c("less") - c("wrong")))))))

    def counted(first: str, same: bool):
        def run(table: pa.Table) -> pa.Table:
            a, b, right, wrong = (table.column(x).to_numpy() for x in (first, "b", "right", "wrong"))
            found = signs(a, b, right, wrong)
            if not same:
                found[1] = 0
            return pa.table([np.repeat([-1, 0, 1], 3), np.tile([-1, 0, 1], 3), found.ravel()], ["baseline", "alternative", "pairs"]).cast(SIGNS)

        return run

    kind = "baseline int, alternative int, pairs long"
    in_a = points.where("NOT flat_i").groupBy("i").applyInArrow(counted("a", True), kind)
    in_b = points.where("NOT flat_j").groupBy("j").applyInArrow(counted("i", False), kind)
    return far.unionByName(alone).unionByName(in_a).unionByName(in_b).groupBy("baseline", "alternative").agg(F.sum("pairs").cast("long").alias("pairs")).where("pairs > 0")


def flip_summary(flips: DataFrame) -> DataFrame:
    """pairs, fixes (wrongly ordered before, rightly after), harms (the reverse), and their rates among the pairs that could have them."""
    b, a, n = F.col("baseline"), F.col("alternative"), F.col("pairs")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    one = flips.agg(F.coalesce(F.sum(n), F.lit(0)).alias("pairs"), pick((b == -1) & (a == 1)).alias("fixes"), pick((b == 1) & (a == -1)).alias("harms"), pick(b == -1).alias("_wrong"), pick(b == 1).alias("_right"))
    return one.select("pairs", "fixes", "harms", ratio(F.col("fixes"), F.col("_wrong")).alias("fix_rate"), ratio(F.col("harms"), F.col("_right")).alias("harm_rate"))


def top_examples(df: DataFrame, groups: dict[str, tuple[Column, list[Column]]], limit: int = 50, row_idx: str = "row_idx") -> DataFrame:
    """The first rows of each group by its own order: group, rank and all columns. Each group is a top-k of its own."""
    if limit < 1:
        raise ValueError("limit must be positive")
    out = None
    for name, (condition, order) in groups.items():
        best = df.where(condition).orderBy(*order, row_idx).limit(limit)
        ranked = best.withColumn("rank", F.row_number().over(W.orderBy(*order, row_idx))).withColumn("group", F.lit(name))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def disagreements(entailment: str = "entailment", confidence: str = "confidence", correct: str = "correct", high: float = 0.8, low: float = 0.2) -> dict[str, tuple[Column, list[Column]]]:
    """Four groups of rows to look at, each with its order."""
    e, c, right = F.col(entailment), F.col(confidence), F.col(correct)
    return {
        "incorrect_high_entailment": (~right & (e >= high), [F.desc(entailment)]),
        "correct_low_entailment": (right & (e <= low), [F.asc(entailment)]),
        "high_confidence_low_entailment": ((c >= high) & (e <= low), [F.desc(F.col(confidence) - F.col(entailment))]),
        "low_confidence_high_entailment": ((c <= low) & (e >= high), [F.desc(F.col(entailment) - F.col(confidence))]),
    }


#: Weights of confidence, lexical score and entailment, and whether contradiction counts.
ABLATIONS = {"full_hybrid": (0.25, 0.25, 0.50, True), "without_confidence": (0.0, 0.25, 0.50, True), "without_lexical": (0.25, 0.0, 0.50, True), "without_semantic": (0.25, 0.25, 0.0, False)}


def hybrid_ablation(df: DataFrame, confidence: str = "confidence", lexical: str = "lexical", entailment: str = "entailment", contradiction: str = "contradiction", correct: str = "correct") -> DataFrame:
    """Answers of the hybrid support label with all signals and without one each, with differences from the full one."""
    rows = []
    for name, (*weights, against) in ABLATIONS.items():
        score = labels.hybrid_score(F.col(confidence), F.col(lexical), F.col(entailment), tuple(weights))
        support = labels.hybrid_support(score, F.col(contradiction) if against else F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("config"), score.alias("s"), (support == "SUPPORTED").alias("answer")))
    long = df.select(F.col(correct).alias("right"), F.explode(F.array(*rows)).alias("r")).select("right", "r.*")
    a, right = F.col("answer"), F.col("right")
    one = long.groupBy("config").agg(F.count("*").alias("total"), F.count_if(a).alias("answered"), F.count_if(a & right).alias("answered_correct"), F.avg("s").alias("mean_score"))
    one = one.withColumn("coverage", ratio(F.col("answered"), F.col("total"), 0.0)).withColumn("selective_risk", ratio(F.col("answered") - F.col("answered_correct"), F.col("answered"), 0.0))
    full = F.broadcast(one.where("config = 'full_hybrid'").select(F.col("coverage").alias("_c"), F.col("selective_risk").alias("_r")))
    return one.join(full).select("config", "total", "answered", "answered_correct", "mean_score", "coverage", "selective_risk", (F.col("coverage") - F.col("_c")).alias("coverage_change"), (F.col("selective_risk") - F.col("_r")).alias("risk_change"))


def label_table(df: DataFrame, label: str, correct: str = "correct", value: str | None = None) -> DataFrame:
    """Rows, right rows and accuracy of each label, and the mean of a value."""
    out = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("count"), F.count_if(F.col(correct)).alias("correct_count"), *([F.avg(value).alias(f"mean_{value}")] if value else []))
    return out.withColumn("accuracy", F.col("correct_count") / F.col("count"))
