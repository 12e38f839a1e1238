"""Calibration: bins and errors, temperature, threshold search, fusion weights."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.functions.values import finite, log_loss, logit_loss, place_among, ratio, sigmoid, weighted_geometric_mean
from prudence.operators import ranking
from prudence.sources.stages import stored

#: Bins into which a round of exact selection cuts a stretch.
BINS = 1024


def edges(bins: int) -> list[float]:
    """Equal-width bounds as i * (1 / bins), the last exactly 1: 0.3 lies under the fourth of ten."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def linspace_bin(value: Column, bins: int = 10) -> Column:
    """Bin of a value by those bounds, [low, high) but the last, which takes 1 too."""
    inner = F.array(*map(F.lit, edges(bins)[1:-1]))
    return F.size(F.filter(inner, lambda e: e <= value))


def scaled_bin(value: Column, bins: int = 10) -> Column:
    """Bin by the whole part of value * bins: 0.3 is in bin 3 of ten."""
    return F.least(F.floor(value * bins).cast("int"), F.lit(bins - 1))


def calibration_bins(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10, by: Sequence[str] = (), keep_empty: bool = True) -> DataFrame:
    """bin, bin_start, bin_end, count, mean_confidence, accuracy, gap; empty bins have nulls, or are left out."""
    found = df.groupBy(*by, linspace_bin(F.col(confidence), bins).alias("bin")).agg(F.count("*").alias("count"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    e = edges(bins)
    every = F.broadcast(df.sparkSession.createDataFrame([(i, e[i], e[i + 1]) for i in range(bins)], "bin int, bin_start double, bin_end double"))
    if by:
        every = df.select(*by).distinct().join(every)
    out = every.join(found, [*by, "bin"], "left" if keep_empty else "inner")
    return out.select(*by, "bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "mean_confidence", "accuracy", F.abs(F.col("mean_confidence") - F.col("accuracy")).alias("gap"))


def calibration_report(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """One row: n, accuracy, mean_confidence, confidence_gap, ece, mce, brier, nll. Everything comes from one pass by bin."""
    c, y = F.col(confidence), F.col(correct).cast("double")
    found = df.groupBy(linspace_bin(c, bins).alias("bin")).agg(
        F.count("*").alias("k"), F.sum(c).alias("sc"), F.sum(y).alias("sy"), F.sum(F.pow(c - y, F.lit(2.0))).alias("sb"), F.sum(log_loss(c, y)).alias("sl")
    )
    gap = F.abs(F.col("sc") - F.col("sy"))
    one = found.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), *(F.sum(x).alias(x) for x in ("sc", "sy", "sb", "sl")), F.sum(gap).alias("g"), F.max(gap / F.col("k")).alias("m"))
    n = F.col("n")
    return one.select(
        "n", ratio(F.col("sy"), n).alias("accuracy"), ratio(F.col("sc"), n).alias("mean_confidence"), F.abs(ratio(F.col("sc"), n) - ratio(F.col("sy"), n)).alias("confidence_gap"),
        ratio(F.col("g"), n).alias("ece"), F.coalesce("m", F.lit(0.0)).alias("mce"), ratio(F.col("sb"), n).alias("brier"), ratio(F.col("sl"), n).alias("nll"),
    )


def fit_temperature(df: DataFrame, margin: str = "answer_null_margin", correct: str = "correct", split: str | None = None, steps: int = 60) -> float:
    """Temperature T that minimises the log loss of sigmoid(margin / T), by Newton steps on ln T over two sums a step.

    With split, every row must be of the split `calibration`. Both classes must occur, and the margins must speak for
    the right rows, or no positive T is best.
    """
    if split and not df.where(~F.coalesce(F.col(split) == "calibration", F.lit(False))).isEmpty():
        raise ValueError("temperature may only be fitted on the calibration split")
    y = F.col(correct).cast("double")
    seen = df.agg(F.min(y), F.max(y), F.covar_pop(F.col(margin), y)).first()
    if seen[0] is None or seen[0] == seen[1]:
        raise ValueError("both right and wrong rows are needed")
    b = 0.0  # ln of 1 / T
    bound = 12.0
    import math

    for _ in range(steps):
        a = math.exp(b)
        p = sigmoid(F.col(margin) * a)
        first, second = df.agg(F.avg((p - y) * F.col(margin)), F.avg(p * (1 - p) * F.col(margin) ** 2)).first()
        gradient, curve = first * a, second * a * a + first * a
        move = -gradient / curve if curve > 1e-12 else -math.copysign(0.5, gradient)
        move = max(-1.0, min(1.0, move))
        b += move
        if abs(b) > bound:
            raise ValueError("no finite positive temperature fits")
        if abs(move) < 1e-10:
            break
    return math.exp(-b)


def apply_temperature(df: DataFrame, temperature: float, margin: str = "answer_null_margin") -> DataFrame:
    """Keep the raw confidence and replace it by sigmoid(margin / temperature)."""
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    logit = F.col(margin) / F.lit(float(temperature))
    raw = F.col("confidence") if "confidence" in df.columns else sigmoid(F.col(margin))
    df = df.withColumn("uncalibrated_confidence", raw).withColumn("calibrated_logit", logit)
    return df.withColumn("calibrated_confidence", sigmoid(F.col("calibrated_logit"))).withColumn("confidence", F.col("calibrated_confidence")).withColumn("temperature", F.lit(float(temperature))).withColumn("confidence_is_calibrated", F.lit(True))


def temperature_nll(df: DataFrame, temperature: float = 1.0, margin: str = "answer_null_margin", correct: str = "correct") -> DataFrame:
    return df.agg(F.avg(logit_loss(F.col(margin) / F.lit(float(temperature)), F.col(correct).cast("double"))).alias("nll"))


def order_statistics(df: DataFrame, value: str, places: Callable[[int], Sequence[int]]) -> dict[int, float]:
    """Exact values at places (from 0) of the sorted finite values; `places` gets their number.

    Distinct values are counted once. Every round cuts the stretch that holds a place into BINS bins and goes on with
    the bin that the place falls into, from its least to its largest value, until that is one value. A round is one
    aggregation, of which at most BINS rows a place come to the driver; no task holds the values.
    """
    x = finite(F.col(value))
    counts = stored(df.groupBy(x.alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL"), "counts")
    whole = counts.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    wanted = sorted(set(places(whole["n"] or 0)))
    if not wanted:
        return {}
    if wanted[0] < 0 or wanted[-1] >= whole["n"]:
        raise ValueError(f"there are {whole['n']} values")
    found: dict[int, float] = {}
    stretches = {(whole["lo"], whole["hi"], 0): wanted}  # least value, largest value, values before: places
    while stretches:
        found |= {k: lo for (lo, hi, _), ks in stretches.items() if lo == hi for k in ks}
        open_ones = sorted(k for k in stretches if k[0] != k[1])
        if not open_ones:
            break
        lows, highs = ([k[i] for k in open_ones] for i in (0, 1))
        at = place_among(F.col("v"), lows)
        of = lambda values: F.get(F.expr(f"array({', '.join(f"double('{b!r}')" for b in values)})"), F.col("_at") - 1)
        inside = counts.withColumn("_at", at).withColumns({"_lo": of(lows), "_hi": of(highs)}).where("_at > 0 AND v <= _hi")
        # halves first, so that the width of the widest stretch is finite
        share = (F.col("v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        binned = inside.groupBy("_at", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = defaultdict(list)
        for r in binned.collect():
            bins[r["_at"] - 1].append((r["bin"], r["n"], r["lo"], r["hi"]))
        after = defaultdict(list)
        for i, key in enumerate(open_ones):
            before, rows = key[2], iter(sorted(bins[i]))
            row = next(rows)
            for k in stretches[key]:
                while k >= before + row[1]:
                    before, row = before + row[1], next(rows)
                after[row[2], row[3], before].append(k)
        stretches = after
    return found


def quantile_candidates(df: DataFrame, confidence: str = "confidence", grid: int = 101) -> DataFrame:
    """Distinct linear quantiles of the confidences, exact ones, with 0 and 1: candidate."""
    if grid < 3:
        raise ValueError("the grid needs three points or more")
    spots = {}

    def places(n: int) -> list[int]:
        spots.update({i: divmod(i * (n - 1), grid - 1) for i in range(grid)} if n else {})
        return [k for at, rest in spots.values() for k in ((at, at + 1) if rest else (at,))]

    known = order_statistics(df, confidence, places)
    found = {0.0, 1.0}
    for at, rest in spots.values():
        low, high = known[at], known[at + 1] if rest else known[at]
        found.add(low + (high - low) * (rest / (grid - 1)))
    return df.sparkSession.createDataFrame([(x,) for x in sorted(found)], "candidate double")


def threshold_pairs(df: DataFrame, confidence: str = "confidence", correct: str = "correct", grid: int = 101) -> DataFrame:
    """All pairs of candidates abstain < answer with their counts and rates. Rows are counted once, between candidates; pairs read sums."""
    candidates = [r["candidate"] for r in quantile_candidates(df, confidence, grid).orderBy("candidate").collect()]
    levels = F.array(*map(F.lit, candidates))
    over = F.size(F.filter(levels, lambda c: c <= F.col(confidence)))  # candidates not over the row
    under = F.size(F.filter(levels, lambda c: c < F.col(confidence)))  # candidates under the row
    counts = df.groupBy(over.alias("_o"), under.alias("_u")).agg(F.count("*").alias("_n"), F.count_if(F.col(correct)).alias("_c"))
    spark = df.sparkSession
    every = F.broadcast(spark.createDataFrame(list(enumerate(candidates, 1)), "_i int, candidate double"))
    sums = every.join(F.broadcast(counts)).groupBy("_i", "candidate").agg(
        F.sum(F.when(F.col("_o") >= F.col("_i"), F.col("_n")).otherwise(0)).alias("an"), F.sum(F.when(F.col("_o") >= F.col("_i"), F.col("_c")).otherwise(0)).alias("ac"),
        F.sum(F.when(F.col("_u") < F.col("_i"), F.col("_n")).otherwise(0)).alias("bn"), F.sum(F.when(F.col("_u") < F.col("_i"), F.col("_c")).otherwise(0)).alias("bc"), F.sum("_n").alias("n"),
    )
    low, high = sums.alias("l"), sums.alias("h")
    c = F.col
    pairs = low.join(F.broadcast(high), c("l.candidate") < c("h.candidate"))
    n = c("l.n")
    return pairs.select(
        c("l.candidate").alias("abstain_threshold"), c("h.candidate").alias("answer_threshold"), n.alias("total"), c("h.an").alias("answer_count"), (n - c("h.an") - c("l.bn")).alias("verify_count"), c("l.bn").alias("abstain_count"),
        c("h.ac").alias("answer_correct"), (c("h.an") - c("h.ac")).alias("answer_incorrect"), c("l.bc").alias("abstain_correct"), (c("l.bn") - c("l.bc")).alias("abstain_incorrect"),
        ratio(c("h.ac"), c("h.an")).alias("answer_accuracy"), ratio(c("h.an") - c("h.ac"), c("h.an")).alias("answer_risk"), ratio(c("l.bc"), c("l.bn")).alias("abstain_correct_rate"),
        (c("h.an") / n).alias("answer_coverage"), (c("l.bn") / n).alias("abstain_rate"), ((c("h.an") + c("l.bn")) / n).alias("direct_decision_rate"), ((c("h.an") - c("h.ac")) / n).alias("false_answer_rate"), (c("l.bc") / n).alias("unnecessary_abstention_rate"),
    )


def select_thresholds(df: DataFrame, confidence: str = "confidence", correct: str = "correct", most_risk: float = 0.10, most_abstain_correct: float = 0.25, least_answered: float = 0.05, least_abstained: float = 0.05, grid: int = 101) -> DataFrame:
    """The best pair: among those that keep both limits the one of most coverage, then most direct decisions, least risk, fewest right abstentions; if none keeps them, the one that breaks them least. Ties go to the lower thresholds."""
    for x in (most_risk, most_abstain_correct, least_answered, least_abstained):
        if not 0 <= x <= 1:
            raise ValueError("limits must lie between 0 and 1")
    c = F.col
    pairs = threshold_pairs(df, confidence, correct, grid)
    enough = (c("answer_count") >= F.greatest(F.lit(1), F.ceil(c("total") * F.lit(float(least_answered))))) & (c("abstain_count") >= F.greatest(F.lit(1), F.ceil(c("total") * F.lit(float(least_abstained)))))
    broken = F.greatest(F.lit(0.0), c("answer_risk") - most_risk) + F.greatest(F.lit(0.0), c("abstain_correct_rate") - most_abstain_correct)
    kept = (c("answer_risk") <= most_risk) & (c("abstain_correct_rate") <= most_abstain_correct)
    pairs = pairs.where(enough).withColumn("total_constraint_violation", broken).withColumn("constraints_satisfied", kept)
    order = F.struct(
        (~c("constraints_satisfied")).cast("int"), F.when(c("constraints_satisfied"), 0.0).otherwise(c("total_constraint_violation")), -c("answer_coverage"), -c("direct_decision_rate"),
        F.when(c("constraints_satisfied"), c("answer_risk")).otherwise(0.0), F.when(c("constraints_satisfied"), c("abstain_correct_rate")).otherwise(0.0), c("abstain_threshold"), c("answer_threshold"),
    )
    return pairs.agg(F.min_by(F.struct(*pairs.columns), order).alias("m")).where("m IS NOT NULL").select("m.*")


def alpha_grid(df: DataFrame, confidence: str = "confidence", other: str = "entailment", row_idx: str = "row_idx", correct: str = "correct", steps: int = 100, digits: int | None = None) -> DataFrame:
    """Area under the curve of confidence^alpha * other^(1 - alpha) for alpha = 0, 1/steps, ..., 1, of scores rounded to `digits` if given, so that rounding errors don't part ties. Every row stands once for each alpha; ranks are dealt by alpha and score."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")
    long = df.select(row_idx, correct, confidence, other, grid).withColumn("alpha", F.col("step") / F.lit(float(steps)))
    fused = F.least(weighted_geometric_mean(F.col(confidence), F.col(other), F.col("alpha")), F.lit(1.0))
    long = long.select(row_idx, correct, "alpha", (fused if digits is None else F.round(fused, digits)).alias("score"))
    return ranking.risk_coverage(long, ["alpha"], "score", row_idx, correct).groupBy("alpha").agg(F.avg("risk").alias("aurc"))


def best_alpha(grid: DataFrame) -> DataFrame:
    """The alpha of least area; the larger among equals."""
    return grid.agg(F.min_by("alpha", F.struct(F.col("aurc"), -F.col("alpha"))).alias("alpha"), F.min("aurc").alias("aurc"))


