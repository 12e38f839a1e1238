"""Splits, random abstention and the paired bootstrap.

Orders come from md5 of seed and id, so they don't depend on partitions and other engines can repeat them. `exact`
functions repeat Python's own generator on the driver for tables that fit there.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.functions.values import ratio
from prudence.operators.ranking import methods as long_methods
from prudence.operators.ranking import ranked as ranked_rows
from prudence.sources.stages import stored

#: Hex digits by which a hash order is dealt into parts.
DIGITS = 4


def digest(seed: Column | int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed.cast("string"), F.col(key).cast("string")))


def hash_rank(df: DataFrame, by: Sequence[str], order: str, out: str = "place") -> DataFrame:
    """Add the place (from 1) of each row by a hex digest, ties not expected. Digests are dealt by their first digits; sums of the parts give the offsets."""
    df = df.withColumn("_q", F.substring(order, 1, DIGITS))
    sums = df.groupBy(*by, "_q").agg(F.count("*").alias("_n"))
    sums = sums.select(*by, "_q", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))
    df = df.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_q").orderBy(order)))
    return df.join(sums, [*by, "_q"]).withColumn(out, F.col("_r") + F.col("_n0")).drop("_q", "_r", "_n0")


def stratified_split(df: DataFrame, fraction: float = 0.5, seed: int = 17, key: str = "row_idx", label: str = "label", names: tuple[str, str] = ("calibration", "test")) -> DataFrame:
    """Add split: of each label the first floor(n * fraction) rows by digest are names[0]."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    out = hash_rank(df.withColumn("_h", digest(seed, key)), [label], "_h").join(F.broadcast(sizes), label)
    return out.withColumn("split", F.when(F.col("place") <= F.floor(F.col("_size") * F.lit(float(fraction))), names[0]).otherwise(names[1])).drop("_h", "place", "_size")


def random_abstention(df: DataFrame, coverages: Sequence[float], seeds: Sequence[int], key: str = "row_idx", correct: str = "correct") -> DataFrame:
    """Answer a random round(n * coverage) rows (half to even) for each coverage and seed: answered, accuracy, risk, coverage.

    One order a seed serves all coverages: counts between their bounds are summed from the start. Zero answers raise.
    """
    if not all(0 < c <= 1 for c in coverages) or not all(s >= 0 for s in seeds):
        raise ValueError("coverages must lie in (0, 1] and seeds must not be negative")
    n = df.count()
    bounds = sorted({(float(c), round(n * c)) for c in coverages})
    if n == 0 or bounds[0][1] == 0:
        raise ValueError("a coverage answers no row")
    long = df.select(key, correct, F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    placed = hash_rank(long.withColumn("_h", digest(F.col("seed"), key)), ["seed"], "_h")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("target_coverage"), F.lit(k).cast("long").alias("answered")) for c, k in bounds)))
    step = F.size(F.filter(F.array(*(F.lit(k) for _, k in bounds)), lambda k: k < F.col("place")))
    counts = placed.groupBy("seed", step.alias("_s")).agg(F.count_if(F.col(correct)).alias("_c"))
    every = counts.select("seed").distinct().select("seed", cells.alias("x")).select("seed", "x.*")
    at = F.size(F.filter(F.array(*(F.lit(k) for _, k in bounds)), lambda k: k < F.col("answered")))
    out = every.withColumn("_s", at).alias("e").join(counts.alias("c"), (F.col("e.seed") == F.col("c.seed")) & (F.col("c._s") <= F.col("e._s"))).groupBy("e.seed", "target_coverage", "answered").agg(F.sum("_c").alias("answered_correct"))
    a, k = F.col("answered"), F.col("answered_correct")
    return out.select("seed", "target_coverage", a, k, (a / F.lit(n)).alias("actual_coverage"), (k / a).alias("answer_accuracy"), (1 - k / a).alias("selective_risk"), (1 - a / F.lit(n)).alias("abstain_rate"))


def exact_shuffle(ids: Sequence, seed: int) -> list:
    """Python's own shuffle, for orders that must equal those of a script with this seed."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def exact_sample(n: int, k: int, seed: int) -> list[int]:
    return random.Random(seed).sample(range(n), k)


#: A prime, the factors that mix seed, replicate and row, and how often a row is drawn by the place of its number below the prime: the shares of a Poisson law of mean 1.
PRIME, ROW, REPLICATE, SEED = 2**31 - 1, 48_271, 69_621, 16_807
DRAWN = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Rows of a cell of an order, and replicates that are looked at together.
CELL_ROWS, BLOCK = 4096, 500


def draws(rows: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """How often each row stands in each replicate: the fifth power below PRIME of a number from row and replicate alone, read by DRAWN."""

    def folded(x: np.ndarray) -> np.ndarray:
        """x modulo PRIME, which is all ones."""
        for _ in range(2):
            x = (x & PRIME) + (x >> 31)
        x[x == PRIME] = 0
        return x

    out = np.empty((len(rows), len(replicates)), np.int8)
    first, again = rows % PRIME * ROW, (replicates * REPLICATE + seed * SEED + 1)[None, :]
    for at in range(0, len(rows), 64):  # what fits the processor's cache
        x = folded(first[at : at + 64, None] + again)
        power = folded(x * x)
        power = folded(folded(power * power) * x)
        times = out[at : at + 64]
        np.greater_equal(power, DRAWN[0], out=times, casting="unsafe")
        many = np.nonzero(power >= DRAWN[1])
        times[many] = np.searchsorted(DRAWN, power[many], "right")
    return out


def paired_bootstrap(df: DataFrame, scores: dict[str, Column], replicates: int = 5000, seed: int = 17, row_idx: str = "row_idx", correct: str = "correct", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Area under the curve of each method over resamples that all methods share: replicate, method, rows, aurc.

    Every row is drawn a number of times that seed, replicate and row alone decide, so no draw is stored or sent, and
    methods meet the same resample. The number is Poisson with mean 1, the limit of n draws of n rows with replacement;
    a replicate's size varies with it. Orders are dealt into cells by rank. The cells' sums come first, their running
    sums give each cell what stands before it, and the cells' shares of the area are added up. A replicate without rows
    has no area. An empty table raises.
    """
    if replicates < 1 or seed < 0:
        raise ValueError("there must be replicates, and the seed must not be negative")
    if df.isEmpty():
        raise ValueError("there are no rows")
    ranked = ranked_rows(long_methods(df, scores, (row_idx, correct)), row_idx=row_idx, correct=correct)
    cell = F.floor((F.col("answered") - 1) / cell_rows).alias("cell")
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))).alias("block")
    rows = stored(ranked.select("method", cell, F.col("answered").alias("place"), F.col(row_idx).cast("long").alias("row"), (~F.col(correct)).cast("long").alias("wrong")), "orders")
    rows = rows.select("*", blocks)

    def looked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by("place")
        own = np.arange(table.column("block")[0].as_py() * BLOCK, min((table.column("block")[0].as_py() + 1) * BLOCK, replicates))
        times = draws(table.column("row").to_numpy(), own, seed)
        return own, times, times * table.column("wrong").to_numpy().astype(np.int8)[:, None]

    def summed(table: pa.Table) -> pa.Table:
        own, times, wrong = looked(table)
        first = [[table.column(c)[0].as_py()] * len(own) for c in ("method", "cell", "block")]
        return pa.table([*first, own, times.sum(0, np.int64), wrong.sum(0, np.int64)], ["method", "cell", "block", "replicate", "n", "w"]).cast(pa.schema([("method", pa.string()), *((c, pa.int64()) for c in ("cell", "block", "replicate", "n", "w"))]))

    rows = rows.withColumn("block", F.col("block").cast("long")).withColumn("cell", F.col("cell").cast("long"))
    sums = rows.groupBy("method", "cell", "block").applyInArrow(summed, "method string, cell long, block long, replicate long, n long, w long")
    before = W.partitionBy("method", "replicate").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("method", "cell", "block", "replicate", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))

    def shared(table: pa.Table, offsets: pa.Table) -> pa.Table:
        own, times, wrong = looked(table)
        offsets = offsets.sort_by("replicate")
        n0, w0 = offsets.column("n0").to_numpy(), offsets.column("w0").to_numpy()
        n1, w1 = np.cumsum(times, 0, np.int64) + n0, np.cumsum(wrong, 0, np.int64) + w0
        area = np.where(times > 0, w1 / np.maximum(n1, 1), 0.0).sum(0)
        for k in range(1, int(times.max(initial=0))):  # the k-th last copy of each row
            some = np.nonzero(times > k)
            area += np.bincount(some[1], (w1[some] - k * (wrong[some] > 0)) / (n1[some] - k), len(own))
        return pa.table([[table.column("method")[0].as_py()] * len(own), own, times.sum(0, np.int64), area], ["method", "replicate", "n", "area"]).cast(pa.schema([("method", pa.string()), ("replicate", pa.int64()), ("n", pa.int64()), ("area", pa.float64())]))

    key = ["method", "cell", "block"]
    parts = rows.groupBy(*key).cogroup(sums.groupBy(*key)).applyInArrow(shared, "method string, replicate long, n long, area double")
    return parts.groupBy("replicate", "method").agg(F.sum("n").alias("rows"), ratio(F.sum("area"), F.sum("n")).alias("aurc"))


def bootstrap_summary(draws: DataFrame, reference: str, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of each method's area and of its difference from the reference, and how often it is lower."""
    base = draws.where(F.col("method") == reference).select("replicate", F.col("aurc").alias("_base"))
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    both = draws.join(base, "replicate").withColumn("_d", F.col("aurc") - F.col("_base"))
    one = both.groupBy("method").agg(F.count("*").alias("replicates"), F.avg("aurc").alias("mean_aurc"), F.percentile("aurc", tails).alias("_q"), F.avg("_d").alias("mean_difference"), F.percentile("_d", tails).alias("_e"), F.count_if(F.col("_d") < 0).alias("_b"))
    return one.select("method", "replicates", "mean_aurc", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "mean_difference", F.col("_e")[0].alias("difference_low"), F.col("_e")[1].alias("difference_high"), ratio(F.col("_b"), F.col("replicates")).alias("share_better"))
