"""Mean ranks with a tolerance, and correlations of them.

Values tie with the first of their group: a group takes in what is close to its first value, its anchor, and the next
value begins another one. Distinct values are dealt by ranges and each range is walked on its own. A value that isn't
close to the one before it begins a group whatever came before, so nearly always a range knows its last anchor without
the ranges before it, and hands it to the next; a range without such a gap waits for the anchor handed to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.functions.values import ratio
from prudence.sources.stages import stored

#: Two values tie if they differ by no more than this share of the larger one, or this much.
RELATIVE, ABSOLUTE = 1e-9, 1e-15
#: Distinct values of a range.
RANGE_ROWS = 1_000_000


def close(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        near = np.abs(a - b) <= np.maximum(RELATIVE * np.maximum(np.abs(a), np.abs(b)), ABSOLUTE)
    return (a == b) | (near & np.isfinite(a) & np.isfinite(b))


def anchors(values: np.ndarray, handed: float | None = None) -> tuple[np.ndarray, bool]:
    """The anchor of each of the rising values, and whether the last one is the same whatever anchor is handed on."""
    out = values.copy()
    if not len(values):
        return out, False
    gaps = np.flatnonzero(~close(values[1:], values[:-1])) + 1
    begins, ends = np.concatenate([[0], gaps]), np.concatenate([gaps, [len(values)]])
    for run in np.flatnonzero(ends - begins > 1) if handed is None else {0: None} | dict.fromkeys(np.flatnonzero(ends - begins > 1).tolist()):
        s, e = int(begins[run]), int(ends[run])
        anchor = handed if run == 0 and handed is not None else values[s]
        while s < e:
            reach = int(np.searchsorted(values[s:e], anchor + 2 * max(RELATIVE * abs(anchor), ABSOLUTE), "right"))
            fits = close(values[s : s + reach], anchor)
            stop = s + (reach if fits.all() else int(np.argmin(fits)))
            out[s:stop] = anchor
            s, anchor = stop, values[stop] if stop < e else anchor
    return out, len(gaps) > 0


def _segments(k: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal column numbers."""
    cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("k", "ascending"), ("value", "ascending")])


ENDS = pa.schema([("range", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("free", pa.bool_()), ("anchor", pa.float64())])


def _handed(dealt: DataFrame) -> dict[int, float]:
    """The anchor that each range gets from those before it, of the same column. One row a range comes to the driver.

    Ranges without a gap that follow each other are a chain; each chain is streamed once, in order and without being held.
    """

    def looked(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        k, v = table.column("k").to_numpy(), table.column("value").to_numpy()
        s, e = _segments(k)[-1]
        out, free = anchors(v[s:e])
        return pa.table({"range": [table.column("range")[0].as_py()], "first": [int(k[0])], "last": [int(k[-1])], "free": [bool(free or s > 0)], "anchor": [float(out[-1])]}).cast(ENDS)

    out = "range int, first long, last long, free boolean, anchor double"
    rows = sorted(dealt.groupBy("range").applyInArrow(looked, out).collect(), key=lambda r: r["range"])
    anchor, chain = {r["range"]: r["anchor"] for r in rows}, {}
    for before, r in zip(rows, rows[1:], strict=False):
        if not r["free"] and before["last"] == r["first"]:
            chain[r["range"]] = chain.get(before["range"], before["range"])
    if chain:

        def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, at, found = None, None, {}
            for batch in batches:
                links, numbers, v = (batch.column(c).to_numpy() for c in ("chain", "range", "value"))
                for s, e in _segments(numbers):
                    if links[s] != at:
                        at, now = links[s], anchor[int(links[s])]
                    now = float(anchors(v[s:e], now)[0][-1])
                    found[int(numbers[s])] = now
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], ["range", "anchor"])

        links = F.broadcast(dealt.sparkSession.createDataFrame(list(chain.items()), "range int, chain int"))
        chained = dealt.join(links, "range").repartition("chain").sortWithinPartitions("chain", "value")
        anchor |= {r["range"]: r["anchor"] for r in chained.select("chain", "range", "value").mapInArrow(streamed, "range int, anchor double").collect()}
    return {r["range"]: anchor[before["range"]] for before, r in zip(rows, rows[1:], strict=False) if before["last"] == r["first"]}


def mean_ranks(counts: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """k, value, rank from rows of k, value, n (one for each k and value): the mean rank of each value's group.

    Nulls come first and tie, NaN comes last. Only distinct values are ordered.
    """
    some = counts.where("value IS NOT NULL")
    ranges = max(1, -(-some.count() // range_rows))
    dealt = some.select("k", F.col("value").cast("double").alias("value"), "n").repartitionByRange(ranges, "k", "value").withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    given = _handed(dealt) if ranges > 1 else {}

    def walked(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        k, v = table.column("k").to_numpy(), table.column("value").to_numpy()
        parts = [anchors(v[s:e], given.get(table.column("range")[0].as_py()) if s == 0 else None)[0] for s, e in _segments(k)]
        return table.append_column("anchor", pa.array(np.concatenate(parts)))

    anchored = stored(dealt.groupBy("range").applyInArrow(walked, "k long, value double, n long, range int, anchor double"), "anchors")
    groups = anchored.groupBy("k", "anchor").agg(F.sum("n").alias("n"), F.min("range").alias("range"))
    nulls = counts.where("value IS NULL").select("k", F.lit(-1).alias("range"), "n")
    sums = groups.groupBy("k", "range").agg(F.sum("n").alias("n")).unionByName(nulls)
    sums = sums.select("k", "range", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))
    inside = W.partitionBy("k", "range").orderBy("anchor").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(sums), ["k", "range"])
    groups = groups.select("k", "anchor", (F.col("_n0") + F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))
    ranks = anchored.select("k", "value", "anchor").join(groups, ["k", "anchor"]).select("k", "value", "rank")
    return ranks.unionByName(nulls.select("k", F.lit(None).cast("double").alias("value"), ((F.col("n") + 1) / 2).alias("rank")))


def average_rank(df: DataFrame, value: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the rank of a value, the mean rank among ties within the tolerance. Nulls rank first, NaN last."""
    counts = stored(df.groupBy(F.lit(0).cast("long").alias("k"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")), "counts")
    ranks = stored(mean_ranks(counts, range_rows).select(F.col("value").alias("_v"), F.col("rank").alias(out)), "ranks")
    return df.join(ranks, F.col(value).cast("double").eqNullSafe(F.col("_v"))).drop("_v")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """x, y, n, pearson and spearman of pairs of columns over rows that have both; null for under two rows or without variation.

    The table is read once: what follows works on counts of its distinct points, of all pairs at a time.
    """
    each = F.array(*(F.struct(F.lit(i).cast("long").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for i, (x, y) in enumerate(pairs)))
    points = df.select(F.inline(each)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("k", "x", "y").agg(F.count("*").alias("n"))
    points = stored(points, "points")
    sides = points.select("n", F.inline(F.array(F.struct((F.col("k") * 2).alias("k"), F.col("x").alias("value")), F.struct((F.col("k") * 2 + 1).alias("k"), F.col("y").alias("value")))))
    ranks = stored(mean_ranks(stored(sides.groupBy("k", "value").agg(F.sum("n").alias("n")), "sides"), range_rows), "ranks")
    means = points.groupBy("k").agg(F.sum("n").alias("_all"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("_mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("_my"))
    for side, name in ((0, "rx"), (1, "ry")):
        own = ranks.where(F.col("k") % 2 == side).select((F.col("k") / 2).cast("long").alias("_k"), F.col("value").alias("_v"), F.col("rank").alias(name))
        points = points.join(own, (F.col("k") == F.col("_k")) & (F.col("x" if side == 0 else "y") == F.col("_v"))).drop("_k", "_v")
    points = points.join(F.broadcast(means), "k")
    middle = (F.col("_all") + 1) / 2
    d = {"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my"), "rx": F.col("rx") - middle, "ry": F.col("ry") - middle}
    total = lambda a, b: F.sum(F.col("n") * d[a] * d[b]).alias(f"{a}_{b}")
    one = points.groupBy("k").agg(F.sum("n").alias("n"), *(total(a, b) for a, b in (("x", "x"), ("y", "y"), ("x", "y"), ("rx", "rx"), ("ry", "ry"), ("rx", "ry"))))

    def of(a: str, b: str):
        spread = F.sqrt(F.col(f"{a}_{a}") * F.col(f"{b}_{b}"))
        return F.when((F.col("n") > 1) & (spread > ABSOLUTE), ratio(F.col(f"{a}_{b}"), spread))

    names = df.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "k long, x string, y string")
    one = one.select("k", "n", of("x", "y").alias("pearson"), of("rx", "ry").alias("spearman"))
    return names.join(F.broadcast(one), "k", "left").select("x", "y", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "pearson", "spearman")
