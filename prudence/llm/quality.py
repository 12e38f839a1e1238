"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition of the training sample sums its normal equations, so only
matrices of a fixed size travel; the ridge score is made a probability by isotonic regression on a held-back fifth of
the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudence.llm.features import Words, held_out, mixed, slices

#: Bound of the training sample: labelled rows, by hash of the id.
TRAIN_ROWS = 20_000
FOURIER, GAMMA, RIDGE, SEED = 384, 0.04, 1e-2, 11
#: Partitions of the sample; each sends one matrix to the driver.
SUMS = 8
THRESHOLD = 0.7
BYTES = np.arange(256)
UPPER, LOWER, DIGIT = (BYTES >= 65) & (BYTES <= 90), (BYTES >= 97) & (BYTES <= 122), (BYTES >= 48) & (BYTES <= 57)
SPACE, WIDE = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13)), BYTES >= 128
PROSE = np.isin(BYTES, list(b".,;:'-?()\""))
SYMBOL = ~(UPPER | LOWER | DIGIT | SPACE | WIDE | PROSE)
NAMES = 22


def statistics(part: pa.Array) -> np.ndarray:
    """NAMES statistics of each text: of its characters, words, lines and repetitions."""
    n = len(part)
    counts = np.zeros((n, 256))
    lines, repeated_lines, doubled = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, x in enumerate(part):
        raw = x.as_buffer().to_pybytes()
        if raw:
            codes = np.frombuffer(raw, np.uint8)
            counts[i] = np.bincount(codes, minlength=256)
            kind = SYMBOL[codes]
            doubled[i] = (kind[1:] & kind[:-1]).sum()
            own = raw.split(b"\n")
            lines[i], repeated_lines[i] = len(own), 1 - len(set(own)) / len(own)
    size = np.maximum(1, counts.sum(1))
    letters = np.maximum(1, counts[:, UPPER | LOWER].sum(1))

    w = Words(part)
    count = np.diff(w.starts).astype(float)
    some = np.maximum(1, count)
    length = np.array([len(x) for x in w.words], float)
    shouted = np.array([len(x) > 1 and x.isupper() for x in w.words], float)
    plain = np.array([x.strip(".,;:'-?()\"").isalpha() for x in w.words], float)
    ends = np.array([x[-1:] in ".?!" for x in w.words], float)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.row, values, minlength=n)

    def distinct(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Number of different keys of each row."""
        h = mixed(keys.astype(np.uint64)) ^ (row.astype(np.uint64) << np.uint64(40))
        order = np.argsort(h, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = h[order][1:] != h[order][:-1]
        return np.bincount(row[order][first], minlength=n)

    unique = distinct(w.index, w.row)
    same = np.zeros(n)
    triples = np.zeros(n)
    if len(w.index) > 2:
        neighbours = (w.index[1:] == w.index[:-1]) & (w.row[1:] == w.row[:-1])
        same = np.bincount(w.row[1:][neighbours], minlength=n)
        inner = w.row[2:] == w.row[:-2]
        key = (w.index[:-2].astype(np.uint64) * np.uint64(1_000_003) + w.index[1:-1].astype(np.uint64)) * np.uint64(1_000_003) + w.index[2:].astype(np.uint64)
        triples = distinct(key[inner], w.row[2:][inner])
    mean = per_row(length[w.index]) / some
    spread = np.sqrt(np.maximum(0, per_row(length[w.index] ** 2) / some - mean**2))
    return np.stack(
        [
            np.log1p(size * (counts.sum(1) > 0)), np.log1p(count), mean, spread,
            counts[:, UPPER].sum(1) / letters, counts[:, DIGIT].sum(1) / size, counts[:, SYMBOL].sum(1) / size, counts[:, WIDE].sum(1) / size,
            counts[:, PROSE].sum(1) / size, counts[:, SPACE].sum(1) / size, doubled / some, counts[:, ord("|")] / some,
            unique / some, np.log1p(unique) / np.log1p(some), same / some, triples / np.maximum(1, count - 2), np.sqrt(1 - triples / np.maximum(1, np.maximum(triples, count - 2))),
            per_row(shouted[w.index]) / some, per_row(plain[w.index]) / some, per_row(ends[w.index]) / some,
            repeated_lines, np.log1p(some / np.maximum(1, lines)),
        ],
        1,
    )


def all_statistics(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, NAMES)), *(statistics(part) for _, part in slices(texts))])


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, steps: tuple[np.ndarray, np.ndarray]):
        self.mean, self.spread, self.weights, self.steps = mean, spread, weights, steps

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.spread) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score; a thousandth of it follows the ridge score, so that flat steps keep an order."""
        raw = self.raw(stats)
        return np.clip(0.999 * np.interp(raw, *self.steps) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel exp(-GAMMA |x-y|^2), with a constant and the statistics themselves."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, np.sqrt(2 * GAMMA), (x.shape[1], FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER)
    x = np.clip(x, -8, 8)
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(2 / FOURIER) * np.cos(x @ w + b)], 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the steps of the isotonic regression of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of x, rows
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, a, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, y and part (0 to SUMS - 1) of at most TRAIN_ROWS labelled documents that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select(F.col("doc_id").alias("_id"), "y")
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "y", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SUMS)).alias("part"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on the sample, or None if it has no rows."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = all_statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(list(stats), pa.list_(pa.float64()))], ["part", "y", "stats"])

    sample = training_rows(docs, labels, id_col, text_col).mapInArrow(described, "part bigint, y int, stats array<double>").repartition(SUMS, "part").persist()
    try:
        moments = sample.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
        if not moments:
            return None
        mean, spread = np.array([r["m"] for r in moments]), np.array([r["s"] if r["s"] and r["s"] > 1e-9 else 1.0 for r in moments])

        def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    x = fourier((np.array(batch.column(2).to_pylist()) - mean) / spread)
                    z = np.concatenate([x, batch.column(1).to_numpy().astype(float)[:, None]], 1)
                    total = total + x.T @ z
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        sums = sample.where(F.col("part") > 0).mapInArrow(equations, "sums binary").collect()
        width = 1 + NAMES + FOURIER
        total = sum((np.frombuffer(r["sums"]).reshape(width, width + 1) for r in sums), np.zeros((width, width + 1)))
        penalty = np.full(width, RIDGE * max(1.0, total[0, 0]) / 100)
        penalty[0] = 1e-9 + 1e-6 * (total[0, 0] == 0)
        weights = np.linalg.solve(total[:, :width] + np.diag(penalty), total[:, width])
        model = Model(mean, spread, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
        held = sample.where("part = 0").select("y", "stats").collect()
        if held:
            x, y = model.raw(np.array([r["stats"] for r in held])), np.array([r["y"] for r in held], float)
            model.steps = isotonic(x, y)
        return model
    finally:
        sample.unpersist()


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text, learning from labels.quality where crc32(id) mod 4 is not 2.

    Returns one row per input row: doc_id, held_out, score (higher: label 1 likelier), predicted (1 if score >=
    threshold). Null texts count as empty and are scored like any other. Of a document with several labels the lowest
    counts. Without any label to learn from every score is 0.5. Repeated rows are scored alike, an empty table gives an
    empty table, and further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = all_statistics(batch.column(2))
            score = model.value.score(stats) if model.value else np.full(len(stats), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")
