"""Toxicity: cumulative-link ordinal regression over sparse text features.

A text's features are which of the selected words and word beginnings occur in it. One weight vector serves all grades;
only the ordered thresholds between grades differ. The labels know toxic or not; the grades of toxic training texts
(mild, plain, severe) are thirds by how many different selected features occur in them, so severity follows how much
of a text is toxic. Expected severity is the sum of the probabilities of passing each threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudence.llm.features import Grams, Words, held_out, slices

#: Bound of the training sample: labelled documents of each class, by hash of the id.
TRAIN_TOXIC, TRAIN_CLEAN = 6000, 12_000
#: Features that the model may use: the top of those that stand out by the G statistic.
SELECTED, LEAST_G, LEAST_DOCS = 4096, 12.0, 3
#: Least odds of a toxic text among those with a feature, over the odds among all: weaker ones mark a language or a topic.
LEAST_ODDS = 10
PREFIXES = (3, 4, 5, 6, 7)
GRADES = 4
L2, STEPS = 2e-4, 400


def feature_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash as signed 64-bit) of each word and its beginnings."""
    grams = Grams(words)
    parts = [grams.prefixes(n) for n in PREFIXES]
    some = np.flatnonzero(grams.size > 2)
    parts.append((some, grams.whole()[some]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.int64)


def pairs(part: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a slice of texts: features are hashes, or places in `known`, a sorted array of those that count."""
    w = Words(part)
    word, h = feature_hashes(w.words)
    if known is not None:
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        word, h = word[hit], at[hit]
    by_word = np.argsort(word, kind="stable")
    word, h = word[by_word], h[by_word]
    count = np.bincount(word, minlength=len(w.words))
    first = np.cumsum(count) - count
    use = np.flatnonzero(count[w.index] > 0) if len(w.index) else np.zeros(0, np.int64)
    seen = np.unique(w.row[use] * np.int64(len(w.words)) + w.index[use])
    row, index = seen // max(1, len(w.words)), seen % max(1, len(w.words))
    sizes = count[index]
    at = np.repeat(first[index], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    both = np.unique(np.stack([np.repeat(row, sizes), h[at].astype(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


class Model:
    def __init__(self, known: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.known, self.weights, self.cuts = known, weights, cuts

    def passing(self, score: np.ndarray) -> np.ndarray:
        """Probability that the grade lies above each threshold, (n, GRADES - 1)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, part in slices(texts):
            row, feature = pairs(part, self.known)
            out.append(np.bincount(row, self.weights[feature] if len(feature) else None, minlength=len(part)).astype(float))
        return np.concatenate(out)


def fit(rows: list[np.ndarray], grade: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model, by gradient steps with momentum on the penalised likelihood.

    The distances between thresholds are exponentials, which keeps them in order.
    """
    n = max(1, len(rows))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    balance = np.where(grade == 0, 0.5 / max(1, (grade == 0).sum()), 0.5 / max(1, (grade > 0).sum())) * n
    w, low, gaps = np.zeros(size), 1.0, np.zeros(GRADES - 2)
    m = [np.zeros(size + GRADES - 1) for _ in range(2)]
    for step in range(1, STEPS + 1):
        cuts = low + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row, w[feature], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = (1 / (1 + np.exp(np.clip(s - edges[grade + k], -40, 40))) for k in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * balance, lower * (1 - lower) / p * balance
        ds = (du - dl) / n  # of the loss by the score
        dcut = np.zeros(GRADES + 1)
        np.add.at(dcut, grade + 1, -du / n)
        np.add.at(dcut, grade, dl / n)
        dcut = dcut[1:-1]
        dgaps = np.array([dcut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)]) + 1e-3 * gaps
        g = np.concatenate([np.bincount(feature, ds[row], minlength=size) + L2 * w, [dcut.sum()], dgaps])
        m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
        move = 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        w, low, gaps = w - move[:size], low - move[size], gaps - move[size + 1 :]
    return w, low + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text and y of a bounded sample of the labelled documents."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("y = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(known.where("y = 0").orderBy(*order).limit(TRAIN_CLEAN))
    return docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Select features and fit, or None if one of the classes has no text."""
    sample = training_rows(docs, labels, id_col, text_col).persist()
    try:
        sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        if not sizes.get(1) or not sizes.get(0):
            return None

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column(1).to_numpy()
                for at, part in slices(batch.column(0)):
                    row, h = pairs(part)
                    keys, place = np.unique(h, return_inverse=True)
                    toxic = np.bincount(place, y[at + row], minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(toxic), pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64))], ["h", "a", "n"])

        counts = sample.mapInArrow(counted, "h bigint, a bigint, n bigint").groupBy("h").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
        rate = sizes[1] / (sizes[0] + sizes[1])
        a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
        g = 2 * (F.when(a > 0, a * F.log(a / (F.col("n") * rate))).otherwise(0) + F.when(b > 0, b * F.log(b / (F.col("n") * (1 - rate)))).otherwise(0))
        best = counts.where(f"n >= {LEAST_DOCS}").withColumn("g", g).where((F.col("g") >= LEAST_G) & ((a + 0.5) * (1 - rate) >= LEAST_ODDS * (b + 0.5) * rate)).orderBy(F.desc("g"), "h").limit(SELECTED)
        known = np.sort(np.array([r["h"] for r in best.select("h").collect()], np.int64))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[list[int]] = [[] for _ in range(batch.num_rows)]
                for at, part in slices(batch.column(0)):
                    for r, f in zip(*pairs(part, known), strict=True):
                        found[at + r].append(int(f))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "features"])

        rows = sorted((r["y"], sorted(r["features"])) for r in sample.mapInArrow(listed, "y int, features array<int>").collect())
    finally:
        sample.unpersist()
    y = np.array([r[0] for r in rows])
    amount = np.array([len(r[1]) for r in rows])
    bounds = np.quantile(amount[y == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(y == 1, 1 + np.searchsorted(bounds, amount, side="left"), 0)
    return Model(known, *fit([np.array(r[1], np.int64) for r in rows], grade, len(known)))


def grade_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Expected severity of every whole text.

    Returns one row per input row: doc_id, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic
    (probability of a grade over 0), toxic (1 if that is at least threshold). Null and empty texts have no features and
    score as such. Of a document with several labels the highest counts. Without labels of both classes all is 0.
    Repeated rows are graded alike, an empty table gives an empty table, and further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.value
            over = m.passing(m.scores(batch.column(1))) if m else np.zeros((batch.num_rows, GRADES - 1))
            each = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(over.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(over[:, 0].copy()), pa.array((over[:, 0] >= threshold).astype(np.int32))],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(graded, f"doc_id {dict(docs.dtypes)[id_col]}, severity double, grade int, p_toxic double, toxic int")
