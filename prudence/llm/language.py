"""Language identification with a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features, hashed into one weight table; neighbouring words share
learned transitions. Forward-backward gives each word's posterior, so that code-switched text is labelled word by
word; a document's language is the one with the most posterior mass over its words that have letters. Chains are
independent, so a text of any length is labelled a bounded run of chains at a time and its mass is added up.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.llm.features import Grams, Words, give_back, held_out, released, slices

TABLE = 1 << 17
#: Words of a chain. Longer texts are chains end to end, all of whose words count.
CHAIN = 32
#: Bytes of text that are labelled at a time; a byte takes about 100 bytes of memory. A longer text is cut between chains.
SLICE_BYTES = 1_000_000
#: Characters after which a run without white space is cut into several words.
LONGEST_WORD = 1000
#: Bounds of the training sample: documents of each language, of all, and chains of each, spread over its whole text.
LANGUAGE_DOCS, TRAIN_DOCS, TRAIN_CHAINS = 1000, 20_000, 2
#: Documents that a language gets at least, and with that the number of languages: of more, the commonest are learned.
LEAST_DOCS = 10
#: Chains of the training sample that are passed through at a time.
TRAIN_BLOCK = 2048
STEPS, RATE, L2 = 30, 0.15, 1e-4
LETTER_GRAMS = (2, 3, 4)
UNDETERMINED = "und"


def cut_words(text: str) -> str:
    """The text, with a space after every LONGEST_WORD characters that have none."""
    return re.sub(rf"(\S{{{LONGEST_WORD}}})(?=\S)", r"\1 ", text)


def runs_of_chains(text: str, most: int) -> Iterator[str]:
    """Cut a text into parts of about `most` characters, each but the last of whole chains."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and not text[end].isspace():
            end += 1
        part = text[at:end]
        words = part.split()
        over = len(words) % CHAIN
        if end < len(text) and 0 < over < len(words):
            part = part.rsplit(None, over)[0]
        yield part
        at += len(part)


def emissions(grams: Grams, table: np.ndarray, lexicon: dict[str, int]) -> tuple[np.ndarray, list]:
    """Score of each label for each word (0 for words without letters) and its (word, slot) features."""
    words = grams.shown
    parts = [grams.hashes(n) for n in LETTER_GRAMS]
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    which = np.flatnonzero(known >= 0)
    parts.append((which, known[which].astype(np.uint64) * np.uint64(1 << 40)))
    word = np.concatenate([p[0] for p in parts])
    slot = (np.concatenate([p[1] for p in parts]) >> np.uint64(40)).astype(np.int64) % TABLE
    keep = grams.lettered[word]
    word, slot = word[keep], slot[keep]
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(word, minlength=len(words))))
    out = np.stack([np.bincount(word, table[slot, k] * scale[word], minlength=len(words)) for k in range(table.shape[1])], 1) if len(words) else np.zeros((0, table.shape[1]))
    return out.astype(np.float32), [word, slot, scale]


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains (n, t, k) of emission scores: posterior of each label at each place, posterior sum of each transition, log partition of each chain."""
    n, t, k = e.shape
    top = e.max(2, keepdims=True)
    p = np.exp(e - top)
    a = np.exp(trans).astype(e.dtype)
    alpha, scale = np.empty_like(p), np.empty((n, t), e.dtype)
    now = p[:, 0] * np.exp(start).astype(e.dtype)
    for i in range(t):
        if i:
            now = (now @ a) * p[:, i]
        scale[:, i] = now.sum(1)
        now = now / scale[:, i, None]
        alpha[:, i] = now
    beta = np.ones((n, k), e.dtype)
    post, pairs = np.empty_like(p), np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        post[:, i] = alpha[:, i] * beta
        if i:
            later = p[:, i] * beta / scale[:, i, None]
            pairs += (alpha[:, i - 1].T @ later) * a
            beta = later @ a.T
    return post / post.sum(2, keepdims=True), pairs, np.log(scale).sum(1) + top[..., 0].sum(1)


class Model:
    """Languages, the table of weights, transitions and start scores, the lexicon, and hashes of all letter pairs of the sample in order."""

    def __init__(self, labels: list[str], table: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict[str, int], letter_pairs: np.ndarray):
        self.labels, self.table, self.trans, self.start, self.lexicon, self.letter_pairs = labels, table, trans, start, lexicon, letter_pairs

    def masses(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: posterior mass by language, number of words with letters, and how many of those the sample's letter pairs make up, each word by its share."""
        k, n = len(self.labels), len(part)
        w = Words(part)
        if any(len(x) > LONGEST_WORD for x in w.words):
            w = Words(pa.array([cut_words(x) for x in part.to_pylist()], pa.large_string()))
        mass, counted, fits = np.zeros((n, k)), np.zeros(n), np.zeros(n)
        if len(w.index):
            grams = Grams(w.words)
            scores, _ = emissions(grams, self.table, self.lexicon)
            of, pair = grams.hashes(2)
            near = np.minimum(np.searchsorted(self.letter_pairs, pair), len(self.letter_pairs) - 1)
            known = np.bincount(of, self.letter_pairs[near] == pair, minlength=len(w.words)) / np.maximum(1, np.bincount(of, minlength=len(w.words)))
            del of, pair, near
            sizes = np.diff(w.starts)
            chains = -(-sizes // CHAIN)
            # each text fills chains of its own; the rest of its last one is padded and not counted
            place = np.arange(len(w.index)) - np.repeat(w.starts[:-1], sizes) + np.repeat((np.cumsum(chains) - chains) * CHAIN, sizes)
            padded = np.zeros((int(chains.sum()) * CHAIN, k), np.float32)
            padded[place] = scores[w.index]
            counts = grams.lettered[w.index]
            post = forward_backward(padded.reshape(-1, CHAIN, k), self.trans, self.start)[0].reshape(-1, k)[place]
            for j in range(k):
                mass[:, j] = np.bincount(w.row, post[:, j] * counts, minlength=n)
            counted = np.bincount(w.row, counts, minlength=n)
            fits = np.bincount(w.row, known[w.index] * counts, minlength=n)
        return mass, counted, fits

    def documents(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, then what masses() gives) for slices of a column."""
        for at, part in slices(texts, SLICE_BYTES):
            if len(part) == 1 and len(part[0].as_buffer()) > SLICE_BYTES:
                parts = (self.masses(pa.array([x], pa.large_string())) for x in runs_of_chains(cut_words(part[0].as_py()), SLICE_BYTES))
                yield at, *map(sum, zip(*parts, strict=True))
            else:
                yield at, *self.masses(part)


def train(samples: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fit on (language, chain of words). Half as many chains again are spliced from two texts, so that switches are learned too."""
    labels = sorted({lang for lang, _ in samples})
    k = len(labels)
    at = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    chains = [(np.array(text.split(), object)[:CHAIN], np.full(min(CHAIN, len(text.split())), at[lang])) for lang, text in samples]
    chains = [c for c in chains if len(c[0])]
    order = rng.permutation(len(chains))
    for i, j in zip(order[::2], order[1::2], strict=False):
        cut = int(rng.integers(1, CHAIN))
        chains.append(tuple(np.concatenate([a[:cut], b[: CHAIN - cut]]) for a, b in zip(chains[i], chains[j], strict=True)))
    words = sorted({w for c in chains for w in c[0]})
    number = {w: i for i, w in enumerate(words)}
    index = np.fromiter((number[w] for c in chains for w in c[0]), np.int64)
    gold = np.concatenate([c[1] for c in chains]) if chains else np.zeros(0, np.int64)
    # lexicon: words that were seen three times or more, nine in ten of them in one language
    grams = Grams(words)
    seen = np.zeros((len(words), k))
    np.add.at(seen, (index, gold), 1)
    by_word: dict[str, np.ndarray] = {}
    for w, counts in zip(grams.shown, seen, strict=True):
        if w:
            by_word[w] = by_word.get(w, 0) + counts
    lexicon = {w: int(c.argmax()) for w, c in by_word.items() if c.sum() >= 3 and c.max() >= 0.9 * c.sum()}

    table, trans, start = np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k)
    _, (word, slot, scale) = emissions(grams, table, lexicon)
    used, local = np.unique(slot, return_inverse=True)
    theta = np.zeros((len(used), k))
    sizes = np.array([len(c[0]) for c in chains], np.int64)
    n = len(chains)
    del chains, number, by_word, seen
    place = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.arange(n) * CHAIN, sizes)
    gold_pairs = np.zeros((k, k))
    if len(gold) > 1:
        inner = place[1:] == place[:-1] + 1
        inner &= place[1:] % CHAIN != 0
        np.add.at(gold_pairs, (gold[:-1][inner], gold[1:][inner]), 1)
    first = np.bincount(gold[place % CHAIN == 0], minlength=k) if len(gold) else np.zeros(k)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, trans, start)]
    value = scale[word] if len(word) else np.zeros(0)
    for step in range(1, STEPS + 1):
        scores = np.stack([np.bincount(word, theta[local, j] * value, minlength=len(words)) for j in range(k)], 1) if len(words) else np.zeros((0, k))
        padded = np.zeros((n * CHAIN, k))
        padded[place] = scores[index]
        post, pairs = np.zeros((n * CHAIN, k)), np.zeros((k, k))
        for at_chain in range(0, n, TRAIN_BLOCK):
            block = slice(at_chain * CHAIN, (at_chain + TRAIN_BLOCK) * CHAIN)
            own, counts, _ = forward_backward(padded[block].reshape(-1, CHAIN, k), trans, start)
            post[block] = own.reshape(-1, k)
            pairs += counts
        miss = post[place]
        miss[np.arange(len(gold)), gold] -= 1
        by_word_grad = np.stack([np.bincount(index, miss[:, j], minlength=len(words)) for j in range(k)], 1) if len(words) else np.zeros((0, k))
        grad = np.stack([np.bincount(local, by_word_grad[word, j] * value, minlength=len(used)) for j in range(k)], 1) if len(used) else theta * 0
        total = max(1, len(gold))
        # padding after a short chain has no evidence; its expected transitions are those of the model, and left out in proportion
        share = max(1.0, gold_pairs.sum()) / max(1.0, pairs.sum())
        grads = (grad / total + L2 * theta, (pairs * share - gold_pairs) / total + L2 * trans, (post[::CHAIN].sum(0) - first) / total + L2 * start)
        for x, g, m in zip((theta, trans, start), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    table[used] = theta
    return Model(labels, table.astype(np.float32), trans, start, lexicon, np.unique(grams.hashes(2)[1]))


def training_chains(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (lang, chain) to learn from: at most TRAIN_CHAINS chains of words from each of LANGUAGE_DOCS documents a language that aren't held out, by hash of the id.

    Of many languages, each gets as many documents as leave TRAIN_DOCS in all, LEAST_DOCS at least, and of more than
    TRAIN_DOCS / LEAST_DOCS languages the commonest are taken. Rows of one id and language count once, with the
    largest text. Ids whose hash is beyond a limit, taken from the language's number of ids so that some more than
    enough lie below it, are left out before anything is sorted, so that a language of any size sends few rows.
    """
    open_rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    known = open_rows.groupBy("_lang").agg(F.approx_count_distinct("_id", 0.02).alias("_ids")).orderBy(F.desc("_ids"), "_lang").limit(TRAIN_DOCS // LEAST_DOCS).collect()
    most = min(LANGUAGE_DOCS, max(LEAST_DOCS, TRAIN_DOCS // max(1, len(known))))
    limits = docs.sparkSession.createDataFrame([(r["_lang"], (1.2 * most + 100) / max(1, r["_ids"])) for r in known], "_known string, _limit double")
    low = open_rows.withColumn("_hash", F.xxhash64("_id")).join(F.broadcast(limits), F.col("_lang") == F.col("_known")).where(F.col("_hash") / 2.0**64 + 0.5 <= F.col("_limit")).select("_id", "_lang", "_hash").distinct()
    first = W.partitionBy("_lang").orderBy("_hash", "_id")
    chosen = low.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("_id", "_lang")
    taken = docs.join(F.broadcast(chosen), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(lang_col) == F.col("_lang"))).groupBy("_id", "_lang").agg(F.max(F.col(text_col)).alias("text")).select(F.col("_id").cast("string").alias("id"), "text", F.col("_lang").alias("lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, chains = [], []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = cut_words(text or "").split()
                rng = np.random.default_rng(np.frombuffer((key or "").encode().ljust(8, b"\0"), np.uint8))
                for at in sorted({int(x) for x in rng.integers(0, max(1, len(words) - CHAIN + 1), TRAIN_CHAINS)}):
                    langs.append(lang)
                    chains.append(" ".join(words[at : at + CHAIN]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chains, pa.string())], ["lang", "chain"])

    return taken.mapInArrow(cut, "lang string, chain string").where("chain <> ''")


def predicted(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Language, score, mix and fit (share of the words that the sample's letter pairs make up) of each text of a column."""
    n = len(texts)
    pred, score, mix, fit = [UNDETERMINED] * n, np.zeros(n), ["{}"] * n, np.zeros(n)
    for at, mass, counted, fits in model.documents(texts) if model else ():
        for row in np.flatnonzero(counted > 0):
            share = mass[row] / counted[row]
            best = int(share.argmax())
            pred[at + row], score[at + row], fit[at + row] = model.labels[best], min(1.0, float(share[best])), fits[row] / counted[row]
            mix[at + row] = json.dumps({lang: round(float(s), 6) for lang, s in zip(model.labels, share, strict=True)})
    return pred, score, mix, fit


def trained(docs: DataFrame, id_col: str, text_col: str, lang_col: str):
    """A broadcast of the model as bytes, none if nothing can be learned from.

    The sample is bounded, so one task trains on all of it; the driver only passes the weights on.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(samples), 5)], pa.binary())], ["model"])

    rows = training_chains(docs, id_col, text_col, lang_col).repartition(1).mapInArrow(released(fit), "model binary").collect()
    model = docs.sparkSession.sparkContext.broadcast(bytes(rows[0]["model"]) if rows else None)
    del rows
    give_back()
    return model


def loaded(shared) -> Model | None:
    """The model of a broadcast of trained(), in a task."""
    return pickle.loads(shared.value) if shared.value else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text, learning from lang where crc32(id) mod 4 is not 2.

    Returns one row per input row: doc_id, held_out, lang_pred, score (share of the posterior mass), mix (JSON of each
    language's share). Null texts and texts without a letter are `und` with score 0, and so is every text if nothing
    can be learned from. Ties go to the first language by name. Repeated rows are labelled alike, an empty table gives
    an empty table, and further columns are ignored.
    """
    shared = trained(docs, id_col, text_col, lang_col)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared)
        for batch in batches:
            pred, score, mix, _ = predicted(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(mix, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "mix"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(labelled), f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double, mix string")


def keep_identified(docs: DataFrame, over_even: float = 1.2, least_fit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text is in a known language. Columns stay as they are.

    Left out are texts without a letter and null texts; texts whose best of k languages has less than over_even / k of
    the posterior mass, so that none stands out (of one language, none is left out for this); and texts of which less
    than least_fit is made up of letter pairs that the training sample has, such as those in another script. Nothing
    is left if nothing can be learned from. Repeated rows and rows with a null id are judged each by its text.
    """
    shared = trained(docs, id_col, text_col, lang_col)
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared)
        least = min(1.0, over_even / len(model.labels)) if model else 1.0
        for batch in batches:
            pred, score, _, fit = predicted(model, batch.column(place))
            yield batch.filter(pa.array([p != UNDETERMINED and s >= least - 1e-6 and f >= least_fit for p, s, f in zip(pred, score, fit, strict=True)], pa.bool_()))

    return docs.mapInArrow(released(kept), docs.schema)
