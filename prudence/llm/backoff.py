"""Katz backoff over bigrams: Good-Turing discounts, exactly normalised weights, tables dealt by history.

1. Texts are cut into chunks of whole documents, each with the different words it holds. Only those words travel to
   the vocabulary, which is dealt by word, and bring back an exact number and a training count.
2. Every token travels once, with the word before it, to the part of the bigram table that its history belongs to. A
   history that would fill a large piece of a part is dealt further by the word that follows.
3. Each part counts its bigrams and sums, for every document, what doesn't hang on the discounts; the discounts follow
   from the counts of counts of all parts, and with them the parts' backoff weights and the scores.

A history's total is the training count of its word, so a part needs no other part to know it; the masses that backoff
weights need are sums over a part's bigrams, and those of dealt histories are added up over their parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudence.llm.blobs import joined, packed, parted, unpacked
from prudence.llm.crc_sql import crc32_tables
from prudence.llm.features import give_back, mixed, released, slices
from prudence.llm.scratch import bucketed, stored

#: Counts up to this are discounted.
KATZ = 5
#: Bytes of text in a chunk, different words of a part of the vocabulary, and tokens of a part of the bigram table.
CHUNK_BYTES, PART_WORDS, PART_TOKENS = 24_000_000, 1_000_000, 3_000_000
#: Parts at least, so that small inputs are spread as well.
LEAST_PARTS = 24
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 1 to KATZ, from how many types have each count of 1 to KATZ + 1.

    Where Katz's formula leaves (0, 1), as it does where a count is rare or missing, the discount of that count is the
    one that takes an absolute n1 / (n1 + 2 n2), or a half, off the count.
    """
    n = [0, *map(float, counts_of_counts)]
    most = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = []
    for r in range(1, KATZ + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - most) / (1 - most) if n[r] and most != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - off) / r)
    return np.array(out)


class Unigrams:
    """The lowest order: discounted counts, and for one further type, the unknown word, what they leave."""

    def __init__(self, total: int, types: int, counts_of_counts: list[int]):
        self.total, self.types = total, types
        d = discounts(counts_of_counts)
        self.keep = np.concatenate([[0.0], d])
        left = sum(n * r * (1 - d[r - 1]) for r, n in enumerate(counts_of_counts[:KATZ], 1))
        self.whole = total if left or not total else total + 1
        self.unknown = (left or 1.0) / self.whole if total else 1.0

    def probability(self, count: np.ndarray) -> np.ndarray:
        known = count * np.where(count <= KATZ, self.keep[np.minimum(count, KATZ)], 1.0) / max(self.whole, 1)
        return np.where(count > 0, known, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.types + 1))


def held_out(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 when divided by 7; false for a null id."""
    return np.array([x is not None and zlib.crc32(x.encode()) % 7 == 2 for x in ids.cast(pa.string()).to_pylist()], bool)


def places(words: list[str], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its documents, their tokens as numbers of its words, and each word's training count. Word 0, the empty one, is the end."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in slices(batch.column(1), CHUNK_BYTES):
                ids = batch.column(0).slice(at, len(texts))
                split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
                starts = split.offsets.to_numpy().astype(np.int64)
                coded = split.flatten().dictionary_encode()
                words = ["", *coded.dictionary.to_pylist()]
                index = coded.indices.to_numpy().astype(np.int64) + 1
                row = np.repeat(np.arange(len(ids)), np.diff(starts))
                if "" in words[1:]:  # leading and trailing white space
                    empty = words.index("", 1)
                    index, row = index[index != empty], row[index != empty]
                    index -= index > empty
                    words.pop(empty)
                size = np.bincount(row, minlength=len(ids)) + 1
                tokens = np.zeros(size.sum(), np.int64)
                end = np.zeros(len(tokens), bool)
                end[np.cumsum(size) - 1] = True
                tokens[~end] = index
                held = held_out(ids)
                train = np.bincount(tokens[np.repeat(~held, size)], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([int((~held).sum())], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)),
                        *(pa.array([x], pa.binary()) for x in (packed(held), packed(size), packed(tokens), joined(words), packed(train))),
                    ],
                    ["chunk", "n_tokens", "n_words", "n_train_docs", "doc_ids", "held", "sizes", "tokens", "words", "train"],
                )
                number += 1

    schema = f"chunk bigint, n_tokens bigint, n_words bigint, n_train_docs bigint, doc_ids array<{kind}>, held binary, sizes binary, tokens binary, words binary, train binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def vocabulary(cut: DataFrame, parts: int) -> DataFrame:
    """Numbers and training counts of each chunk's words, and of each part its counts of counts (a row without chunk).

    Words are dealt by crc32; a part numbers its words part, part + parts, ..., so that numbers are unique and exact.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, train in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "train")), strict=True):
                words, train = np.array(parted(words), object), unpacked(train)
                place = places(words, parts)
                for q in np.unique(place):
                    own = place == q
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([chunk], pa.int64()), pa.array([joined(list(words[own]))], pa.binary()), pa.array([packed(train[own])], pa.binary())], ["part", "chunk", "words", "train"])

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        given = [pa.array(parted(w)) for w in table.column("words").to_pylist()]
        coded = pa.chunked_array(given).combine_chunks().dictionary_encode()
        index, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        total = np.bincount(index, np.concatenate([unpacked(t) for t in table.column("train").to_pylist()]), n).astype(np.int64)
        cuts = np.cumsum([len(g) for g in given])[:-1]
        own = np.split(index, cuts)
        of = np.bincount(np.minimum(total, KATZ + 2), minlength=KATZ + 3)[1:]
        rows = len(given)
        out = pa.table(
            {
                "part": pa.array([part] * (rows + 1), pa.int64()), "chunk": pa.concat_arrays([table.column("chunk").combine_chunks(), pa.nulls(1, pa.int64())]),
                "ids": pa.array([*(packed(k) for k in own), None], pa.binary()), "counts": pa.array([*(packed(total[k]) for k in own), None], pa.binary()),
                "types": pa.array([None] * rows + [int((total > 0).sum())], pa.int64()), "total": pa.array([None] * rows + [int(total.sum())], pa.int64()), "of": pa.array([None] * rows + [of[: KATZ + 1].tolist()], pa.list_(pa.int64())),
            }
        )
        give_back()
        return out

    dealt = cut.select("chunk", "words", "train").mapInArrow(released(deal), "part bigint, chunk bigint, words binary, train binary")
    return dealt.groupBy("part").applyInArrow(count, "part bigint, chunk bigint, ids binary, counts binary, types bigint, total bigint, of array<bigint>")


def summed(df: DataFrame, column: str) -> list[int]:
    """Sums over rows of an array of KATZ + 1 numbers."""
    return [int(x or 0) for x in df.agg(*(F.sum(F.get(column, F.lit(i))) for i in range(KATZ + 1))).first()]


FIELDS = ("v_ids", "v_totals", "v_dealt", "v", "w_ids", "w_counts", "w", "rows")


def occurrences(cut: DataFrame, known: DataFrame, kind: str, one: Unigrams, train_docs: int, vocabulary_parts: int, parts: int) -> DataFrame:
    """Every token and the word before it, in blocks by part and chunk; and per chunk a row of its documents (part < 0).

    In a block v is the history's place among the block's histories, w the word's, rows the document's in the chunk;
    the first n_train tokens are those of training documents. The number of the start of a text is -1.
    """
    most = max(1, one.total // (2 * parts))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left.column("chunk")[0].as_py()
        words = parted(left.column("words")[0].as_py())
        place = places(np.array(words, object), vocabulary_parts)
        ids, counts = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
        for q, k, c in zip(*(right.column(n).to_pylist() for n in ("part", "ids", "counts")), strict=True):
            own = np.flatnonzero(place == q)
            ids[own], counts[own] = unpacked(k) * vocabulary_parts + q, unpacked(c)
        ids[-1], counts[-1] = -1, train_docs
        size, t, held = (unpacked(left.column(n)[0].as_py()) for n in ("sizes", "tokens", "held"))
        row = np.repeat(np.arange(len(size)), size)
        before = np.concatenate([[0], t[:-1]])
        before[np.cumsum(size) - size] = len(words)
        deals = counts // most + 1
        spread = mixed(ids.astype(np.uint64))
        key = spread[before]
        hot = deals[before] > 1
        deal = spread[t[hot]] % deals[before[hot]].astype(np.uint64)
        key[hot] = mixed(key[hot] + np.uint64(1) + deal)
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part * 2 + held[row], kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        out = {"part": [], "n_train": [], **{f: [] for f in FIELDS}}
        for p in np.flatnonzero(np.diff(edge)):
            own = order[edge[p] : edge[p + 1]]
            v_set, v = np.unique(before[own], return_inverse=True)
            w_set, w = np.unique(t[own], return_inverse=True)
            rows = row[own]
            n_train = int((held[rows] == 0).sum())
            step = np.diff(rows[:n_train], prepend=0), np.diff(rows[n_train:], prepend=0)
            out["part"].append(int(p)), out["n_train"].append(n_train)
            for f, x in zip(FIELDS, (ids[v_set] + 1, counts[v_set], deals[v_set] > 1, v, ids[w_set], counts[w_set], w, np.concatenate(step)), strict=True):
                out[f].append(packed(x))
        n = len(out["part"])
        c = counts[t]
        base, n_known = np.bincount(row, one.base(c), len(size)), np.bincount(row, c > 0, len(size)).astype(np.int64)
        return pa.table(
            {
                "part": pa.array([*out["part"], -1 - chunk], pa.int64()), "chunk": pa.array([chunk] * (n + 1), pa.int64()), "n_train": pa.array([*out["n_train"], None], pa.int64()),
                **{f: pa.array([*out[f], None], pa.binary()) for f in FIELDS}, "doc_ids": pa.array([None] * n + [left.column("doc_ids")[0].as_py()], pa.list_(left.schema.field("doc_ids").type.value_type)),
                **{name: pa.array([None] * n + [packed(x)], pa.binary()) for name, x in (("held", held), ("sizes", size), ("known", n_known), ("base", base))},
            }
        )

    schema = f"part bigint, chunk bigint, n_train bigint, {', '.join(f'{f} binary' for f in FIELDS)}, doc_ids array<{kind}>, held binary, sizes binary, known binary, base binary"
    right = known.where("chunk IS NOT NULL").select("part", "chunk", "ids", "counts")
    return cut.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, schema)


HISTORY = "id bigint, dealt boolean, total bigint, of array<bigint>, lower double"


def counted(seen: DataFrame, kind: str, one: Unigrams) -> DataFrame:
    """Count the bigrams of each part, and sum by document what doesn't hang on the discounts.

    A row per part: counts of counts; histories, those that a document backs off from or whose continuations are all
    commoner than KATZ here, with their counts of counts and the lower order's probability of their continuations; and
    a row per chunk in it with the documents' sums (rows, score, hits: tokens by bigram count up to KATZ) and what waits
    for a history's weight (wait_rows, wait_history, wait_n unseen and wait_seen seen tokens). Rows of documents pass.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), **{c: table.column(c) for c in ("doc_ids", "held", "sizes", "known", "base")}, **{f.name: pa.nulls(len(table), f.type) for f in MADE}}).select(ORDER)
        got = {f: [unpacked(x) for x in table.column(f).to_pylist()] for f in FIELDS}
        n_train, chunk = table.column("n_train").to_numpy(), table.column("chunk").to_numpy()
        table = None
        v_ids, v_at = np.unique(np.concatenate(got["v_ids"]), return_inverse=True)
        w_ids, w_at = np.unique(np.concatenate(got["w_ids"]), return_inverse=True)
        total, dealt, w_count = np.zeros(len(v_ids), np.int64), np.zeros(len(v_ids), bool), np.zeros(len(w_ids), np.int64)
        total[v_at], dealt[v_at], w_count[w_at] = np.concatenate(got["v_totals"]), np.concatenate(got["v_dealt"]) > 0, np.concatenate(got["w_counts"])
        v_at, w_at = np.split(v_at, np.cumsum([len(x) for x in got["v_ids"]])[:-1]), np.split(w_at, np.cumsum([len(x) for x in got["w_ids"]])[:-1])
        keys = [va[v] * len(w_ids) + wa[w] for va, wa, v, w in zip(v_at, w_at, got["v"], got["w"], strict=True)]
        types, count = np.unique(np.concatenate([k[:n] for k, n in zip(keys, n_train, strict=True)]), return_counts=True)
        type_v, lower = types // len(w_ids), one.probability(w_count)
        few = count <= KATZ
        of = np.stack([np.bincount(type_v[count == r], minlength=len(v_ids)) for r in range(1, KATZ + 1)], 1)
        mass = np.bincount(type_v, lower[types % len(w_ids)], len(v_ids))
        bare = of.sum(1) == 0  # no continuation is discounted: the total gets one more
        log_total = np.log10(np.maximum(total + (bare & ~dealt), 1))
        wait_all = np.zeros(len(v_ids), bool)
        made = {c: [] for c in ("rows", "score", "hits", "wait_rows", "wait_history", "wait_n", "wait_seen")}
        for k, n, step in zip(keys, n_train, got["rows"], strict=True):
            rows = np.concatenate([np.cumsum(step[:n]), np.cumsum(step[n:])])
            at = np.minimum(np.searchsorted(types, k), max(len(types) - 1, 0))
            c = np.where(types[at] == k, count[at], 0) if len(types) else np.zeros(len(k), np.int64)
            v, hit = k // len(w_ids), c > 0
            there, of_row = np.unique(rows, return_inverse=True)
            worth = np.where(hit, np.log10(np.maximum(c, 1)) - log_total[v], np.log10(lower[k % len(w_ids)]))
            waits = (~hit & (total[v] > 0)) | (hit & bare[v] & dealt[v])
            pair, which = np.unique(rows[waits] * len(v_ids) + v[waits], return_inverse=True)
            wait_all[pair % len(v_ids)] = True
            low = hit & (c <= KATZ)
            made["rows"].append(packed(there)), made["score"].append(packed(np.bincount(of_row, worth)))
            made["hits"].append(packed(np.bincount(of_row[low] * KATZ + c[low] - 1, minlength=len(there) * KATZ)))
            made["wait_rows"].append(packed(pair // len(v_ids))), made["wait_history"].append(pair % len(v_ids))
            made["wait_n"].append(packed(np.bincount(which, ~hit[waits], len(pair)).astype(np.int64))), made["wait_seen"].append(packed(np.bincount(which, hit[waits], len(pair)).astype(np.int64)))
        wanted = np.flatnonzero(wait_all | dealt)
        place = np.zeros(len(v_ids), np.int64)
        place[wanted] = np.arange(len(wanted))
        made["wait_history"] = [packed(place[x]) for x in made["wait_history"]]
        n = len(chunk)
        counts_of = np.bincount(np.minimum(count, KATZ + 2), minlength=KATZ + 3)[1 : KATZ + 2]
        hot = dealt[wanted]
        histories = [{"id": int(v_ids[i]) - 1, "of": of[i].tolist(), "lower": float(mass[i])} for i in wanted[hot]]
        out = {
            "part": pa.array([part] * n, pa.int64()), "chunk": pa.array(chunk, pa.int64()), **{c: pa.nulls(n, f) for c, f in PASSED.items()},
            **{c: pa.array(x, pa.binary()) for c, x in made.items()},
            "of": pa.array([counts_of.tolist(), *[None] * (n - 1)], pa.list_(pa.int64())), "dealt": pa.array([histories, *[None] * (n - 1)], MADE_TYPES["dealt"]),
            "h_ids": pa.array([packed(v_ids[wanted])] + [None] * (n - 1), pa.binary()), "h_dealt": pa.array([packed(hot)] + [None] * (n - 1), pa.binary()), "h_total": pa.array([packed(total[wanted])] + [None] * (n - 1), pa.binary()),
            "h_of": pa.array([packed(of[wanted].ravel())] + [None] * (n - 1), pa.binary()), "h_lower": pa.array([packed(mass[wanted])] + [None] * (n - 1), pa.binary()),
        }
        del few
        give_back()
        return pa.table(out).select(ORDER)

    dealt_type = pa.list_(pa.struct([("id", pa.int64()), ("of", pa.list_(pa.int64())), ("lower", pa.float64())]))
    MADE = [pa.field(c, pa.binary()) for c in ("rows", "score", "hits", "wait_rows", "wait_history", "wait_n", "wait_seen", "h_ids", "h_dealt", "h_total", "h_of", "h_lower")] + [pa.field("of", pa.list_(pa.int64())), pa.field("dealt", dealt_type)]
    MADE_TYPES = {f.name: f.type for f in MADE}
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    PASSED = {"doc_ids": pa.list_(id_type), **{c: pa.binary() for c in ("held", "sizes", "known", "base")}}
    ORDER = ["part", "chunk", *PASSED, *MADE_TYPES]
    made = ", ".join(f"{c} binary" for c in list(MADE_TYPES)[:-2])
    return seen.groupBy("part").applyInArrow(run, f"part bigint, chunk bigint, doc_ids array<{kind}>, held binary, sizes binary, known binary, base binary, {made}, of array<bigint>, dealt array<struct<id: bigint, of: array<bigint>, lower: double>>")


def weights(total: np.ndarray, of: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the backoff weight of histories, and what log10 of a seen continuation changes by where all counts are kept whole."""
    left = of @ (np.arange(1, KATZ + 1) * (1 - d))
    bare = of.sum(1) == 0
    whole = total + bare
    return np.log10(np.where(bare, 1.0, left) / whole / np.maximum(1 - lower, 1e-300)), np.log10(total / whole)


def weighted(parts: DataFrame, d: np.ndarray, buckets: int) -> DataFrame:
    """Sums of each part and chunk with the discounts and backoff weights: chunk, rows, score."""
    hot = parts.select("part", F.inline("dealt"))
    sums = hot.groupBy("id").agg(*(F.sum(F.col("of")[r]).alias(f"n{r}") for r in range(KATZ)), F.sum("lower").alias("lower"))
    hot = hot.select(F.col("part").alias("home"), "id").join(sums, "id").repartition(buckets, "home")

    def run(table: pa.Table, hot: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table.column("rows")))
        if not len(table):
            return pa.table({"chunk": pa.nulls(0, pa.int64()), "rows": pa.nulls(0, pa.binary()), "score": pa.nulls(0, pa.binary())})
        first = table.filter(pc.is_valid(table.column("h_ids")))
        ids, dealt, total, of, lower = (unpacked(first.column(c)[0].as_py()) for c in ("h_ids", "h_dealt", "h_total", "h_of", "h_lower"))
        ids, of = ids - 1, of.reshape(-1, KATZ)
        where = {int(k): i for i, k in enumerate(ids) if dealt[i]}
        for r in hot.to_pylist():
            i = where[r["id"]]
            of[i], lower[i] = [r[f"n{k}"] for k in range(KATZ)], r["lower"]
        back, change = weights(np.maximum(total, 1), of, lower, d)
        change *= dealt  # others have it in their sums
        scores = []
        for rows, score, hits, wait_rows, h, n, n_seen in zip(*(map(unpacked, table.column(c).to_pylist()) for c in ("rows", "score", "hits", "wait_rows", "wait_history", "wait_n", "wait_seen")), strict=True):
            score = score + hits.reshape(-1, KATZ) @ np.log10(d)
            scores.append(packed(score + np.bincount(np.searchsorted(rows, wait_rows), n * back[h] + n_seen * change[h], len(rows))))
        return pa.table({"chunk": table.column("chunk"), "rows": table.column("rows"), "score": pa.array(scores, pa.binary())})

    own = parts.where("part >= 0").select("part", "chunk", "rows", "score", "hits", "wait_rows", "wait_history", "wait_n", "wait_seen", "h_ids", "h_dealt", "h_total", "h_of", "h_lower")
    return own.groupBy("part").cogroup(hot.groupBy("home")).applyInArrow(run, "chunk bigint, rows binary, score binary")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a bigram model of the training texts, those whose crc32 of the id as text leaves no 2 when divided by 7.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score, the model's log10 probability of the text and its end. A seen bigram has its discounted share of its
    history; an unseen one the history's backoff weight times the word's own probability; after a history without
    training text the word has its own probability alone. Words never trained on are one type, with the mass that the
    discounts of single words leave. Where no count of a history is discounted its total gets one more, so that every
    probability is positive and those after each history add up to one.

    A null text counts as empty and is its end alone. A null id is never held out. Rows repeated with one id each
    count and each have a row. Without training texts n_known and base_score are 0, and score is 0. An empty table
    gives an empty table; further columns are ignored.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = bucketed(chunks(docs, id_col, text_col), "chunks", "chunk", buckets)
    tokens, words, train_docs = (int(x or 0) for x in cut.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("n_train_docs")).first())
    vocabulary_parts, parts = max(LEAST_PARTS, -(-words // PART_WORDS)), max(LEAST_PARTS, -(-tokens // PART_TOKENS))
    known = stored(vocabulary(cut, vocabulary_parts), "vocabulary")
    ends = known.where("chunk IS NULL")
    types, total = (int(x or 0) for x in ends.agg(F.sum("types"), F.sum("total")).first())
    one = Unigrams(total, types, summed(ends, "of"))
    made = bucketed(counted(occurrences(cut, known, kind, one, train_docs, vocabulary_parts, parts), kind, one), "bigrams", "part", buckets)
    d = discounts(summed(made, "of"))
    sums = weighted(made, d, buckets)
    texts = made.where("part < 0").select("chunk", "doc_ids", "held", "sizes", "known", "base")

    def run(table: pa.Table, sums: pa.Table) -> pa.Table:
        held, size, n_known, base = (unpacked(table.column(c)[0].as_py()) for c in ("held", "sizes", "known", "base"))
        score = np.zeros(len(size))
        for rows, s in zip(*(map(unpacked, sums.column(c).to_pylist()) for c in ("rows", "score")), strict=True):
            score[rows] += s
        return pa.table([table.column("doc_ids").combine_chunks().flatten(), pa.array(held > 0), pa.array(size), pa.array(n_known), pa.array(np.full(len(size), total)), pa.array(base), pa.array(score)], NAMES)

    return texts.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def oracle(digits: int = 6) -> str:
    """DuckDB SQL with the same rows: every token joined with its bigram, its history's weight and its word."""

    def katz(table: str) -> str:
        n = lambda r: f"(SELECT count(*)::DOUBLE FROM {table} WHERE c = {r})"
        rows = ", ".join(f"({r}, {n(r)}, {n(r + 1)})" for r in range(1, KATZ + 1))
        return f"""(
    SELECT r, CASE WHEN d > 0 AND d < 1 THEN d ELSE (r - off) / r END AS d FROM (
        SELECT r, off, CASE WHEN a > 0 AND most <> 1 THEN ((r + 1) * b / (r * a) - most) / (1 - most) ELSE 0 END AS d
        FROM (VALUES {rows}) v(r, a, b),
             (SELECT CASE WHEN n1 > 0 THEN {KATZ + 1} * n6 / n1 ELSE 1 END AS most, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS off
              FROM (SELECT {n(1)} AS n1, {n(2)} AS n2, {n(KATZ + 1)} AS n6))))"""

    space = "e' \\t\\n\\x0b\\x0c\\r'"
    return f"""
WITH RECURSIVE {crc32_tables("SELECT DISTINCT doc_id::VARCHAR FROM documents WHERE doc_id IS NOT NULL")},
docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, coalesce(c % 7 = 2, false) AS held,
           trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {space}) AS t
    FROM documents LEFT JOIN crc32 ON key = doc_id::VARCHAR),
lists AS (SELECT row, doc_id, held, CASE WHEN t = '' THEN [''] ELSE list_append(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), '') END AS t FROM docs),
tok AS MATERIALIZED (SELECT row, held, unnest(t) AS w, unnest(list_concat([chr(10)], t[:-2])) AS v FROM lists),
uni AS MATERIALIZED (SELECT w, count(*) AS c FROM tok WHERE NOT held GROUP BY w),
size AS MATERIALIZED (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS types FROM uni),
d1 AS MATERIALIZED {katz("uni")},
left1 AS MATERIALIZED (SELECT coalesce(sum(c * (1 - d)), 0) AS m FROM uni JOIN d1 ON r = c),
p0 AS MATERIALIZED (SELECT CASE WHEN n = 0 THEN 1 WHEN m > 0 THEN m / n ELSE 1 / (n + 1) END AS unknown, CASE WHEN m > 0 THEN n ELSE n + 1 END AS whole FROM left1, size),
p1 AS MATERIALIZED (SELECT w, c, c * coalesce(d, 1) / whole AS p FROM uni LEFT JOIN d1 ON r = c, p0),
bi AS MATERIALIZED (SELECT v, w, count(*) AS c FROM tok WHERE NOT held GROUP BY v, w),
d2 AS MATERIALIZED {katz("bi")},
hist AS MATERIALIZED (
    SELECT v, sum(bi.c) + CASE WHEN count(r) = 0 THEN 1 ELSE 0 END AS whole, CASE WHEN count(r) = 0 THEN 1 ELSE sum(bi.c * (1 - d)) END AS m, sum(p) AS lower
    FROM bi JOIN p1 USING (w) LEFT JOIN d2 ON r = bi.c GROUP BY v),
scored AS (
    SELECT row, count(*) AS n_tokens, count(p1.c) AS n_known, sum(log10((coalesce(p1.c, 0) + 1) / (n + types + 1))) AS base,
           sum(CASE WHEN bi.c IS NOT NULL THEN log10(bi.c * coalesce(d, 1) / hist.whole)
                    WHEN hist.v IS NOT NULL THEN log10(m / hist.whole / (1 - lower) * coalesce(p, unknown)) ELSE log10(coalesce(p, unknown)) END) AS score
    FROM tok LEFT JOIN p1 USING (w) LEFT JOIN bi ON bi.v = tok.v AND bi.w = tok.w LEFT JOIN d2 ON r = bi.c LEFT JOIN hist ON hist.v = tok.v, p0, size
    GROUP BY row)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, round(base, {digits}) AS base_score, round(score, {digits}) AS score FROM docs JOIN scored USING (row), size"""
