"""Best-fit packing of tokenized documents into sequences of bounded length.

Only the histogram of piece lengths (at most `capacity` rows, whatever the corpus) goes to the driver. There, items of
over a third of the capacity are matched greedily, at most two to a sequence, and shorter ones best-fit the gaps, a
whole length class at a time. The plan is a table of (length, ranks, where they go), which a broadcast join applies.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudence.llm.bpe import default_vocabulary, encoder
from prudence.llm.features import released
from prudence.llm.scratch import stored

CAPACITY = 2048
#: Rows of one length that are ranked in one task.
RANKED_ROWS = 200_000


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens start: all but the first are full."""
    first = n % capacity
    return [0, *range(first, n, capacity)] if first and n > capacity else list(range(0, n, capacity))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every text.

    A document is its ids and then end_id; null text counts as empty and gives one piece of one token.
    """
    path = vocabulary or default_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column(0)
            for at, flat, starts in enc.columns(batch.column(1)):
                out = defaultdict(list)
                for row in range(len(starts) - 1):
                    ids = np.concatenate([flat[starts[row] : starts[row + 1]], last])
                    begin = cuts(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(ids)], strict=True)):
                        part = ids[a:b].astype("<u4")
                        out["row"].append(at + row), out["piece"].append(k), out["start"].append(a), out["length"].append(b - a)
                        out["crc"].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                columns = [doc_ids.take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(pieces), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, rank after the last, first sequence, items of it in each sequence, offset) and the number of sequences.

    Every step uses up a length class or a group of equal gaps, so the rows grow with the capacity, not with the counts.
    """
    left = {k: n for k, n in counts.items() if n}
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: first sequence, number of sequences
    made = 0

    def put(length: int, bins: int, each: int, total: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + total, first, each, offset))
        rank[length] += total
        left[length] -= total

    def leave(gap: int, first: int, bins: int) -> None:
        if bins and gap:
            if not groups[gap]:
                insort(gaps, gap)
            groups[gap].append((first, bins))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    small = sorted((k for k in left if 3 * k <= capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if left[x] and x + a <= capacity and (x != a or left[a] > 1)), None)
            if b is None:
                bins = left[a]
                put(a, bins, 1, bins, made, 0)
                leave(capacity - a, made, bins)
            else:
                bins = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, bins, 1, bins, made, 0)
                put(b, bins, 1, bins, made, a)
                leave(capacity - a - b, made, bins)
            made += bins
    for a in small:
        while left[a]:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                bins = -(-left[a] // (capacity // a))
                leave(capacity, made, bins)
                made += bins
                continue
            gap = gaps[at]
            first, bins = groups[gap].pop()
            if not groups[gap]:
                gaps.pop(at)
            each = gap // a
            full = min(bins, left[a] // each)
            if full:
                put(a, full, each, full * each, first, capacity - gap)
                leave(gap - each * a, first, full)
            rest = left[a] if full < bins else 0
            if rest:
                put(a, 1, rest, rest, first + full, capacity - gap)
                leave(gap - rest * a, first + full, 1)
            leave(gap, first + full + bool(rest), bins - full - bool(rest))
    return rows, made


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, in as many tasks as a length needs."""
    heavy = pieces.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-heavy // RANKED_ROWS) * 4)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    return pieces.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if with_ids. Null
    and empty texts are one token (end_id). Rows repeated with the same id are packed as often as they stand. An empty
    table gives an empty table; further columns of docs are ignored.
    """
    pieces = stored(token_pieces(docs, capacity, vocabulary, end_id, with_ids, id_col, text_col), "pieces")
    rows, _ = plan({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}, capacity)
    table = docs.sparkSession.createDataFrame(rows or [(0,) * 6], "length bigint, lo bigint, hi bigint, first bigint, each bigint, base bigint")
    within = F.col("_rank") - F.col("lo")
    match = (F.col("p.length") == F.col("t.length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    placed = ranked(pieces).alias("p").join(F.broadcast(table).alias("t"), match)
    out = ["doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("first") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + within % F.col("each") * F.col("p.length")).cast("long").alias("offset")]
    return placed.select(*out, *["ids"] * with_ids)
