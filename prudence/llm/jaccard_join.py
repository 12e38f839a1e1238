"""N-gram Jaccard self-join of documents: chosen paths.

A document is the set of its five-word shingles; documents with equal sets are one class, of which one row goes on.
A run samples shared tokens: with one hash function a set of n shingles takes those that hash below 1/(threshold n),
so two sets of similarity `threshold` or more share a taken one with probability 0.63 or more. Sets that took the same
token make a bucket. Small buckets are compared by brute force. A large one is split again by the tokens of every later
function, up to `DEPTH` levels; one whose sets stay together under most functions (they are near copies of each other)
is compared in blocks. A pair is met in its first small or stuck bucket, at the latest where it agrees in `DEPTH`
functions, whichever they are. There are so many functions that a pair at the threshold is missed with probability
1 - recall at most, even if all of its buckets are split at each level.

Brute force has two steps. The first compares sketches of 256 bits and sizes, and leaves in a bucket only sets that may
have a partner there which they don't meet in a bucket with a smaller number; a pair at the threshold fails it with
probability MISS at most. The second compares whole shingle sets. A pair counts in the bucket with the smallest number
among those that both are in, so that pairs needn't be gathered anywhere to be counted once: buckets send out how many
links each document has in them and a tree of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prudence.llm.features import mixed, released, slices
from prudence.llm.scratch import stored

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Sets of a bucket that isn't split, and of a block of sketches of one that is split no further.
SMALL = 6000
#: Sets and shingles of a block of whole sets; sketches of a tile that is compared at once.
BLOCK, BLOCK_SHINGLES, TILE = 2500, 1_000_000, 1500
DEPTH = 3
#: Sets of a group whose sketches are compared one by one; those of more are compared by matrices.
SINGLE = 64
#: A bucket isn't split if under half of the later functions or more, one part has more than this share: its sets are near copies.
STUCK = 0.5
#: Places of a sketch, and the probability that it parts a pair at the threshold.
PLACES, MISS = 128, 1e-6
#: Documents with a possible partner up to which their buckets are broadcast to the texts; beyond, both are shuffled.
FEW = 100_000
#: Bytes of shingles that are handed over at a time.
DEALT_BYTES = 8_000_000
#: Columns of a dense matrix of shingles at a time.
COLUMNS = 2048


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold, taken together with probability 1 - 1/e in a run, is missed with probability 1 - recall at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 / math.e)))


def functions_for(recall: float, runs: int) -> int:
    """Functions of which a pair at the threshold agrees in DEPTH, one of them a run's, but with probability 1 - recall. The first of them are those of the runs, the others only split."""

    def missed(n: int) -> float:
        agree = 1 - 1 / math.e
        none = math.exp(-runs)
        return none + sum(math.comb(n, k) * agree**k * math.exp(k - n) - (math.comb(n - runs, k) * agree**k * math.exp(k - n)) for k in range(1, DEPTH))

    n = max(runs, DEPTH)
    while n < 10 * runs and missed(n) > 1 - recall:
        n += 1
    return n


def shingle_sets(part: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, by row and hash. Texts of fewer words than `width` have one shingle of all words; texts without words none."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(part), r"[^\pL\pN]+", " "), " ")
    split = pc.split_pattern(plain, " ")
    starts = split.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    coded = split.flatten().dictionary_encode()
    import xxhash

    words = coded.dictionary.to_pylist()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    h = table[coded.indices.to_numpy()]
    sizes = np.diff(starts)
    empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(part)), sizes)
    short = (sizes < width) & ~empty
    n = len(h) - width + 1
    out_row, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s = mixed(s + h[k : n + k])
        whole = row[:n] == row[width - 1 :]
        out_row.append(row[:n][whole])
        out.append(s[whole])
    for r in np.flatnonzero(short):
        s = np.full(1, sizes[r], np.uint64)
        for x in h[starts[r] : starts[r + 1]]:
            s = mixed(s + x)
        out_row.append(np.array([r]))
        out.append(s)
    row, s = np.concatenate(out_row), np.concatenate(out)
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return row[new], s[new]


def sketches(row: np.ndarray, s: np.ndarray, rows: int) -> np.ndarray:
    """Sketch of each row's sorted hashes, as (rows, 32) bytes: which of PLACES ranges of hashes have any, then a bit of the least in each."""
    place = (s >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    bits = np.zeros((rows, 2 * PLACES), np.uint8)
    bits[row[first], place[first]] = 1
    bits[row[first], PLACES + place[first]] = s[first] & np.uint64(1)
    return np.packbits(bits, axis=1)


def least_agreeing(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of places that either of two sketches has: in how many they agree at least if the sets have the threshold, but with probability `miss`."""
    out = []
    for n in range(PLACES + 1):
        below, k = (1 - threshold) ** n, 0
        while below <= miss and k < n:
            k += 1
            below += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        out.append(k)
    return out


def signatures(docs: DataFrame, functions: int, threshold: float, width: int) -> DataFrame:
    """doc_id, low and high (the class of its shingle set), n (its size), taken (run, token) and sketch of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = mixed(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                row, s = shingle_sets(part, width)
                n = np.bincount(row, minlength=len(part))
                low = np.zeros(len(part), np.uint64)
                high = np.zeros(len(part), np.uint64)
                np.add.at(low, row, mixed(s))
                np.add.at(high, row, mixed(s ^ np.uint64(0xD6E8FEB86659FD93)))
                bound = (float(2**64) / np.maximum(1.0, threshold * n)).clip(0, float(2**64 - 2048)).astype(np.uint64)[row]
                rows, run, token = [], [], []
                for k in range(functions):
                    hit = np.flatnonzero(s * keys[k] < bound)
                    rows.append(row[hit])
                    run.append(np.full(len(hit), k, np.int32))
                    token.append(s[hit])
                rows, run, token = map(np.concatenate, (rows, run, token))
                order = np.argsort(rows, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(part)))]).astype(np.int32)
                taken = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(run[order]), pa.array(token[order].view(np.int64))], ["run", "token"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(n.astype(np.int64)), taken, pa.array([x.tobytes() for x in sketches(row, s, len(part))], pa.binary())], ["doc_id", "low", "high", "n", "taken", "sketch"])

    return docs.mapInArrow(released(signed), f"doc_id {kind}, low bigint, high bigint, n bigint, taken array<struct<run: int, token: bigint>>, sketch binary")


def buckets(sets: DataFrame, runs: int, functions: int) -> DataFrame:
    """doc_id, bucket, blocks: who is compared with whom by sketches, a bucket of several blocks by pairs of them."""
    taken = sets.select("doc_id", F.inline("taken")).where(F.col("run") < runs)
    level = stored(taken.select("doc_id", F.xxhash64("run", "token").alias("bucket"), "run"), "taken")
    blocks = F.ceil(F.col("size") / SMALL).cast("int").alias("blocks")
    met = []
    for depth in range(DEPTH):
        # sizes are written, so that both sides of the joins come straight from an exchange and a hot bucket can be split
        sizes = stored(level.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket", "size", blocks), "sizes")
        level = stored(level.join(sizes, "bucket"), "buckets")
        rest = level.where(F.col("size") > SMALL)
        if depth == DEPTH - 1 or rest.isEmpty():
            met.append(level.select("doc_id", "bucket", "blocks"))
            break
        met.append(level.where(F.col("size") <= SMALL).select("doc_id", "bucket", "blocks"))
        # the tokens of each later function split it
        later = rest.withColumnRenamed("run", "last").join(sets.select("doc_id", "taken"), "doc_id").select("doc_id", "last", "bucket", "size", F.inline("taken")).where("run > last")
        parts = stored(later.select("doc_id", "run", "last", "bucket", "size", F.xxhash64("bucket", "run", "token").alias("part")), "parts")
        largest = parts.groupBy("bucket", "size", "last", "run", "part").count().groupBy("bucket", "size", "last", "run").agg(F.max("count").alias("most"))
        held = largest.groupBy("bucket", "last").agg(F.sum((F.col("most") > STUCK * F.col("size")).cast("int")).alias("held"))
        stuck = stored(held.where(2 * F.col("held") >= functions - 1 - F.col("last")).select("bucket"), "stuck")
        met.append(rest.join(stuck, "bucket", "left_semi").select("doc_id", "bucket", "blocks"))
        level = parts.join(stuck, "bucket", "left_anti").select("doc_id", F.col("part").alias("bucket"), "run")
    together = met[0]
    for x in met[1:]:
        together = together.unionByName(x)
    return together


def linked(sets: list[np.ndarray], others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of which sets have at least the threshold with which others. Sets are sorted arrays."""
    a, b = np.array([len(x) for x in sets], float), np.array([len(x) for x in others], float)
    both = np.concatenate([*sets, *others])
    _, place, counts = np.unique(both, return_inverse=True, return_counts=True)
    shared = counts > 1  # a shingle of one set alone adds to no intersection
    at = np.cumsum(shared) - 1
    n, m, width = len(sets), len(others), int(shared.sum())
    row = np.repeat(np.arange(n + m), np.concatenate([a, b]).astype(np.int64))
    keep = shared[place]
    row, column = row[keep], at[place[keep]]
    common = np.zeros((n, m), np.float32)
    for c in range(0, width, COLUMNS):
        inside = (column >= c) & (column < c + COLUMNS)
        dense = np.zeros((n + m, min(COLUMNS, width - c)), np.float32)
        dense[row[inside], column[inside] - c] = 1
        common += dense[:n] @ dense[n:].T
    return common >= threshold * (a[:, None] + b[None, :] - common) - 1e-9


def earlier(lists: list[np.ndarray], others: list[np.ndarray], bucket: int) -> np.ndarray:
    """Matrix of which share a bucket with a smaller number than `bucket`."""
    n, m = len(lists), len(others)
    mine = [x[x < bucket] for x in [*lists, *others]]
    flat = np.concatenate(mine)
    if not len(flat):
        return np.zeros((n, m), bool)
    keys, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(n + m), [len(x) for x in mine])
    out = np.zeros((n, m), np.float32)
    for c in range(0, len(keys), COLUMNS):
        inside = (column >= c) & (column < c + COLUMNS)
        dense = np.zeros((n + m, min(COLUMNS, len(keys) - c)), np.float32)
        dense[row[inside], column[inside] - c] = 1
        out += dense[:n] @ dense[n:].T
    return out > 0


def spanning(rows: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    """Smallest place of each place's component, given links between places."""
    label = np.arange(size)
    while len(rows):
        least = label.copy()
        np.minimum.at(least, rows, label[columns])
        np.minimum.at(least, columns, label[rows])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


def compared(group: list[dict], threshold: float) -> list[tuple]:
    """(doc_id, links that this bucket counts, another doc_id of its component) for one bucket or pair of blocks; members are sorted by id."""
    bucket = group[0]["bucket"]
    left = [g for g in group if g["side"] != 1]
    right = [g for g in group if g["side"] != 0]
    same = group[0]["side"] == 2
    hit = linked([g["set"] for g in left], [g["set"] for g in right], threshold)
    if same:
        hit = np.triu(hit, 1)
    rows, columns = np.nonzero(hit)
    if not len(rows):
        return []
    own = ~earlier([g["buckets"] for g in left], [g["buckets"] for g in right], bucket)[rows, columns]
    shift = 0 if same else len(left)
    members = left if same else [*left, *right]
    count = np.bincount(rows[own], minlength=len(members)) + np.bincount(columns[own] + shift, minlength=len(members))
    root = spanning(rows, columns + shift, len(members))
    touched = np.zeros(len(members), bool)
    touched[rows] = touched[columns + shift] = True
    return [(members[i]["doc_id"], int(count[i]), members[root[i]]["doc_id"]) for i in np.flatnonzero(touched)]


def dealt(rows: DataFrame) -> DataFrame:
    """pair and side, beside the other columns, of each row of doc_id, bucket, blocks: the pairs of blocks in which a document is compared. Side 2 is a block with itself."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    own = F.pmod(key, F.col("blocks")).cast("int")
    rows = rows.select("*", own.alias("_own")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    low, high = F.least("_own", "_other").cast("bigint"), F.greatest("_own", "_other").cast("bigint")
    side = F.when(low == high, 2).otherwise((F.col("_own") == high).cast("int")).cast("int")
    return rows.withColumn("pair", low * F.col("blocks") + high).withColumn("side", side).drop("_own", "_other", "blocks")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each bucket and pair of blocks, from rows in that order."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and (group[0]["bucket"], group[0]["pair"]) != (row["bucket"], row["pair"]):
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def hopeful_few(group: list[dict], agreeing: list[int], threshold: float) -> list[int]:
    """Places of the members of a small group that may have a partner in it which they meet in no bucket with a smaller number."""
    bucket = group[0]["bucket"]
    seen = [int.from_bytes(g["sketch"][: PLACES // 8], "big") for g in group]
    bits = [int.from_bytes(g["sketch"][PLACES // 8 :], "big") for g in group]
    before = [{x for x in g["numbers"] if x < bucket} for g in group]
    order = sorted(range(len(group)), key=lambda i: group[i]["n"])
    kept = [False] * len(group)
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if group[i]["n"] < threshold * group[j]["n"] - 1e-9:
                break
            if kept[i] and kept[j] or group[i]["side"] == group[j]["side"] != 2:
                continue
            agree = (seen[i] & seen[j] & ~(bits[i] ^ bits[j])).bit_count()
            if agree >= agreeing[(seen[i] | seen[j]).bit_count()] and before[i].isdisjoint(before[j]):
                kept[i] = kept[j] = True
    return [i for i, k in enumerate(kept) if k]


def hopeful_many(group: list[dict], agreeing: list[int], threshold: float) -> list[int]:
    """The same of a large group, with matrices of TILE rows and columns."""
    left = [i for i, g in enumerate(group) if g["side"] != 1]
    right = [i for i, g in enumerate(group) if g["side"] != 0]
    n = np.array([g["n"] for g in group], float)
    words = np.frombuffer(b"".join(g["sketch"] for g in group), np.uint64).reshape(len(group), -1)
    half = words.shape[1] // 2
    least = np.array(agreeing, np.int16)
    kept = np.zeros(len(group), bool)
    for i in range(0, len(left), TILE):
        for j in range(i if group[0]["side"] == 2 else 0, len(right), TILE):
            a, b = np.array(left[i : i + TILE]), np.array(right[j : j + TILE])
            hit = (n[a][:, None] >= threshold * n[b][None, :] - 1e-9) & (n[b][None, :] >= threshold * n[a][:, None] - 1e-9) & (a[:, None] != b[None, :])
            either, agree = np.zeros(hit.shape, np.int16), np.zeros(hit.shape, np.int16)
            for k in range(half):
                x, y = words[a, k][:, None], words[b, k][None, :]
                either += np.bitwise_count(x | y)
                agree += np.bitwise_count(x & y & ~(words[a, half + k][:, None] ^ words[b, half + k][None, :]))
            hit &= agree >= least[either]
            # whether a pair meets elsewhere matters for those alone that may be partners
            a, b, hit = a[hit.any(1)], b[hit.any(0)], hit[hit.any(1)][:, hit.any(0)]
            if len(a):
                hit &= ~earlier([np.array(group[x]["numbers"], np.int64) for x in a], [np.array(group[x]["numbers"], np.int64) for x in b], group[0]["bucket"])
                kept[a[hit.any(1)]] = kept[b[hit.any(0)]] = True
    return np.flatnonzero(kept).tolist()


def hopeful(sets: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """doc_id, in (bucket, pair, side of the blocks of whole sets where it may have a partner), numbers (all buckets of the document in order)."""
    schema = sets.schema
    kind, id_type = schema["doc_id"].dataType.simpleString(), to_arrow_type(schema["doc_id"].dataType)
    agreeing = least_agreeing(threshold)
    numbers = stored(member.groupBy("doc_id").agg(F.sort_array(F.collect_set("bucket")).alias("numbers")).join(sets.select("doc_id", "n", "sketch"), "doc_id"), "numbers")
    light = dealt(member).join(numbers, "doc_id").select("doc_id", "bucket", "pair", "side", "n", "sketch", "numbers")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in groups(batches):
            for i in (hopeful_few if len(group) <= SINGLE else hopeful_many)(group, agreeing, threshold) if len(group) > 1 else ():
                found.append((group[i]["doc_id"], group[i]["bucket"], group[i]["n"]))
            if len(found) > 20_000:
                yield rows_of(found)
                found = []
        yield rows_of(found)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (id_type, pa.int64(), pa.int64()), strict=True)], ["doc_id", "bucket", "n"])

    found = light.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "doc_id").mapInArrow(released(chosen), f"doc_id {kind}, bucket bigint, n bigint")
    near = stored(found.distinct(), "hopeful")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sizes = stored(near.groupBy("bucket").agg(blocks), "hopeful-sizes")
    own = dealt(near.join(sizes, "bucket")).groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "pair", "side")).alias("in"))
    return own.join(numbers.select("doc_id", "numbers"), "doc_id")


def verified(docs: DataFrame, sets: DataFrame, member: DataFrame, threshold: float, width: int) -> DataFrame:
    """doc_id, links, other: what the buckets' comparisons of whole sets give."""
    id_field = docs.schema["doc_id"].dataType
    kind, id_type = id_field.simpleString(), to_arrow_type(id_field)
    lists = stored(hopeful(sets, member, threshold), "lists")
    few = lists.count() <= FEW
    chosen = docs.join(F.broadcast(lists) if few else lists, "doc_id").select("doc_id", "text", "in", "numbers")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, numbers = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, part in slices(batch.column(1)):
                row, s = shingle_sets(part, width)
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                out: list[list] = [[], [], [], [], [], []]
                size = 0
                for r in range(len(part)):
                    raw, own = s[ends[r - 1] if r else 0 : ends[r]].tobytes(), np.array(numbers[at + r], np.int64).tobytes()
                    for x in places[at + r]:
                        for c, v in zip(out, (at + r, x["bucket"], x["pair"], x["side"], raw, own), strict=True):
                            c.append(v)
                        size += len(raw) + len(own)
                        if size > DEALT_BYTES:
                            yield rows_of(ids, out)
                            out, size = [[], [], [], [], [], []], 0
                yield rows_of(ids, out)

    def rows_of(ids: pa.Array, out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True))], ["doc_id", "bucket", "pair", "side", "shingles", "buckets"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in groups(batches):
            if len(group) > 1:
                found += compared([g | {"set": np.frombuffer(g["shingles"], np.uint64), "buckets": np.frombuffer(g["buckets"], np.int64)} for g in group], threshold)
            if len(found) > 20_000:
                yield links_of(found)
                found = []
        yield links_of(found)

    def links_of(found: list[tuple]) -> pa.RecordBatch:
        ids, counts, others = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(counts, pa.int64()), pa.array(others, id_type)], ["doc_id", "links", "other"])

    rows = chosen.mapInArrow(released(spread), f"doc_id {kind}, bucket bigint, pair bigint, side int, shingles binary, buckets binary")
    return rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "doc_id").mapInArrow(released(judged), f"doc_id {kind}, links bigint, other {kind}")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest id of each id's component. Every round takes the least label among an id's neighbours and then that label's own label."""
    both = stored(edges.select(F.col("doc_id").alias("a"), F.col("other").alias("b")).where("a <> b").distinct(), "edges")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        step = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = step.join(labels.select(F.col("a").alias("m"), F.col("l").alias("lm")), "m", "left").select("a", "l", F.least("m", "lm").alias("m"))
        after = stored(jump, "labels")
        if after.where("l <> m").isEmpty():
            return after.select(F.col("a").alias("doc_id"), F.col("m").alias("class_id"))
        labels = after.select("a", F.col("m").alias("l"))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents.

    Returns one row per distinct doc_id: doc_id, rep_id (smallest id with the same shingle set), class_id (smallest
    rep_id of its component under links), n_links (other shingle sets with at least the threshold to its own), n_shingles.
    Null and empty texts, and texts without letters or digits, have the empty set: they are copies of each other and
    have no links. Of rows with one id and different texts the largest text counts; rows with a null id are left out.
    An empty table gives an empty table, and further columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    runs = runs_for(recall)
    functions = functions_for(recall, runs)
    marked = stored(signatures(docs, functions, threshold, width), "signatures")
    if not marked.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
        marked = stored(signatures(docs, functions, threshold, width), "signatures")
    classes = stored(marked.groupBy("low", "high", "n").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies")), "classes")
    # a class with many copies is joined back by broadcast: there are at most a thousand of over a thousandth of all rows
    share = max(500, marked.count() // 1000)
    key = ["low", "high", "n"]
    some = marked.select("doc_id", *key, "taken", "sketch")
    large = F.broadcast(classes.where(F.col("copies") > share).select(*key, "rep_id"))
    one = some.join(large, key).unionByName(some.join(large, key, "left_anti").join(classes.where(F.col("copies") <= share).select(*key, "rep_id"), key))
    rows = stored(one.select("doc_id", "rep_id", "n", *(F.when(F.col("doc_id") == F.col("rep_id"), F.col(c)).alias(c) for c in ("taken", "sketch"))), "rows")
    sets = rows.where("doc_id = rep_id AND n > 0").select("doc_id", "n", "taken", "sketch")
    member = stored(buckets(sets, runs, functions), "members")
    links = stored(verified(docs, sets, member, threshold, width), "links")
    total = links.groupBy(F.col("doc_id").alias("rep_id")).agg(F.sum("links").alias("n_links"))
    known = total.join(components(links).withColumnRenamed("doc_id", "rep_id"), "rep_id", "left")
    # few documents have links; those with a class of many copies are again joined by broadcast
    hot = classes.where(F.col("copies") > share).select("rep_id")
    many, few = F.broadcast(known.join(hot, "rep_id", "left_semi")), known.join(F.broadcast(hot), "rep_id", "left_anti")
    base = rows.select("doc_id", "rep_id", F.col("n").alias("n_shingles"))
    out = base.join(F.broadcast(hot), "rep_id", "left_semi").join(many, "rep_id", "left").unionByName(base.join(F.broadcast(hot), "rep_id", "left_anti").join(few, "rep_id", "left"))
    return out.select("doc_id", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_shingles")


def oracle(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """The same rows in DuckDB SQL: every pair that shares a shingle."""
    return f"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, CASE WHEN plain = '' THEN [] ELSE string_split(plain, ' ') END AS w
            FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]+', ' ', 'g'), ' ') AS plain FROM documents WHERE doc_id IS NOT NULL)),
        s AS MATERIALIZED (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END)) AS s FROM w),
        c AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(s, '|'))) AS rep_id, len(s) AS n, s FROM s),
        t AS MATERIALIZED (SELECT doc_id AS a, n, unnest(s) AS x FROM c WHERE doc_id = rep_id),
        pairs AS MATERIALIZED (
            SELECT l.a AS a, r.a AS b FROM t l JOIN t r ON l.x = r.x AND l.a <> r.a AND l.n >= {threshold} * r.n AND r.n >= {threshold} * l.n
            GROUP BY l.a, r.a, l.n, r.n HAVING count(*) >= {threshold} * (l.n + r.n - count(*)) - 1e-9),
        reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS k FROM pairs GROUP BY a)
        SELECT c.doc_id, c.rep_id, least(c.rep_id, coalesce(least.m, c.rep_id)) AS class_id, coalesce(degree.k, 0) AS n_links, c.n AS n_shingles
        FROM c LEFT JOIN least ON least.a = c.rep_id LEFT JOIN degree ON degree.a = c.rep_id"""
