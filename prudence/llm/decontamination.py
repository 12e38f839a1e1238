"""Benchmark decontamination, with DataFrame functions only.

Windows of a document are as long as a benchmark item. A similar window holds many of the benchmark's shingles, and the
first best one ends with one of them or starts the text: moving a window on by a word can only add a common shingle if
the one that enters is one of the item's. So only those windows are fingerprinted that end so and have as many places
with a shingle of the benchmark as an item of their size needs; which item's, isn't looked at. A table of flags by
shingle hash, which is part of the plan and of bounded size, tells the places; what it lets through wrongly is only
looked at in vain.

Windows and items get 64-bit SimHash fingerprints, whose bits are counted in planes, 64 at a time. A multi-index finds
the items: fingerprints that differ in at most RADIUS of 64 bits differ in at most NEAR of one of the BLOCKS blocks at
least, so items stand in the index under every value within NEAR bits of each of their blocks, and a window is looked
up by the values of its blocks. Candidates are verified by the exact weighted Jaccard similarity of their shingles
(weight: how often a shingle occurs).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudence.llm.scratch import stored

WIDTH, THRESHOLD = 5, 0.8
#: Blocks of a fingerprint, and bits in which one of them may differ. Every pair within RADIUS is found. Fingerprints of
#: two sets of similarity 0.8 differ in 10 of 64 bits on average, with a deviation of 3.
BLOCKS, NEAR = 5, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Flags of the table of shingles: 64 for each, between these bounds. A fuller table lets more windows through, never fewer.
LEAST_FLAGS, MOST_FLAGS = 1 << 12, 1 << 23
#: Rows of the index, and shingles of all items, up to which they are broadcast; beyond, they are shuffled like the windows.
SMALL_INDEX, SMALL_ITEMS = 1_000_000, 200_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def hashed(at: str, width: int) -> str:
    """SQL of the hash of the shingle of `width` word hashes in h that begins at `at`."""
    return f"xxhash64({', '.join(f'h[{at} + {k}]' for k in range(width))})"


def shingles(w: str) -> str:
    """SQL of the list of shingles of a word array, one of all its words if it is shorter than WIDTH."""
    return f"transform(sequence(0, greatest(size({w}) - {WIDTH}, 0)), i -> array_join(slice({w}, i + 1, {WIDTH}), ' '))"


def fingerprint(hashes: str, most: int) -> str:
    """SQL of the SimHash of a list of at most `most` 64-bit hashes: bit b is set if most of them have it.

    Plane p holds the binary digit p of 64 counters, so that a hash is added to all of them with a few operations.
    """
    planes = range(max(1, most.bit_length()))
    carry = ["x", *(" & ".join(["x", *(f"s.p{q}" for q in range(p))]) for p in planes[1:])]
    start = ", ".join(f"'p{p}', 0L" for p in planes)
    added = ", ".join(f"'p{p}', s.p{p} ^ ({carry[p]})" for p in planes)
    # a counter is over half of the size if, from the highest digit on, it has the first digit that the half lacks
    over, same = "0L", "-1L"
    for p in reversed(planes):
        half = f"if((shiftright(size({hashes}) div 2, {p}) & 1) = 1, -1L, 0L)"
        over, same = f"({over} | ({same} & s.p{p} & ~{half}))", f"({same} & ~(s.p{p} ^ {half}))"
    return f"aggregate({hashes}, named_struct({start}), (s, x) -> named_struct({added}), s -> {over})"


def cuts() -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    ends = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def blocks(f: str) -> str:
    """SQL of the blocks of a fingerprint, as (b, v): number and value."""
    return "array(" + ", ".join(f"named_struct('b', {k}, 'v', shiftrightunsigned({f}, {a}) & {(1 << n) - 1}L)" for k, (a, n) in enumerate(cuts())) + ")"


def masks() -> list[tuple[int, int]]:
    """(block, bits that differ) of all differences of up to NEAR bits."""
    return [(k, sum(1 << i for i in bits)) for k, (_, n) in enumerate(cuts()) for r in range(NEAR + 1) for bits in combinations(range(n), r)]


def place(length: str, b: str, v: str) -> str:
    """SQL of the place in the index: length of the item, block and value in one number."""
    return f"shiftleft(cast({length} AS bigint), 32) | shiftleft(cast({b} AS bigint), 24) | {v}"


def index(items: DataFrame) -> DataFrame:
    """place, item, fi: each item under every value within NEAR bits of each of its blocks."""
    table = items.sparkSession.createDataFrame(masks(), "mb int, mask bigint")
    rows = items.select("len", F.col("key").alias("item"), "fi", F.inline(F.expr(blocks("fi"))))
    return rows.join(F.broadcast(table), F.col("b") == F.col("mb")).select(F.expr(place("len", "b", "(v ^ mask)")).alias("place"), "item", "fi")


def first_block(a: str, b: str) -> str:
    """SQL of whether two fingerprints differ by at most NEAR in block b, a column, and by more in all before it."""
    differ = [f"bit_count(({a} ^ {b}) & {((1 << n) - 1 << at) - (1 << 64 if at + n == 64 else 0)}L)" for at, n in cuts()]
    cases = " ".join(f"WHEN {k} THEN {' AND '.join([*(f'{d} > {NEAR}' for d in differ[:k]), f'{differ[k]} <= {NEAR}'])}" for k in range(BLOCKS))
    return f"CASE b {cases} END"


def counted(w: str) -> str:
    """SQL of a list of shingles as a set: as it is if none is repeated, else each with its number among equals."""
    one_by_one = f"aggregate(array(array_sort({w})), cast(array() AS array<string>), (none, o) -> transform(o, (x, i) -> concat(x, ' ', i + 1 - array_position(o, x))))"
    return f"if(size(array_distinct({w})) = size({w}), transform({w}, x -> concat(x, ' 0')), {one_by_one})"


def similarity(a: str, b: str, common: str) -> str:
    """SQL of the weighted Jaccard similarity of two lists of shingles, given how many they have in common."""
    return f"({common} / (size({a}) + size({b}) - {common}))"


def flag_table(hashes: list[int]) -> bytearray:
    """A byte for each place, 1 where a hash falls."""
    size = LEAST_FLAGS
    while size < min(MOST_FLAGS, 64 * len(hashes)):
        size *= 2
    out = bytearray(size)
    for h in hashes:
        out[h % size] = 1
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items in whole texts.

    Returns one row per document and item whose best window has at least the threshold: doc_id, item_id, similarity,
    start_word, n_words, hamming. Windows of one document, item and similarity: the first counts. Null and empty texts
    and items have no words and match nothing. Items of fewer than five words are one shingle. Repeated rows count
    once; of several texts with one id the best window counts; empty tables give an empty table; further columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).distinct().where("size(w) > 0")
    items = items.withColumn("len", F.size("w")).withColumn("h", F.expr("transform(w, x -> xxhash64(x))")).withColumn("key", F.xxhash64("item_id", "w"))
    items = stored(items.withColumn("si", F.expr(shingles("w"))), "items")
    sizes = [r["len"] for r in items.select("len").distinct().orderBy("len").collect()]
    if not sizes:
        sizes = [WIDTH]
    # windows are slices of hashes of words or of five-word shingles
    per = {n: min(n, WIDTH) for n in sizes}

    def hashes_of(h: str, width: str) -> str:
        """SQL of the hashes of the shingles of this width in a list of word hashes."""
        each = " ".join(f"WHEN {w} THEN transform(if(size({h}) >= {w}, sequence(0, size({h}) - {w}), array()), i -> {hashed('i', w).replace('h[', h + '[')})" for w in sorted({*per.values()}))
        return f"CASE {width} {each} END"

    own = items.select("len", "key", "item_id", "si", F.explode_outer(F.array(F.expr(hashes_of("h", f"least(len, {WIDTH})")))).alias("sh"))
    known = [r["s"] for r in own.select(F.explode("sh").alias("s")).distinct().toLocalIterator()]
    flags, most = flag_table(known), max(sizes)
    sides = stored(own.select("len", "key", "item_id", "si", F.expr(fingerprint("sh", most)).alias("fi")), "sides")

    # arrays that are referred to more than once come out of a generator, below which nothing that reads them is moved
    text = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.array(words(F.col(text_col)))).alias("w"))
    text = text.select("doc_id", "w", F.explode_outer(F.array(F.expr("transform(w, x -> xxhash64(x))"))).alias("h"))
    found = None

    def flagged(width: int) -> Column:
        """Places of a text where a shingle of the benchmark may begin."""
        places = F.expr(f"if(size(h) >= {width}, sequence(0, size(h) - {width}), array())")
        flag = lambda i: F.substring(F.lit(flags), F.xxhash64(*(F.col("h")[i + k] for k in range(width))).bitwiseAND(F.lit(len(flags) - 1)).cast("int") + 1, F.lit(1))
        return F.filter(places, lambda i: flag(i) == F.lit(bytearray([1])))

    for width in sorted({*per.values()}):
        wide = [n for n in sizes if per[n] == width]
        # explode_outer and filters after it, since a filter on the array's size would compute the array twice
        rows = text.select("doc_id", "w", "h", F.explode_outer(F.array(flagged(width))).alias("qs"))
        # common shingles that a window of n - width + 1 or len - width + 1 shingles must have at least
        need = f"greatest(1, cast(ceil({threshold / (1 + threshold)!r} * (l - {width} + 1 + least(size(w), l) - {width} + 1) - 1e-9) as int))"
        # no window needs fewer than one of the least size, and none is longer than the longest; this spares most texts all sizes
        least = need.replace("l -", f"{min(wide)} -").replace(", l)", f", {min(wide)})")
        dense = f"size(qs) >= {least} AND exists(sequence(0, size(qs) - 1), k -> k + 1 >= {least} AND qs[greatest(k + 1 - {least}, 0)] >= qs[k] - {max(wide)} + {width})"
        ends = f"filter(sequence(0, size(qs) - 1), k -> k + 1 >= {need} AND qs[greatest(k + 1 - {need}, 0)] >= qs[k] - l + {width})"
        starts = f"transform({ends}, k -> shiftleft(cast(l AS bigint), 32) + greatest(qs[k] - l + {width}, 0))"
        windows = f"array_distinct(flatten(transform(array({', '.join(map(str, wide))}), l -> {starts})))"
        rows = rows.select("doc_id", "w", "h", F.explode_outer(F.expr(f"if(size(qs) > 0 AND {dense}, {windows}, array())")).alias("at")).where("at IS NOT NULL")
        rows = rows.select("doc_id", F.expr("cast(shiftright(at, 32) AS int)").alias("len"), F.expr("cast(at & 4294967295L AS int)").alias("start"), "w", "h")
        rows = rows.select("doc_id", "len", "start", F.expr("slice(w, start + 1, len)").alias("window"), F.expr("slice(h, start + 1, len)").alias("wh"))
        found = rows if found is None else found.unionByName(rows)

    found = found.select("doc_id", "len", "start", "window", F.explode_outer(F.array(F.expr(hashes_of("wh", f"least(len, {WIDTH})")))).alias("sh"))
    found = found.select("doc_id", "len", "start", "window", F.explode_outer(F.array(F.expr(fingerprint("sh", most)))).alias("fw"))
    looked_up = found.select("doc_id", F.col("len").alias("n_words"), "start", "window", "fw", F.inline(F.expr(blocks("fw"))))
    table = F.broadcast(index(sides)) if sides.count() * len(masks()) <= SMALL_INDEX else index(sides)
    near = looked_up.withColumn("place", F.expr(place("n_words", "b", "v"))).join(table, "place")
    near = near.withColumn("hamming", F.expr("bit_count(fw ^ fi)")).where(F.col("hamming") <= RADIUS).where(F.expr(first_block("fw", "fi")))
    texts = sides.select(F.col("key").alias("item"), "item_id", "si")
    near = near.select("doc_id", "start", "n_words", "window", "hamming", "item").join(F.broadcast(texts) if len(known) <= SMALL_ITEMS else texts, "item")
    near = near.select("doc_id", "item_id", "start", "n_words", "hamming", "si", F.explode_outer(F.array(F.expr(shingles("window")))).alias("sw"))
    near = near.select("doc_id", "item_id", "start", "n_words", "hamming", "si", "sw", F.explode_outer(F.array(F.expr(f"size(array_intersect({counted('sw')}, {counted('si')}))"))).alias("common"))
    exact = near.withColumn("similarity", F.expr(similarity("sw", "si", "common"))).where(F.col("similarity") >= threshold)
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "n_words", -F.col("hamming"))).alias("m"))
    return best.select("doc_id", "item_id", F.round("m.similarity", 9).alias("similarity"), (-F.col("m.col2")).alias("start_word"), F.col("m.n_words"), (-F.col("m.col4")).alias("hamming"))


def oracle(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """The rows without hamming in DuckDB SQL: all windows of every document and item that share a shingle."""
    split = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]+', ' ', 'g'), ' '), ' ')"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, w FROM (SELECT DISTINCT doc_id, {split} AS w FROM documents) WHERE w <> ['']),
        b AS MATERIALIZED (SELECT row_number() OVER () AS b, item_id, len(w) AS n_words, least(len(w), {width}) AS k, w FROM (SELECT DISTINCT item_id, {split} AS w FROM benchmark) WHERE w <> ['']),
        ds AS MATERIALIZED (SELECT d, doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS s FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
        bs AS MATERIALIZED (SELECT b, item_id, n_words, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS s FROM b),
        hit AS MATERIALIZED (SELECT DISTINCT d, b, k FROM (SELECT d, k, unnest(s) AS x FROM ds) JOIN (SELECT b, k, unnest(s) AS x FROM bs) USING (k, x)),
        win AS (
            SELECT doc_id, item_id, n_words, start_word, bs.s AS item, ds.s[start_word + 1:start_word + len(bs.s)] AS win
            FROM (SELECT d, b, k, unnest(range(0, greatest(len(ds.s) - len(bs.s), 0) + 1)) AS start_word FROM hit JOIN ds USING (d, k) JOIN bs USING (b, k)) JOIN ds USING (d, k) JOIN bs USING (b, k)),
        counted AS (SELECT *, list_sum(list_transform(list_distinct(item), lambda y: least(len(list_filter(item, lambda z: z = y)), len(list_filter(win, lambda z: z = y))))) AS common FROM win),
        sim AS (SELECT doc_id, item_id, n_words, start_word, common / (len(item) + len(win) - common) AS similarity FROM counted)
        SELECT doc_id, item_id, round(similarity, 9) AS similarity, cast(start_word AS int) AS start_word, cast(n_words AS int) AS n_words FROM sim WHERE similarity >= {threshold}
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word, n_words DESC) = 1"""
