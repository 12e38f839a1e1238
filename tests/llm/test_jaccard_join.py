import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prudence.llm import jaccard_join as J

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    reps = sorted(rep.values())
    near = {a: [b for b in reps if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in reps}
    least = {}
    for a in reps:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least[a] = min(seen)
    return {i: (rep[s], least[rep[s]], len(near[rep[s]]), len(s)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    out = []
    common = rng.choices(vocab, k=40)
    for g in range(25):
        base = rng.choices(vocab, k=rng.randint(30, 150))
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if g % 3 == 0:
                w = common + w
            out.append(" ".join(w))
    out += ["", None, "...", "one two", "One, two!", "x " * 20_000]
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def check(spark, rows, clash):
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links, r.n_shingles) for r in J.similar_documents(clash(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def test_equals_brute_force(spark, rows, clash):
    check(spark, rows, clash)


def test_split_buckets_and_blocks_give_the_same(spark, rows, clash, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "FEW", 0)
    check(spark, rows, clash)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], SCHEMA)
    got = sorted((r.doc_id, r.rep_id, r.class_id, r.n_links) for r in J.similar_documents(df).collect())
    assert got == [(1, 1, 1, 0), (2, 1, 1, 0), (3, 3, 3, 0)]
    assert J.similar_documents(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert J.runs_for(0.99999) == 12


def test_split_pairs_need_no_consecutive_functions(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 4)
    shared = {0: 1, 2: 2, 4: 3}
    sets = spark.createDataFrame([(i, 50, [(k, shared.get(k, 1000 * (i + 1) + k)) for k in range(12)]) for i in range(10)], "doc_id long, n long, taken array<struct<run: int, token: bigint>>")
    met = {}
    for r in J.buckets(sets, 12, 12).collect():
        met.setdefault(r.bucket, set()).add(r.doc_id)
    assert set(range(10)) in met.values()


def test_functions_reach_the_recall_for_split_buckets():
    n, p = J.functions_for(0.99999, 12), 1 - 1 / math.e
    rng = random.Random(3)
    fewer = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(J.DEPTH))
    assert (1 - p) ** 12 < (1 - p) ** 12 + fewer <= 1e-5
    agreed = [[rng.random() < p for _ in range(n)] for _ in range(20_000)]
    assert sum(sum(a) < J.DEPTH or not any(a[:12]) for a in agreed) <= 3


def sketched(sets):
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return [x.tobytes() for x in J.sketches(row, np.concatenate([np.sort(x) for x in sets]), len(sets))]


def test_sketches_keep_pairs_at_the_threshold():
    rng, agreeing = np.random.default_rng(4), J.least_agreeing(0.8)
    far = 0
    for n in (6, 20, 90, 400, 3000):
        for _ in range(200):
            common = rng.integers(0, 2**63, round(n * 0.8), np.uint64)
            rest = rng.integers(0, 2**63, n - len(common), np.uint64)
            other = rng.integers(0, 2**63, n, np.uint64)
            spread = lambda x: J.mixed(x * np.uint64(2) + np.uint64(1))
            pair = [spread(np.concatenate([common, rest])), spread(common), spread(other)]
            group = [{"bucket": 9, "side": 2, "n": len(p), "numbers": [9], "sketch": x} for p, x in zip(pair, sketched(pair), strict=True)]
            assert J.hopeful_few(group[:2], agreeing, 0.8) == J.hopeful_many(group[:2], agreeing, 0.8) == [0, 1]
            far += bool(J.hopeful_few([group[0], group[2]], agreeing, 0.8))
    assert far < 100


def test_a_pair_stays_in_the_first_of_its_buckets():
    agreeing = J.least_agreeing(0.8)
    (sketch,) = sketched([J.mixed(np.arange(1, 100, dtype=np.uint64))])

    def left(sizes, numbers, sides=None):
        group = [{"bucket": 9, "side": side, "n": n, "numbers": sorted([*x, 9]), "sketch": sketch} for n, x, side in zip(sizes, numbers, sides or [2] * len(sizes), strict=True)]
        few, many = J.hopeful_few(group, agreeing, 0.8), J.hopeful_many(group, agreeing, 0.8)
        assert few == many
        return few

    assert left([10, 9], [[], []]) == [0, 1] and left([10, 7], [[], []]) == []
    assert left([10, 10], [[3], [3]]) == [] and left([10, 10], [[3], [11]]) == [0, 1] and left([10, 10], [[11], [11]]) == [0, 1]
    assert left([10, 10, 10], [[3], [3], []]) == [0, 1, 2] and left([10, 10, 10], [[], [], []], [0, 0, 1]) == [0, 1, 2]
    assert left([10, 10], [[], []], [0, 0]) == []


def test_measured_recall_where_all_buckets_are_split(spark, monkeypatch):
    """Pairs just above the threshold among texts with one long passage in common, so that every bucket is split: nearly all links are found."""
    monkeypatch.setattr(J, "SMALL", 6)
    rng = random.Random(17)
    vocab = [f"u{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=45)
    rows = []
    for g in range(150):
        own = rng.choices(vocab, k=60)
        for k in range(2):
            rows.append((2 * g + k, " ".join([*own[k * 6 :], *passage])))
    want = sum(x[2] for x in brute(rows).values())
    got = sum(r.n_links for r in J.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())
    assert want >= 200 and 0.99 * want <= got <= want


@pytest.mark.parametrize("kind", ["int", "string", "decimal(12,0)", "smallint"])
def test_ids_of_any_kind(spark, kind):
    rows = [(i, " ".join(f"w{(k * (1 + i // 2)) % 97}" for k in range(60)) + " end" * (i % 2)) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: (r.class_id, r.n_links) for r in J.similar_documents(df).collect()}
    got = J.similar_documents(df.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert dict(got.dtypes)["doc_id"] == kind and {int(r.doc_id): (int(r.class_id), r.n_links) for r in got.collect()} == want
    assert any(n for _, n in want.values())
