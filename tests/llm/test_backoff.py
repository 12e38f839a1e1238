"""Katz backoff against its oracle, and that probabilities add up to one."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from prudence.llm import backoff
from prudence.llm.blobs import joined, packed, parted, unpacked

SCHEMA = "doc_id long, text string, lang string"


def compare(spark, df, extra=lambda x: x):
    duck = duckdb.connect()
    duck.register("documents", df.toArrow())
    key = lambda r: (r[0] is not None, r[0], r[6])
    got = sorted((tuple(r) for r in backoff.score_texts(extra(df)).collect()), key=key)
    want = sorted(duck.sql(backoff.oracle(12)).fetchall(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    return got


def first_words(train, words):
    """log10 of each word's probability at the start of a text, by the formulas, from plain dictionaries."""
    tokens = [[*t.lower().split(), ""] for _, t, _ in train]
    single, pairs = Counter(w for t in tokens for w in t), Counter((v, w) for t in tokens for v, w in zip([None, *t], t, strict=False))
    of = lambda c: [sum(x == r for x in c.values()) for r in range(1, backoff.KATZ + 2)]
    one, d = backoff.Unigrams(sum(single.values()), len(single), of(single)), backoff.discounts(of(pairs))
    lower = lambda w: float(one.probability(np.array([single[w]]))[0])
    seen = {w: c for (v, w), c in pairs.items() if v is None}
    keep = lambda c: c * (d[c - 1] if c <= backoff.KATZ else 1)
    left = sum(c - keep(c) for c in seen.values())
    whole, left = (len(train), left) if left else (len(train) + 1, 1)
    return {w: np.log10(keep(seen[w]) / whole if w in seen else left / whole / (1 - sum(map(lower, seen))) * lower(w)) for w in words}


def documents(spark, n, seed, words=40):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % words}"
    rows = [(i, "".join(rng.choice([" ", "  ", "\t", "\n"]) + rng.choice([word(), word().upper()]) for _ in range(rng.randint(0, 30))), "x") for i in range(n)]
    return rows


@pytest.mark.parametrize("part_tokens", [3_000_000, 50])
def test_equals_oracle(spark, clash, monkeypatch, part_tokens):
    """With parts of 50 tokens most histories are dealt over several parts."""
    monkeypatch.setattr(backoff, "PART_TOKENS", part_tokens)
    rows = [*documents(spark, 120, 7), (None, "w1 w2", "x"), (2, None, "x"), (3, "", "x"), (3, " \n", "x"), (5, "É é w1 W1 x", "x"), (5, "É é w1 W1 x", "x")]
    compare(spark, spark.createDataFrame(rows, SCHEMA), clash)


def test_common_continuations_only(spark, monkeypatch):
    """Histories whose counts are all over KATZ keep them whole, dealt ones too."""
    monkeypatch.setattr(backoff, "PART_TOKENS", 20)
    rows = [(i, "a b a b a c", "x") for i in range(40)] + [(1000 + i, "a a z b b q a", "x") for i in range(30)]
    compare(spark, spark.createDataFrame(rows, SCHEMA))


def test_nothing_to_learn_from(spark):
    assert backoff.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert tuple(backoff.score_texts(spark.createDataFrame([(held, "a b", "x")], SCHEMA)).first()) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_probabilities_add_up_to_one(spark):
    """After each history, over every known word, the end and one unknown word, read off texts that differ in one word."""
    train = [r for r in documents(spark, 150, 3, 12) if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    known = sorted({w for _, t, _ in train for w in t.lower().split()})
    ids = [i for i in range(10_000, 30_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    for history in (known[0], known[-1], "nowhere"):
        # p(start h w END) of texts h w, and of texts h w w w: p(w | w) p(w | w) more, so p(END | w) can be told from h w w
        texts = {w: f"{history} {w}" for w in [*known, "unheard"]} | {"": history}
        ends = {f"end {w}": w for w in texts if w}
        starts = {f"two {w}": f"{w} {w}" for w in ends.values()}
        every = dict(zip(ids, [*texts.values(), *ends.values(), *starts.values(), ""], strict=False))
        score = {every[r["doc_id"]]: r["score"] for r in backoff.score_texts(spark.createDataFrame([*train, *((i, t, "x") for i, t in every.items())], SCHEMA)).collect() if r["held_out"]}
        first = first_words(train, [*known, "unheard", history])
        end = {w: score[w] - first[w] for w in [*known, "unheard", history]}  # log p(END | w)
        after = [score[f"{history} {w}"] - first[history] - end[w] for w in [*known, "unheard"]] + [end[history]]
        assert abs(sum(10**x for x in after) - 1) < 1e-9


def test_discounts():
    d = backoff.discounts([1000, 300, 120, 60, 40, 30])
    assert all(0 < x < 1 for x in d) and list(d) == sorted(d)
    assert all(0 < x < 1 for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [0, 5, 0, 0, 1, 9], [1, 9, 1, 9, 1, 9], [3, 3, 3, 3, 3, 3]) for x in backoff.discounts(n))


def test_blobs():
    for x in (np.array([], np.int64), np.array([0, 255, 70_000]), np.array([1.5, -2.0]), np.array([True, False])):
        np.testing.assert_array_equal(unpacked(packed(x)), x)
    assert parted(joined(["", "a", "é"])) == ["", "a", "é"]
