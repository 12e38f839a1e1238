import hashlib
import random

import pytest

from prudence.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string"


def normal(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (5, 2), (64, 8)])
def test_equals_brute_force(spark, runs, fan_in):
    rng = random.Random(1)
    texts = ["Abc", "aBC", "É", "é", "", None, "x" * 100_000, "abc ", "ABC"] + ["hot"] * 30
    rows = [(i, rng.choice(texts)) for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, SCHEMA), runs=runs, fan_in=fan_in).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    for i, t in rows:
        g = groups[normal(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), i == max(g))
        assert r.text_sha256 == hashlib.sha256(normal(t).encode()).hexdigest()


def test_hot_groups_are_joined_alike(spark):
    rows = [(i, "same" if i % 3 else str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(exact_dedup(df).collect())
    import prudence.llm.exact_dedup as m

    assert plain == sorted(exact_dedup(df, hot_groups=1).collect()) and m.merged_runs(m.digests(df)).where("group_size > 1").count() == 1


def test_edges(spark, clash):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0
    df = clash(spark.createDataFrame([(None, "a"), (None, "b"), (3, "a"), (3, "a"), (4, "c"), (4, "d")], SCHEMA))
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "b"), (3, "a"), (4, "c"), (4, "d")]
    assert {r.keep_id for r in exact_dedup(df, keep="smallest").where("text_sha256 = sha2('a', 256)").collect()} == {3}
