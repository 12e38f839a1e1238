"""Delta rounds of Lloyd against its oracle and odd tables."""

import random

import duckdb
import pytest

from prudence.llm.centroids import cluster, oracle

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=lambda r: (r[0] is not None, r))


def table(spark, n, size, seed, spread=1.0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.gauss(i % 5, spread) for _ in range(size)], 0) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("k,rounds,spread", [(4, 10, 1.0), (3, 2, 0.01), (8, 10, 3.0)])
def test_equals_oracle(spark, clash, k, rounds, spread):
    df = table(spark, 200, 6, k, spread)
    duck = duckdb.connect()
    duck.register("embeddings", df.toArrow())
    want = sorted(duck.sql(oracle(k, rounds, 6)).fetchall())
    assert rows(cluster(clash(df), k, rounds, 6)) == want


def test_unsound_vectors_and_nulls(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [1.0], 0), (3, [1.0, None], 0), (4, [1.0, nan], 0), (5, [1.0, -inf], 0), (6, [1.0, 2.0, 3.0], 0), (7, [], 0)]
    assert rows(cluster(spark.createDataFrame(bad, SCHEMA), size=2)) == []
    assert rows(cluster(spark.createDataFrame([], SCHEMA), size=2)) == []
    got = rows(cluster(spark.createDataFrame([*bad, (None, [-0.5, 0.25], 0), (8, [0.5, 0.5], 0), (8, [0.5, 0.5], 0)], SCHEMA), size=2))
    assert [(r[0], r[2], r[4]) for r in got] == [(None, 0, 0), (8, 0, 0), (8, 0, 0)] and got[1][1] == got[2][1]


def test_ties_go_to_the_smaller_number(spark):
    """Both first centroids are equal, so that the second never gets a vector and stays."""
    df = spark.createDataFrame([(1, [1.0, 1.0], 0)] * 5, SCHEMA)
    assert {r[1:5] for r in rows(cluster(df, k=2, size=2))} == {(0, 0, 0, 0)}


def test_overlarge_components_raise(spark):
    with pytest.raises(Exception, match="component"):
        cluster(spark.createDataFrame([(1, [1e30, 0.0], 0)], SCHEMA), size=2)
