"""Queries against their oracle SQL in DuckDB."""

import os

import duckdb
import pytest

from prudence.plans import catalog

DATA = "/root/testdata/sf0.001"
SOME = [
    "normalized_aurc", "risk_coverage_with_zero", "matched_coverage", "threshold_sweep", "nearest_coverage_high", "best_method", "selective_metrics", "claim_validation", "lexical_evidence", "evidence_impact", "verify_impact",
    "hybrid_ablation", "consistency", "calibration_bins", "threshold_search", "rank_flips", "pearson_spearman", "topk_examples", "multi_seed_summary", "windowed_counts", "alpha_grid", "best_alpha", "rank_flip_summary", "nested_sample_sizes", "stratified_split",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in places] for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 60
