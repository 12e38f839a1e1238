"""Reports by grouping sets, and queries of flags, reasons, reports and checks against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from prudence.operators import summaries
from prudence.plans import catalog, checks, reports_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["typed_flags", "claim_reasons", "diagnostic_and_forced", "stored_correctness", "native_baseline_summary", "verified_system_summary", "question_aware_report", "evidence_error_report", "investigation_summary", "check_failures", "near_tie_ranks", "paired_bootstrap", "quantile_candidates", "claim_texts", "inferred_labels", "gain_over_random", "fit_temperature"])
def test_query_equals_oracle(spark, duck, name):
    assert checks and reports_sql
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in places] for r in want.fetchall())


def test_a_report_is_one_scan_of_its_columns(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet").withColumn("n", F.col("event_id") % 3)
    out = summaries.grouped_report(df, {"kind": F.col("event_type"), "third": F.col("n")}, {"count": F.count("*")}, [])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1 and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
    rows = {(r.section, r.value): r["count"] for r in out.collect()}
    total = df.count()
    assert rows["all", None] == total == sum(n for (s, _), n in rows.items() if s == "kind") == sum(n for (s, _), n in rows.items() if s == "third")


def test_null_values_are_a_group_and_empty_tables_have_the_whole_alone(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2), (None, 3)], "k string, v int")
    got = {(r.section, r.value): (r["count"], r.s) for r in summaries.grouped_report(df, {"k": F.col("k")}, {"count": F.count("*"), "s": F.sum("v")}, ["v"]).collect()}
    assert got == {("all", None): (3, 6), ("k", None): (2, 4), ("k", "x"): (1, 2)}
    assert [tuple(r) for r in summaries.grouped_report(df.limit(0), {"k": F.col("k")}, {"count": F.count("*")}, ["v"]).collect()] in ([("all", None, 0)], [])


def test_native_summary_wants_one_description(spark):
    rows = [("ANSWER", True, True, 1.0, 1.0, "a"), ("ABSTAIN", False, True, 0.0, 0.0, "a")]
    df = spark.createDataFrame(rows, "decision string, is_answerable boolean, is_correct boolean, exact_match double, token_f1 double, system string")
    assert {r.subset: (r.total, r.accuracy, r.system) for r in summaries.native_summary(df).collect()} == {"all": (2, 1.0, "a"), "answerable": (1, 1.0, "a"), "unanswerable": (1, 1.0, "a")}
    with pytest.raises(Exception, match="several values of system"):
        summaries.native_summary(df.withColumn("system", F.col("decision"))).collect()
