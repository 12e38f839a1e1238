"""Row numbers, checks that ride on a pass, and runs that resume."""

import itertools

import pytest
from pyspark.sql import functions as F

from prudence.operators import validate
from prudence.sources import stages, tables


def test_row_numbers_follow_the_files(spark, tmp_path):
    """Files of several splits, read in whatever order; no Python worker in the plan."""
    for k, n in ((2, 5), (0, 4000), (1, 300)):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(f'{{"k": {k}, "i": {i}}}\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = tables.with_row_index(tables.read_jsonl(spark, str(tmp_path), "k int, i int"))
        rows = sorted((r.row_idx, r.k, r.i) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows] == list(range(4305)) and [r[1:] for r in rows] == [(k, i) for k, n in ((0, 4000), (1, 300), (2, 5)) for i in range(n)]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_row_numbers_by_columns(spark):
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("x"))
    rows = sorted((r.row_idx, r.x) for r in tables.with_row_index(df, ["x"]).collect())
    assert rows == list(enumerate(sorted(r.x for r in df.collect())))


def test_positional_join(spark, tmp_path):
    for name, n in (("a", 50), ("b", 50), ("c", 49)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"{name}": {i}}}\n' for i in range(n)))
    a, b, c = (tables.read_jsonl(spark, str(tmp_path / f"{n}.jsonl"), f"{n} int") for n in "abc")
    assert all(r.a == r.b == r.row_idx for r in tables.positional_join(a, b).collect())
    with pytest.raises(Exception, match="different numbers"):
        tables.positional_join(a, c).collect()


GROUPS = itertools.count()


def jobs(spark, action):
    """What the action gives, and how many Spark jobs it runs."""
    sc, group = spark.sparkContext, f"counted-{next(GROUPS)}"
    sc.setJobGroup(group, group)
    try:
        return action(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_checks_ride_on_the_write(spark, tmp_path):
    df = spark.range(100).select((F.col("id") / 100).alias("p"))
    plain = jobs(spark, lambda: df.write.parquet(str(tmp_path / "plain")))[1]
    assert jobs(spark, lambda: validate.write_checked(df, str(tmp_path / "good"), validate.probability("p"))) == (100, plain)
    with pytest.raises(validate.InvalidRows, match="p between 0 and 1: 49 rows"):
        validate.write_checked(df.withColumn("p", F.col("p") * 2), str(tmp_path / "bad"), validate.probability("p"))
    assert not (tmp_path / "bad").exists() and (tmp_path / "good").exists()
    with pytest.raises(validate.InvalidRows, match="no rows"):
        validate.write_checked(df.where("p > 9"), str(tmp_path / "none"), validate.probability("p"))


def test_a_killed_run_resumes_at_its_stage(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    spark.range(10).write.parquet(source)

    def run(fail: bool = False, factor: int = 2):
        r = stages.Run(spark, folder)
        docs = spark.read.parquet(source)
        a = r.stage("doubled", lambda: docs.select((F.col("id") * factor).alias("x")), [docs], {"factor": factor})

        def second():
            return a.select(F.when(F.lit(fail), F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("x") + 1).alias("y"))

        out = r.stage("raised", second, ["doubled"])
        return r, sorted(x.y for x in out.collect())

    with pytest.raises(Exception, match="killed"):
        run(fail=True)
    r, rows = run()
    assert r.computed == ["raised"] and rows == [2 * i + 1 for i in range(10)]
    assert run()[0].computed == []
    r, rows = run(factor=3)
    assert r.computed == ["doubled", "raised"] and rows == [3 * i + 1 for i in range(10)]
    spark.range(12).write.mode("overwrite").parquet(source)
    r, rows = run(factor=3)
    assert r.computed == ["doubled", "raised"] and len(rows) == 12
    assert r.manifest("raised")["rows"] == 12
    r.finish(["raised"])
    assert r.manifest("doubled") is None and r.manifest("raised") is not None
