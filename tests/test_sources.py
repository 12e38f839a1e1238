import pytest
from pyspark.sql import functions as F

from prudence.operators.validate import InvalidRows
from prudence.sources import tables
from prudence.streaming.counts import windowed_metrics


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    df = tables.with_row_index(tables.read_jsonl(spark, str(path), "id string, n int"))
    assert [(r.row_idx, r.id) for r in df.orderBy("row_idx").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "bad.jsonl").write_text('{"id": "a"\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(InvalidRows):
        tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id string")


def test_reports(spark, tmp_path):
    one = spark.range(1).select(F.lit(0.5).alias("x"), F.struct(F.lit(1).alias("y")).alias("s"))
    tables.write_report(one, str(tmp_path / "r" / "x.json"))
    assert tables.read_report(str(tmp_path / "r" / "x.json")) == {"x": 0.5, "s": {"y": 1}}
    with pytest.raises(InvalidRows):
        tables.write_report(spark.range(2), str(tmp_path / "y.json"))
    assert tables.markdown(one, ["x"]).splitlines()[-1] == "| 0.5 |"
    assert tables.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_prepared_splits(spark, tmp_path):
    rows = [(str(i), "q", "c", (["x"] if i % 2 else [], [0] if i % 2 else [])) for i in range(8)]
    df = spark.createDataFrame(rows, tables.EXAMPLE)
    path = str(tmp_path / "d")
    tables.prepare_examples(df, path)
    test = tables.read_split(spark, path, "test")
    assert sorted(r.label for r in test.collect()) == [0, 0, 1, 1]
    assert tables.read_split(spark, path, "test", limit=1).count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.prepare_examples(df, path)
    assert tables.complete(spark, path, 8) and not tables.complete(spark, path + "x", 8)


def test_curve_checks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("coverage,risk,selective_accuracy,threshold\n1.0,0.5,0.5,0\n0.5,0.2,0.8,0.4\n")
    assert [r.coverage for r in tables.read_curve(spark, str(tmp_path / "c.csv")).collect()] == [0.5, 1.0]


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS ts, 'ANSWER' AS decision, true AS correct UNION ALL SELECT timestamp'2024-01-01 10:50:00', 'ABSTAIN', false UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'ANSWER', false").write.parquet(src)
    stream = windowed_metrics(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r.window_start.hour: r for r in spark.table("counts").collect()}
    assert (rows[10].total, rows[10].answered, rows[10].selective_risk) == (2, 1, 0.0) and rows[11].selective_risk == 1.0
