"""The pipeline against its stages done by hand on a small table."""

import corpus_pipeline as P


def test_pipeline(spark, tmp_path, clash):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "le", "ni", "po", "du", "xe", "gro")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    long, item = text(120), text(20)
    near = long.split()
    near[50] = "changed"
    rows = [(i, text(60), "aa", "s", 1) for i in range(1, 40)]
    rows += [(50, long, "aa", "s", 1), (51, long.upper(), "aa", "s", 1), (52, " ".join(near), "aa", "s", 1), (60, text(30) + " " + item + " " + text(30), "aa", "s", 1), (70, "123 456 !!", "aa", "s", 1), (71, None, None, None, None), (80, text(5000), "aa", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES:
        out = P.stored(stage(spark, docs, str(tmp_path)), name)
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    every = {r[0] for r in rows}
    assert seen == [every - {70, 71}, every - {70, 71, 50}, every - {70, 71, 50, 52}, every - {70, 71, 50, 52, 60}, every - {70, 71, 50, 52, 60}]
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == seen[-1]


def test_contaminated_texts_go_whatever_their_id(spark, tmp_path, clash):
    """A null id, and an id that another text shares; clashing columns stay. Empty tables pass."""
    item = " ".join(f"word{i}" for i in range(20))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, f"before {item} after", "aa", "s", 1), (None, "clean text of no item", "aa", "s", 1), (5, f"{item} too", "aa", "s", 1), (5, "another clean text", "aa", "s", 1), (6, None, None, None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clash(spark.createDataFrame(rows, schema))
    out = P.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(str(r.text) for r in out.collect()) == ["None", "another clean text", "clean text of no item"]
    assert P.decontamination(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []
