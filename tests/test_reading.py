"""Contexts are read in one pass: no window leaves its task, and nothing that rows come from is worked out twice."""

import random
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark import cloudpickle

from prudence.operators import inference, reading
from prudence.plans import catalog, models

DATA = "/root/testdata/sf0.001"
SMALL = reading.Spec(max_length=12, stride=2, max_question=4, max_answer=3, top_k=4)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def noise(asked, tokens):
    """Logits from the tokens alone; few values, so that spans tie."""
    out = []
    for window in tokens:
        rng = random.Random(" ".join(window))
        out.append(tuple(np.array([rng.randint(0, 3) / 2 for _ in range(len(window) + 1)]) for _ in range(2)))
    return out


def passes(df):
    """Python stages of a query."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas")


@pytest.fixture(scope="module")
def contexts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice([" ", "\t"]) + rng.choice("alpha beta gamma é x".split()) for _ in range(n)) for n in (0, 1, 5, 9, 40, 300)]
    # two rows share a key; their spans are ranked together
    return spark.createDataFrame([*enumerate(["who is it now"] * 6)], "row_idx long, question string").join(spark.createDataFrame([*enumerate(texts), (4, texts[3])], "row_idx long, context string"), "row_idx")


@pytest.mark.parametrize("name,most", [("qa_n_best", 1), ("qa_forced_answers", 1), ("qa_native_answers", 1), ("qa_span_confidence", 2), ("agreement_verification", 2)])
def test_every_reader_reads_every_context_once(spark, name, most):
    assert models and passes(catalog.QUERIES[name](spark, DATA)) == most


def test_spans_of_one_pass_are_those_of_the_windows(contexts):
    want = reading.n_best(reading.with_spans(reading.windows(contexts, SMALL), lambda: noise, SMALL), SMALL.top_k)
    got = reading.best_spans(contexts, lambda: noise, SMALL)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_few_windows_are_held_however_they_come(spark, monkeypatch):
    """A reader sees windows of many contexts together, but never more than the bound's."""
    monkeypatch.setattr(reading, "MOST", 7)
    df = spark.createDataFrame([(i, "who", "a b c d e f g h i j k l " * (i % 3 + 1)) for i in range(30)], "row_idx long, question string, context string").coalesce(1)

    def load():
        def read(asked, tokens):
            assert len(tokens) <= 7
            return noise(asked, tokens)

        return read

    assert reading.read_spans(df, load, SMALL, batch=100).count() == 30


class Watched:
    """A reader that writes down the most bytes that its task's Python held while it was there."""

    def __init__(self, path):
        self.path = path
        tracemalloc.start()

    def __call__(self, asked, tokens):
        return noise(asked, tokens)

    def __del__(self):
        with open(self.path, "w") as f:
            f.write(str(tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()


def test_a_task_holds_no_more_for_more_contexts(spark, tmp_path):
    def held(n):
        path = str(tmp_path / str(n))
        df = spark.range(0, n, 1, 1).selectExpr("id AS row_idx", "'who is it' AS question", "array_join(transform(sequence(1, 100), i -> concat('w', id * 100 + i)), ' ') AS context")
        assert reading.forced_answers(df, lambda: Watched(path)).where("prediction_text IS NOT NULL").count() == n
        with open(path) as f:
            return int(f.read())

    assert held(1200) < 1.5 * held(300)


def test_second_reader_keeps_the_rows_own_columns(spark):
    df = spark.createDataFrame([(1, "who", "a b", "a", 5, 6, 0.5, "ANSWER")], "row_idx long, question string, context string, prediction_text string, start int, end int, pipeline_score double, decision string")
    out = inference.agreement_verified(df, lambda: noise, SMALL)
    assert out.columns == [*df.columns, "verifier_answer", "verifier_score", "answer_match_f1", "evidence_label", "evidence_reason", "verifier_model"]
    assert tuple(out.select(*df.columns).first()) == tuple(df.first())


def test_claims_are_checked_once_and_only_valid_ones_are_scored(spark):
    df = spark.createDataFrame([(1, "Who developed relativity?", "c", "Albert Einstein"), (2, "Who?", "c", "x"), (3, "Who?", "c", " ")], "row_idx long, question string, context string, prediction_text string")
    claims = {"x": "no", "Albert Einstein": "Albert Einstein developed relativity."}

    def generate():
        return lambda prompts: [(next(c for a, c in claims.items() if p.endswith(a.lower())),) for p in prompts]

    def load():
        def told(premises, hypotheses):
            assert all(h == "Albert Einstein developed relativity." for h in hypotheses)
            return [(0.9, 0.1, 0.0)] * len(hypotheses)

        return told

    out = inference.question_verified(df, load, generate)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("NUMBER_NOT_PRESERVED") == 1
    got = {r.row_idx: (r.qa_claim_valid, r.qa_nli_label, r.qa_entailment_probability) for r in out.collect()}
    assert got == {1: (True, "ENTAILMENT", 0.9), 2: (False, "INVALID_CLAIM", 0.0), 3: (False, "EMPTY_ANSWER", 0.0)}
