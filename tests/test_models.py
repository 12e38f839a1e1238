"""Model stages: windows and spans against brute force, label order, batches by length, drivers, and queries against their SQL."""

import math
import os
import random
import sys

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from prudence.operators import entailment, inference, reading
from prudence.plans import catalog, models
from prudence.plans import surrogate as S

DATA = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def noise(asked, tokens):
    """Logits from the tokens alone, so that brute force can repeat them; few values, so that spans tie."""
    out = []
    for _, window in zip(asked, tokens, strict=True):
        rng = random.Random(" ".join(window))
        out.append((np.array([rng.randint(0, 3) / 2 for _ in range(len(window) + 1)]), np.array([rng.randint(0, 3) / 2 for _ in range(len(window) + 1)])))
    return out


def brute(question, context, spec, with_null):
    """Every span of every window, best first, and the least score of no answer."""
    asked, places = question.split()[: spec.max_question], reading.words(context)
    room = spec.max_length - len(asked) - spec.marks
    found, none, at, w = [], math.inf, 0, 0
    while True:
        part = places[at : at + room]
        (s, e), *_ = noise([asked], [[context[a:b] for a, b in part]])
        own = range(0 if with_null else 1, len(s))
        zs, ze = (math.log(sum(math.exp(x[i]) for i in own)) if own else 0.0 for x in (s, e))
        none = min(none, s[0] - zs + e[0] - ze)
        found += [(-round(s[i + 1] - zs + e[j + 1] - ze, 9), w, i, j, part[i][0], part[j][1]) for i in range(len(part)) for j in range(i, min(i + spec.max_answer, len(part)))]
        if at + room >= len(places):
            return sorted(found), round(none, 9)
        at, w = at + room - spec.stride, w + 1


@pytest.fixture(scope="module")
def contexts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "  ", "\n"]) + rng.choice("alpha beta gamma delta é 12 x".split()) for _ in range(n)) for n in (0, 1, 4, 5, 9, 23, 60)]
    return spark.createDataFrame([(i, "who is it now", t, "x") for i, t in enumerate(texts)] + [(7, None, None, None)], "row_idx long, question string, context string, place string")


SMALL = reading.Spec(max_length=12, stride=2, max_question=4, max_answer=3, top_k=4)


def test_windows_cover_and_overlap(contexts):
    for n in range(40):
        cuts = SMALL.cuts(n, 4)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(b - a <= 5 for a, b in cuts)
        assert all(b1 - a2 == 2 for (_, b1), (a2, _) in zip(cuts, cuts[1:], strict=False))
    with pytest.raises(ValueError):
        reading.Spec(max_length=10, stride=3).cuts(9, 4)
    for r in reading.windows(contexts, SMALL).collect():
        assert all(a < b for a, b in zip(r.begins, r.ends, strict=True)) and len(r.tokens) == len(r.begins)


def test_merge_of_windows_is_brute_force(contexts):
    rows = contexts.collect()
    read = reading.with_spans(reading.windows(contexts, SMALL), lambda: noise, SMALL)
    got = reading.n_best(read, SMALL.top_k).orderBy("row_idx", "place").collect()
    want = [(r.row_idx, k, *x) for r in rows for k, x in enumerate(brute(r.question or "", r.context or "", SMALL, False)[0][:4], 1)]
    assert [(r.row_idx, r.place, -r.log_score, r.window, r.first, r.last, r.start, r.end) for r in got] == want


def test_forced_and_native_answers(contexts):
    rows = {r.row_idx: r for r in contexts.collect()}
    for r in reading.forced_answers(contexts, lambda: noise, SMALL, strict=False).collect():
        found = brute(rows[r.row_idx].question or "", rows[r.row_idx].context or "", SMALL, False)[0]
        assert r.place == rows[r.row_idx].place and (r.prediction_text, r.start) == ((rows[r.row_idx].context[found[0][4] : found[0][5]], found[0][4]) if found else (None, None))
    for r in reading.native_answers(contexts, lambda: noise, SMALL).collect():
        found, none = brute(rows[r.row_idx].question or "", rows[r.row_idx].context or "", SMALL, True)
        answers = bool(found) and -found[0][0] >= none
        assert r.decision == ("ANSWER" if answers else "ABSTAIN") and r.pipeline_score == pytest.approx(math.exp(-found[0][0] if answers else none))
    with pytest.raises(Exception, match="no usable candidate"):
        reading.forced_answers(contexts, lambda: noise, SMALL).collect()


def test_confidence_of_a_span(spark, contexts):
    long = contexts.where("row_idx = 6").first()
    places = reading.words(long.context)
    room = 12 - 4 - 3
    df = spark.createDataFrame([(k, "who is it now", long.context, *places[k]) for k in range(len(places))], "row_idx long, question string, context string, start int, end int")
    for r in reading.span_confidence(df, lambda: noise, SMALL).collect():
        holding, none = [], math.inf
        for w, (a, b) in enumerate(SMALL.cuts(len(places), 4)):
            (s, e), *_ = noise([[]], [[long.context[x:y] for x, y in places[a:b]]])
            none = min(none, s[0] + e[0])
            if a <= r.row_idx < b:
                holding.append((-(s[r.row_idx - a + 1] + e[r.row_idx - a + 1]), w, r.row_idx - a + 6))
        assert (-r.answer_span_logit, r.confidence_chunk, r.confidence_token_span[0]) == min(holding) and r.null_logit == none and room == 5
    with pytest.raises(Exception, match="no window holds"):
        reading.span_confidence(df.withColumn("start", F.lit(10_000)), lambda: noise, SMALL).collect()


def test_n_best_is_limited_before_rows_move(contexts):
    plan = reading.n_best(reading.with_spans(reading.windows(contexts, SMALL), lambda: noise, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_labels_are_resolved_by_name():
    assert entailment.label_ids({0: "CONTRADICTION", 1: " Neutral ", 2: "entailment"}) == [2, 1, 0]
    assert entailment.label_ids({"2": "is_entailed", "0": "contradicts", "1": "NEUTRAL"}) == [2, 1, 0]
    assert entailment.label_ids({0: "Entailment", 1: "neutral", 2: "contradiction"}, exact=True) == [0, 1, 2]
    for labels, exact in (({0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"}, False), ({0: "entailment", 1: "neutral"}, False), ({0: "entailed", 1: "neutral", 2: "contradiction"}, True)):
        with pytest.raises(ValueError, match="no label for"):
            entailment.label_ids(labels, exact)


def test_batches_are_of_like_length(spark):
    """Whatever the order of rows, no batch mixes long and short; results return to their rows."""
    seen = list(entailment.by_length([1, 90, 2, 80, 3, 70], 2))
    assert [sorted(x.tolist()) for x in seen] == [[1, 3], [4, 5], [0, 2]]
    with pytest.raises(ValueError):
        list(entailment.by_length([1], 0))

    def load():
        def logits(premises, claims):
            return np.array([[len(p), 0, len(c)] for p, c in zip(premises, claims, strict=True)])

        return entailment.EntailmentModel({0: "neutral", 1: "contradiction", 2: "entailment"}, logits)

    df = spark.createDataFrame([(i, "p" * (i % 7), "c" * (i % 3)) for i in range(50)], "i int, p string, c string")
    for r in entailment.with_entailment(df, load, "p", "c", ("e", "n", "k"), batch=4).collect():
        x = np.exp([r.i % 3, r.i % 7, 0])
        assert [r.e, r.n, r.k] == pytest.approx(list(x / x.sum()))


def fixed(e, n, c):
    return lambda: entailment.EntailmentModel({0: "entailment", 1: "neutral", 2: "contradiction"}, lambda p, h: np.log([[e, n, c]] * len(p)))


def rows(spark, *answers):
    return spark.createDataFrame([(i, "Who developed relativity?", "Albert Einstein developed the theory.", a) for i, a in enumerate(answers)], "row_idx long, question string, context string, prediction_text string")


def test_self_driver(spark):
    good, none = inference.self_verified(rows(spark, "Albert Einstein", " "), fixed(0.95, 0.03, 0.02)).orderBy("row_idx").collect()
    assert good.self_verification_label == "SUPPORTED" and good.self_verification_claim == 'The answer to the question "Who developed relativity?" is "Albert Einstein".'
    assert (none.self_verification_label, none.self_verification_score, none.self_contradiction_probability, none.self_verification_claim) == ("REJECTED", -1.0, 1.0, None)


def test_v1_driver(spark):
    tie, none = inference.question_verified_v1(rows(spark, "Einstein", None), fixed(0.4, 0.2, 0.4), model="m", generator="g").orderBy("row_idx").collect()
    assert (tie.qa_nli_label, tie.qa_nli_model, tie.qa_claim_generator_model, tie.qa_claim_answer) == ("CONTRADICTION", "m", "g", "Einstein") and tie.qa_nli_confidence == pytest.approx(0.4)
    assert (none.qa_nli_label, none.qa_nli_confidence, none.qa_neutral_probability, none.qa_claim) == ("EMPTY_ANSWER", 1.0, 1.0, None)
    made = inference.question_verified_v1(rows(spark, "Einstein"), fixed(0.9, 0.05, 0.05), generate=lambda: lambda prompts: [(f"claim: {p.upper()}",) for p in prompts]).first()
    assert made.qa_nli_label == "ENTAILMENT" and made.qa_claim.endswith(".") and not made.qa_claim.lower().startswith("claim:")
    with pytest.raises(ValueError):
        inference.question_verified_v1(rows(spark, "x"), entailed=1.1)


def test_semantic_driver(spark):
    df = rows(spark, "Einstein", "Einstein").withColumn("evidence_text", F.when(F.col("row_idx") == 0, "no").otherwise(" "))
    lengths = lambda: entailment.EntailmentModel({2: "ENTAILMENT", 1: "NEUTRAL", 0: "CONTRADICTION"}, lambda p, h: np.array([[0, 0, len(x) - 10] for x in p]))
    short, full = inference.semantically_verified(df, lengths, model="m").orderBy("row_idx").collect()
    assert (short.semantic_label, full.semantic_label, full.semantic_verifier_model) == ("NEUTRAL", "ENTAILMENT", "m") and full.semantic_confidence == full.entailment_probability
    with pytest.raises(Exception, match="no answer"):
        inference.semantically_verified(rows(spark, ""), lengths).collect()


@pytest.mark.parametrize("answer,other,score,label", [("James Watt", "James Watt", 0.95, "SUPPORTED"), ("James Watt", "Albert Einstein", 0.95, "UNSUPPORTED"), ("James Watt", "", 0.9, "UNSUPPORTED"), ("James Watt", "", 0.2, "UNCERTAIN")])
def test_agreement_driver(spark, answer, other, score, label):
    """The second reader's only choice is between one span and no answer, with the score asked for."""
    context = other or "nothing"

    def load():
        def read(asked, tokens):
            big, out = 30.0, []
            for t in tokens:
                s, e = np.full(len(t) + 1, -big), np.full(len(t) + 1, -big)
                p = math.sqrt(score)
                s[1], e[len(t)] = math.log(p), math.log(p)
                s[0] = e[0] = math.log(1 - p)
                out.append((s, e) if other else (np.concatenate([[math.log(p)], np.full(len(t), -big)]), np.concatenate([[math.log(p)], np.full(len(t), -big)])))
                if not other and score < 0.5:
                    out[-1] = (np.array([0.0, 0.0, *[-big] * (len(t) - 1)]) , np.array([1e-3, 0.0, *[-big] * (len(t) - 1)]))
            return out

        return read

    df = spark.createDataFrame([(1, "who", context, answer)], "row_idx long, question string, context string, prediction_text string")
    r = inference.agreement_verified(df, load, model="second").first()
    assert r.verifier_model == "second" and r.verifier_answer == other
    if other or score > 0.5:
        assert r.evidence_label == label
    else:
        assert r.evidence_label == ("UNCERTAIN" if r.verifier_score < 0.5 else "UNSUPPORTED")


@pytest.mark.parametrize("name", ["qa_n_best", "qa_forced_answers", "qa_native_answers", "qa_span_confidence", "stub_inference", "question_verification", "question_verification_v1", "semantic_verification", "agreement_verification"])
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for f in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {f} AS SELECT * FROM read_parquet('{DATA}/{f}.parquet')")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns and models and os.path.isdir(DATA) and S
    places = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in places] for r in want.fetchall())
