"""Operators on small tables with known results."""

import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prudence.functions.values import signed_to_unit
from prudence.operators import calibration, correctness, diagnostics, inference, labels, lookup, metrics, ranking, ranks, resample, validate


def predictions(spark, rows):
    return spark.createDataFrame(rows, "decision string, is_answerable boolean, prediction_text string, reference_answers array<string>")


def test_selective_metrics(spark):
    df = predictions(spark, [("ANSWER", True, "Paris", ["paris"]), ("ANSWER", False, "x", []), ("ABSTAIN", True, "", ["y"]), ("ABSTAIN", False, "", [])])
    m = metrics.selective_metrics(correctness.task_correctness(df)).first()
    assert (m.total, m.answered, m.abstained, m.total_correct) == (4, 2, 2, 2)
    assert (m.accuracy, m.coverage, m.selective_risk, m.unnecessary_abstentions, m.correct_abstentions) == (0.5, 0.5, 0.5, 1, 1)
    validate.metric_invariants(metrics.selective_metrics(correctness.task_correctness(df)))


def test_all_abstained_gives_zero(spark):
    m = metrics.selective_metrics(correctness.task_correctness(predictions(spark, [("ABSTAIN", True, "", ["y"])]))).first()
    assert (m.coverage, m.answered_accuracy, m.selective_risk) == (0.0, 0.0, 0.0)


def test_unknown_decision_raises(spark):
    with pytest.raises(Exception, match="unknown decision"):
        correctness.task_correctness(predictions(spark, [("VERIFY", True, "", ["y"])])).collect()


def test_inferred_correctness(spark):
    df = predictions(spark, [("ABSTAIN", False, "x", []), ("ANSWER", False, ".", []), (None, False, " ", []), (None, False, ".", []), ("ANSWER", True, "The X", ["x", "the"])])
    got = [r.c for r in df.select(correctness.inferred_correctness(F.col("prediction_text"), F.col("reference_answers"), F.col("is_answerable"), F.col("decision")).alias("c")).collect()]
    assert got == [True, False, True, False, True]
    with pytest.raises(Exception, match="answerable without"):
        predictions(spark, [("ANSWER", True, "x", ["the"])]).select(correctness.inferred_correctness(F.col("prediction_text"), F.col("reference_answers"), F.col("is_answerable"))).collect()


def test_first_candidate(spark):
    df = spark.createDataFrame([([(" ", 0.9, 0, 1), ("gravity", 0.2, 14, 21)],)], "c array<struct<answer:string,score:double,start:int,end:int>>")
    assert df.select(correctness.first_candidate(F.col("c")).alias("x")).first().x.answer == "gravity"


def test_rank_order_with_ties(spark):
    df = spark.createDataFrame([("m", i, s, True) for i, s in enumerate([0.7, 0.9, 0.9, 0.4])], "method string, row_idx int, score double, correct boolean")
    got = ranking.ranked(df).orderBy("answered").collect()
    assert [r.row_idx for r in got] == [1, 2, 0, 3]
    assert spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "s double").select(signed_to_unit(F.col("s")).alias("u")).collect()[1].u == 0.5


@pytest.mark.parametrize("tie_rows", [3, 100_000])
def test_curve_equals_brute_force(spark, tie_rows):
    rng = random.Random(5)
    rows = [(m, i, rng.choice([0.0, 0.25, 0.5, 0.5, 0.75, 1.0, rng.random()]), rng.random() < 0.4) for m in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "method string, row_idx long, score double, correct boolean")
    got = {(r.method, r.row_idx): (r.answered, r.correct_answered) for r in ranking.ranked(df, tie_rows=tie_rows).collect()}
    for m in "ab":
        right = 0
        for k, (_, i, _, c) in enumerate(sorted((r for r in rows if r[0] == m), key=lambda r: (-r[2], r[1])), 1):
            right += c
            assert got[m, i] == (k, right)


def test_aurc_summary(spark):
    n, right = 300, 120
    df = spark.createDataFrame([("m", i, 1 - i / n, i < right) for i in range(n)], "method string, row_idx long, score double, correct boolean")
    r = ranking.aurc_summary(df).first()
    best = sum((k - right) / k for k in range(right + 1, n + 1)) / n
    assert r.aurc == pytest.approx(best, abs=1e-12) and r.optimal_aurc == pytest.approx(best, abs=1e-12) and r.normalized_aurc == pytest.approx(0, abs=1e-9)
    one = ranking.aurc_summary(df.withColumn("correct", F.lit(True))).first()
    assert one.normalized_aurc is None and one.aurc == 0


def test_scores_out_of_range_raise(spark):
    for bad in (float("nan"), 1.5, float("inf")):
        with pytest.raises(Exception, match="scores must lie"):
            ranking.ranked(spark.createDataFrame([("m", 0, bad, True)], "method string, row_idx int, score double, correct boolean")).collect()


def test_matched_coverage_ceil_is_in_doubles(spark):
    df = spark.createDataFrame([("m", i, i / 100, True) for i in range(100)], "method string, row_idx int, score double, correct boolean")
    assert ranking.matched_coverage(df, [0.07]).first().answered == math.ceil(0.07 * 100) == 8


def test_nearest_lookups_break_ties_apart(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.25, 0.3), (0.75, 0.1)], "coverage double, risk double")
    assert ranking.nearest_coverage(df, [0.5], larger_on_tie=False).first().coverage == 0.25
    assert ranking.nearest_coverage(df, [0.5], larger_on_tie=True).first().coverage == 0.75


def test_harmonic_numbers(spark):
    got = spark.range(0, 400).select("id", ranking.harmonic(F.col("id")).alias("h")).collect()
    for r in got:
        assert r.h == pytest.approx(sum(1 / k for k in range(1, r.id + 1)), abs=1e-12)


def test_bins_put_three_tenths_low(spark):
    df = spark.createDataFrame([(0.3,), (0.0,), (1.0,), (0.9999,)], "c double")
    rows = df.select(calibration.linspace_bin(F.col("c")).alias("a"), calibration.scaled_bin(F.col("c")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(2, 3), (0, 0), (9, 9), (9, 9)]


def test_calibration_of_empty_bins(spark):
    df = spark.createDataFrame([(0.95, True), (0.91, False)], "confidence double, correct boolean")
    bins = calibration.calibration_bins(df).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [0] * 9 + [2] and bins[0].gap is None
    r = calibration.calibration_report(df).first()
    assert r.ece == pytest.approx(0.43) and r.mce == pytest.approx(0.43) and r.brier == pytest.approx((0.05**2 + 0.91**2) / 2)


def test_temperature(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        x = rng.gauss(0, 3)
        rows.append((i, x * 4, rng.random() < 1 / (1 + math.exp(-x)), "calibration"))
    df = spark.createDataFrame(rows, "i int, answer_null_margin double, correct boolean, split string")
    assert calibration.fit_temperature(df, split="split") == pytest.approx(4, rel=0.1)
    with pytest.raises(ValueError, match="calibration split"):
        calibration.fit_temperature(df.withColumn("split", F.lit("test")), split="split")
    with pytest.raises(ValueError, match="both right and wrong"):
        calibration.fit_temperature(df.withColumn("correct", F.lit(True)))
    out = calibration.apply_temperature(df, 2.0).first()
    assert out.confidence == pytest.approx(1 / (1 + math.exp(-out.answer_null_margin / 2)))


def test_threshold_pairs_equal_masks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.1, 0.2, 0.5, rng.random()]), rng.random() < 0.5) for _ in range(120)]
    df = spark.createDataFrame(rows, "confidence double, correct boolean")
    for p in calibration.threshold_pairs(df, grid=5).collect():
        a = [c for x, c in rows if x >= p.answer_threshold]
        b = [c for x, c in rows if x <= p.abstain_threshold]
        assert (p.answer_count, p.answer_correct, p.abstain_count, p.abstain_correct) == (len(a), sum(a), len(b), sum(b))
    assert calibration.select_thresholds(df, grid=5).count() == 1


def test_labels(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.5), (0.4, 0.4, 0.2), (0.1, 0.1, 0.8), (0.7, 0.3, 0.0)], "e double, n double, c double")
    e, n, c = F.col("e"), F.col("n"), F.col("c")
    rows = df.select(labels.nli_label_v2(e, n, c).alias("b"), labels.nli_label_v1(e, n, c).alias("a"), labels.self_label(e, c).alias("s")).collect()
    assert [r.b for r in rows] == ["CONTRADICTION", "ENTAILMENT", "CONTRADICTION", "ENTAILMENT"]
    assert [r.s for r in rows] == ["UNCERTAIN", "UNCERTAIN", "REJECTED", "SUPPORTED"]


def test_qa_agreement(spark):
    df = spark.createDataFrame([("x y", "x y", 0.4), ("x", "", 0.6), ("x", "z", 0.6), ("x", "", 0.2)], "a string, b string, s double")
    got = [r.e.label for r in df.select(labels.qa_agreement(F.col("a"), F.col("b"), F.col("s")).alias("e")).collect()]
    assert got == ["SUPPORTED", "UNSUPPORTED", "UNSUPPORTED", "UNCERTAIN"]


def test_consistency(spark):
    df = spark.createDataFrame([("SUPPORTED", "ENTAILMENT", "ANSWER"), ("WEAK", "ENTAILMENT", "ABSTAIN"), (None, None, None), ("WEAK", " neutral ", "ANSWER")], "evidence_support string, semantic_label string, decision string")
    rows = labels.consistency(df).collect()
    assert [(r.consistency_label, round(r.consistency_score, 3)) for r in rows] == [("CONSISTENT", 1.0), ("CONFLICTING", 0.333), ("MIXED", 0.0), ("MIXED", 0.667)]


def test_routing_and_resolution(spark):
    df = spark.createDataFrame([(0.7, "WEAK"), (0.3, "WEAK"), (0.5, "SUPPORTED"), (0.5, "WEAK"), (0.5, "UNSUPPORTED")], "c double, s string")
    rows = df.select(labels.route(F.col("c"), 0.3, 0.7).alias("t"), "s").select(labels.resolve(F.col("t"), F.col("s")).alias("f")).collect()
    assert [r.f for r in rows] == ["ANSWER", "ABSTAIN", "ANSWER", "VERIFY", "ABSTAIN"]
    with pytest.raises(ValueError):
        labels.route(F.col("c"), 0.7, 0.7)


def test_claim_reasons(spark):
    df = spark.createDataFrame([("Who?", "Bob Smith", "It was Bob Smith then."), ("Who?", "Bob", "Who is that Bob?"), ("q", "7", ""), ("q", "Bob", "Bob")], "question string, prediction_text string, qa_claim string")
    got = [r.qa_claim_validation_reasons for r in labels.validated_claims(df).collect()]
    assert got == [[], ["QUESTION_FORM", "EXCESSIVE_QUESTION_COPY"], ["EMPTY_CLAIM", "TOO_SHORT", "ANSWER_NOT_PRESERVED", "NUMBER_NOT_PRESERVED"], ["ANSWER_ONLY_FRAGMENT", "TOO_SHORT"]]


def test_signs_equal_brute_force():
    rng = np.random.default_rng(4)
    for n, values in ((0, 1), (1, 1), (30, 3), (200, 9), (200, 10_000)):
        a, b = rng.integers(0, values, n) / 7, rng.integers(0, values, n) / 3
        right, wrong = rng.integers(0, 4, n), rng.integers(0, 4, n)
        want = np.zeros((3, 3), np.int64)
        x, y = (np.sign(v[:, None] - v[None, :]).astype(int) + 1 for v in (a, b))
        np.add.at(want, (x, y), right[:, None] * wrong[None, :])
        assert (diagnostics.signs(a, b, right, wrong) == want).all()


@pytest.mark.parametrize("stripe_rows", [1, 15, 10**6])
def test_rank_flips_over_stripes_and_common_values(spark, stripe_rows):
    """Stripes of one common value in either score, of both, and of many values."""
    rng = random.Random(stripe_rows)
    rows = [(rng.choice([0.5, 0.5, rng.random()]), rng.choice([0.25, rng.random(), rng.random()]), rng.random() < 0.5) for _ in range(150)]
    df = spark.createDataFrame(rows, "confidence double, fused double, correct boolean")
    want = Counter()
    for a, b, c in rows:
        for x, y, d in rows:
            if c and not d:
                want[(a > x) - (a < x), (b > y) - (b < y)] += 1
    assert {(r.baseline, r.alternative): r.pairs for r in diagnostics.rank_flips(df, stripe_rows=stripe_rows).collect()} == want


def test_rank_flips_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0.1, 0.5, rng.random()]), rng.choice([0.2, rng.random()]), rng.random() < 0.5) for _ in range(150)]
    df = spark.createDataFrame(rows, "confidence double, fused double, correct boolean")
    want = {}
    for a, b, c in rows:
        for x, y, d in rows:
            if c and not d:
                k = ((a > x) - (a < x), (b > y) - (b < y))
                want[k] = want.get(k, 0) + 1
    flips = diagnostics.rank_flips(df)
    assert {(r.baseline, r.alternative): r.pairs for r in flips.collect()} == want
    assert diagnostics.flip_summary(flips).first().pairs == sum(want.values())


def test_correlations_without_variation_are_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 4.0), (3.0, 1.0, 5.0)], "x double, k double, y double")
    rows = {r.y: r for r in diagnostics.correlations(df, [("x", "k"), ("x", "y")]).collect()}
    assert rows["k"].pearson is None and rows["y"].spearman == pytest.approx(1.0)


def mean_ranks(values):
    """Mean rank of each place: a group holds what is close to its first value; nulls come first, NaN last."""
    order = sorted(range(len(values)), key=lambda i: (0, 0) if values[i] is None else (2, 0) if values[i] != values[i] else (1, values[i]))
    same = lambda a, b: a is None and b is None or None not in (a, b) and (a != a and b != b or math.isclose(a, b, abs_tol=1e-15))
    out, at = {}, 0
    while at < len(order):
        end = at + 1
        while end < len(order) and same(values[order[at]], values[order[end]]):
            end += 1
        out |= dict.fromkeys(order[at:end], (at + 1 + end) / 2)
        at = end
    return out


@pytest.mark.parametrize("range_rows", [4, 10**6])
def test_groups_of_close_values_cross_ranges(spark, range_rows):
    """Values that creep by less than the tolerance, so that where a group begins hangs on all before it."""
    rng = random.Random(range_rows)
    values = [0.1, 0.3, 0.1 + 0.2, 0.30000000001, 0.5, 0.0, 5e-16, -9e-16, float("inf"), float("-inf"), float("inf"), None, None, float("nan"), float("nan")]
    values += [2 + 6e-10 * i for i in range(40)] + [7 * (1 + 3e-10 * rng.randint(0, 60)) for _ in range(30)] + [-5 - 4e-9 * i for i in range(10)]
    values += [1e300 * (1 + 9e-10 * i) for i in range(5)] if range_rows > 3 else []
    df = spark.createDataFrame(list(enumerate(values)), "row_idx int, v double")
    assert {r.row_idx: r.place for r in ranks.average_rank(df, "v", "place", range_rows).collect()} == mean_ranks(values)


def test_correlations_read_the_table_once(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(9)]), rng.gauss(0, 1), rng.randint(0, 3) / 3 + rng.choice([0, 1e-10])) for _ in range(300)]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], "a double, b double, c double")
    got = {(r.x, r.y): r for r in diagnostics.correlations(df, [("a", "b"), ("b", "c"), ("a", "c")]).collect()}
    for x, y in got:
        both = [(r["abc".index(x)], r["abc".index(y)]) for r in rows if None not in (r["abc".index(x)], r["abc".index(y)])]
        u, v = zip(*both, strict=True)
        pearson = statistics.correlation(u, v)
        ru, rv = mean_ranks(u), mean_ranks(v)
        spearman = statistics.correlation([ru[i] for i in range(len(u))], [rv[i] for i in range(len(v))])
        assert got[x, y].n == len(both) and got[x, y].pearson == pytest.approx(pearson) and got[x, y].spearman == pytest.approx(spearman)


def test_average_rank_equals_brute_force(spark):
    values = [None, float("nan"), -1e9, *(i % 1700 / 7 for i in range(4000)), *(1 - 1e-9 * i for i in range(50)), *[0.5] * 30]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_idx int, v double")
    got = {r.row_idx: r.place for r in diagnostics.average_rank(df, "v", "place").collect()}
    assert got == mean_ranks(values)
    assert diagnostics.average_rank(df.limit(0), "v", "place").count() == 0


def test_cells_never_fall_as_scores_fall(spark):
    scores = sorted({0.0, 1.0, 5e-324, 1e-300, 1 - 2**-53, *(i / 997 for i in range(998)), *(1 - 10.0**-k for k in range(1, 17)), *(10.0**-k for k in range(1, 20))}, reverse=True)
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", ranking.score_cell(F.col("s")).alias("cell"))
    cells = [r.cell for r in sorted(df.collect(), key=lambda r: -r.s)]
    assert cells == sorted(cells) and len(set(cells)) > 900


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_idx int, label int")
    out = resample.stratified_split(df, 0.5).groupBy("label", "split").count().collect()
    assert sorted(r["count"] for r in out) == [5, 5, 5, 5]
    runs = resample.random_abstention(df.withColumn("correct", F.col("label") == 1), [0.5, 1.0], [0, 1, 2])
    assert {(r.target_coverage, r.answered) for r in runs.collect()} == {(0.5, 10), (1.0, 20)}
    summary = {r.target_coverage: r for r in metrics.run_summary(runs).collect()}
    assert summary[1.0].std_answer_accuracy == 0 and summary[1.0].runs == 3
    nested = ranking.nested_samples(df, [5, 10, 15])
    parts = {k: {r.row_idx for r in nested.where(f"sample_size = {k}").collect()} for k in (5, 10, 15)}
    assert parts[5] < parts[10] < parts[15] and len(parts[15]) == 15


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, i / 60, i % 3 > 0) for i in range(60)], "row_idx int, s double, correct boolean")
    draws = resample.paired_bootstrap(df, {"a": F.col("s"), "b": 1 - F.col("s"), "same": F.col("s")}, replicates=40)
    rows = {r.method: r for r in resample.bootstrap_summary(draws, "a").collect()}
    assert rows["same"].mean_difference == 0 and rows["a"].replicates == 40 and rows["b"].low <= rows["b"].mean_aurc <= rows["b"].high


def test_validation(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),)], "confidence double")
    with pytest.raises(validate.InvalidRows, match="1 rows"):
        validate.require(df, validate.probability("confidence"))
    with pytest.raises(validate.InvalidRows, match="no rows"):
        validate.require(df.limit(0), {})
    assert validate.best_field(spark.createDataFrame([(1.0, None), (None, None)], "a double, b double"), ["b", "a"]) == "a"


def test_self_verification_skips_empty_answers(spark):
    df = spark.createDataFrame([("q", "c", "x"), ("q", "c", " ")], "question string, context string, prediction_text string")

    def load():
        return lambda premises, claims: [(0.9, 0.1, 0.0) for _ in claims]

    rows = {r.prediction_text: r for r in inference.self_verified(df, load).collect()}
    assert rows["x"].self_verification_label == "SUPPORTED" and rows["x"].self_verification_score == pytest.approx(0.9)
    assert (rows[" "].self_verification_label, rows[" "].self_verification_score, rows[" "].self_verification_claim) == ("REJECTED", -1.0, None)
    out = {r.prediction_text: r.qa_nli_label for r in inference.question_verified(df, load).collect()}
    assert out[" "] == "EMPTY_ANSWER"


def test_chunk_confidence(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("a", 5.0, 2.0)], "id string, answer_span_logit double, null_logit double")
    assert inference.chunk_confidence(df).first().answer_null_margin == 4.0


def test_containing_equals_search(spark):
    docs = spark.createDataFrame([(1, "One two THREE four five six"), (2, "xone two three four fivey"), (3, "a b"), (4, ""), (5, None), (6, "one two three")], "doc_id int, context string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "two"), (3, " "), (4, None), (5, "B")], "item_id int, text string")
    got = sorted((r.doc_id, r.item_id) for r in lookup.containing(docs, items).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 5), (6, 2)]


def test_order_statistics_are_exact(spark):
    """Values crowded at many sizes, so that many rounds are needed; ties, nulls and values that aren't finite."""
    rng = random.Random(6)
    values = [*(10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(200)), *[0.25] * 90, 1.7e308, -1.7e308, *(1 + 2.0**-52 * i for i in range(50))]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
    every = calibration.order_statistics(df, "v", lambda n: range(n))
    assert [every[k] for k in range(len(values))] == sorted(values)
    assert calibration.order_statistics(df.limit(0), "v", lambda n: range(n)) == {}
    with pytest.raises(ValueError):
        calibration.order_statistics(df, "v", lambda n: [n])


def test_registered_thresholds_search_the_whole_grid(spark):
    from prudence.plans import catalog, surrogate

    data = "/root/testdata/sf0.001"
    rows = [(r.confidence, r.correct) for r in surrogate.events(spark, data).select("confidence", "correct").collect()]
    grid = sorted({0.0, 1.0, *np.quantile([c for c, _ in rows], np.arange(101) / 100)})
    got = sorted(r.candidate for r in catalog.QUERIES["quantile_candidates"](spark, data).collect())
    assert np.allclose(got, sorted({round(float(g), 9) for g in grid}), atol=2e-9)
    n, best = len(rows), None
    for i, low in enumerate(grid):
        below = [c for x, c in rows if x <= low]
        for high in grid[i + 1 :]:
            above = [c for x, c in rows if x >= high]
            if min(len(above), len(below)) < max(1, math.ceil(n * 0.05)):
                continue
            risk, bad = 1 - sum(above) / len(above), sum(below) / len(below)
            ok, broken = risk <= 0.1 and bad <= 0.25, round(max(0, risk - 0.1) + max(0, bad - 0.25), 9)
            key = (not ok, 0 if ok else broken, -len(above), -len(above) - len(below), round(risk, 9) if ok else 0, round(bad, 9) if ok else 0, low, high)
            best = min(best, key) if best else key
    r = catalog.QUERIES["threshold_search"](spark, data).first()
    assert np.allclose([r.abstain_threshold, r.answer_threshold], best[-2:], atol=2e-9)


def test_bootstrap_equals_brute_force_over_cells(spark):
    """Orders of several cells, with ties, over more than a block of replicates."""
    rng = random.Random(8)
    rows = [(i * 7, rng.randint(0, 5) / 5, rng.random() < 0.6) for i in range(40)]
    df = spark.createDataFrame(rows, "row_idx long, s double, correct boolean")
    got = {(r.method, r.replicate): r for r in resample.paired_bootstrap(df, {"a": F.col("s"), "b": 1 - F.col("s")}, 510, 3, cell_rows=7).collect()}
    times = resample.draws(np.array([r[0] for r in rows]), np.arange(510), 3)
    assert len(got) == 1020 and abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.05
    for b in (0, 1, 499, 500, 509):
        for method, sign in (("a", -1), ("b", 1)):
            wrong = answered = 0
            risks = []
            for i in sorted(range(40), key=lambda i: (sign * rows[i][1], rows[i][0])):
                for _ in range(times[i, b]):
                    answered, wrong = answered + 1, wrong + (not rows[i][2])
                    risks.append(wrong / answered)
            assert got[method, b].rows == len(risks) and got[method, b].aurc == pytest.approx(sum(risks) / len(risks))


def test_registered_bootstrap_draws_every_replicate(spark):
    from prudence.plans import catalog

    assert {r.replicates for r in catalog.QUERIES["paired_bootstrap"](spark, "/root/testdata/sf0.001").collect()} == {5000}
