"""Text functions against plain Python on hand-made and generated strings."""

import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prudence.functions import text as T
from prudence.functions import values as V

TEXTS = ["The cat, a dog & an éa!", "", None, "a", "the the", "x y  z", "é ù THE end.", "A. B-c d_e", "12,5% of 3.4 12,5", "don't ... stop", "cat cat dog", "dog cat cat cat", "!!!", "The The quick"]


def normalize(s):
    s = re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in (s or "").lower() if c not in string.punctuation))
    return " ".join(s.split())


def f1(a, b, both):
    a, b = normalize(a).split(), normalize(b).split()
    if not a or not b:
        return both if not a and not b else 0.0
    n = sum((Counter(a) & Counter(b)).values())
    return 2 * n / (len(a) + len(b)) if n else 0.0


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    words = ["a", "the", "cat", "Dog!", "éa", "an", "x-y", "12", "...", "cat"]
    made = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(30)]
    rows = [(i, rng.choice(TEXTS + made), rng.choice(TEXTS + made)) for i in range(150)]
    return rows, spark.createDataFrame(rows, "i int, a string, b string").cache()


def test_normalize(pairs):
    rows, df = pairs
    got = {r.i: r.n for r in df.select("i", T.normalize_answer(F.col("a")).alias("n")).collect()}
    assert got == {i: normalize(a) for i, a, _ in rows}


def test_f1_conventions_for_empty_texts(pairs):
    rows, df = pairs
    got = df.select("i", T.f1_pair(F.col("a"), F.col("b")).alias("p"), T.f1_or_zero(F.col("a"), F.col("b")).alias("z")).collect()
    want = {i: (f1(a, b, 1.0), f1(a, b, 0.0)) for i, a, b in rows}
    for r in got:
        assert (r.p, r.z) == pytest.approx(want[r.i])


def test_multiset_overlap_counts_repetitions(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "a", "a", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r.n for r in df.select(T.multiset_overlap(F.col("x"), F.col("y")).alias("n")).collect()] == [2, 0]


def test_exact_match_and_best_f1(spark):
    df = spark.createDataFrame([("The Cat", ["dog", "cat."]), ("", ["", "x"]), ("x", []), ("x", None), (None, ["the"])], "p string, r array<string>")
    rows = df.select(T.exact_match(F.col("p"), F.col("r")).alias("e"), T.best_f1(F.col("p"), F.col("r")).alias("f"), T.best_f1_pair(F.col("p"), F.col("r")).alias("g")).collect()
    assert [(r.e, r.f, r.g) for r in rows] == [(1.0, 1.0, 1.0), (1.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 1.0)]


def test_claim_functions(spark):
    df = spark.createDataFrame([("Who is it?", "not 12% x", "It is not 12 x"), ("", "", ""), ("What?", "7", "Answer: 'seven'")], "q string, a string, c string")
    q, a, c = F.col("q"), F.col("a"), F.col("c")
    rows = df.select(T.looks_like_question(q).alias("l"), T.numbers_preserved(a, c).alias("n"), T.negation_preserved(q, a, c).alias("g"), T.normalise_claim(c).alias("s"), T.token_coverage(a, c).alias("v"), T.copy_ratio(q, c).alias("r")).collect()
    assert [r.l for r in rows] == [True, False, True]
    assert [r.n for r in rows] == [True, True, False] and [r.g for r in rows] == [True, True, True]
    assert [r.s for r in rows] == ["It is not 12 x.", "", "seven."]
    assert rows[0].v == 1.0 and rows[1].v == 1.0 and rows[1].r == 0.0


def test_position_and_window(spark):
    df = spark.createDataFrame([("abc Gravity def", " gravity "), ("abc", "zz"), ("abc", " ")], "c string, a string")
    assert [r.p for r in df.select(T.answer_position(F.col("c"), F.col("a")).alias("p")).collect()] == [4, None, None]
    got = df.select(T.evidence_window(F.col("c"), F.lit(4), F.lit(11), 2).alias("w")).first()
    assert got.w == "c Gravity d"


def test_reasons(spark):
    df = spark.createDataFrame([('["A", "B"]',), ("A; B | C",), (None,), ("",)], "t string")
    assert [r.x for r in df.select(T.parse_reasons(F.col("t")).alias("x")).collect()] == [["A", "B"], ["A", "B", "C"], [], []]


REASONS = [
    ("too short; question form", ["TOO_SHORT", "QUESTION_FORM"]), ('{"TOO_SHORT": true, "X": false, "y  z": "yes", "w": 1, "v": 1.0, "u": "0", "t": null}', ["TOO_SHORT", "V", "W", "Y_Z"]), ('"TOO_SHORT"', ["TOO_SHORT"]),
    ('["a|b", ["c, d", {"e": true}], null, "", 5, true]', ["A", "B", "C", "D", "E", "5", "TRUE"]), ('"[\\"a\\", \\"b c\\"]"', ["A", "B_C"]), ("null", []), ("5", ["5"]), ("true", ["TRUE"]), ("1,2", ["1", "2"]), ("1 x", ["1_X"]),
    ('["a"] b', ['["A"]_B']), ("  ", []), (None, []), (" ;, |", []), ("{}", []), ("[]", []), ('{"a": true} x', ['{"A":_TRUE}_X']),
]


def test_reasons_of_every_form(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REASONS)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.parse_reasons(F.col("t")).alias("x")).collect()}
    assert [sorted(got[i]) if t and t.startswith("{") else got[i] for i, (t, _) in enumerate(REASONS)] == [sorted(want) if t and t.startswith("{") else want for t, want in REASONS]
    typed = spark.sql("SELECT to_variant_object(array('a b', 'c;d')) AS v UNION ALL SELECT to_variant_object(map('x y', true, 'z', false)) UNION ALL SELECT parse_json('7.5')")
    assert sorted(r.x for r in typed.select(T.variant_reasons(F.col("v")).alias("x")).collect()) == [["7.5"], ["A_B", "C", "D"], ["X_Y"]]


FLAGS = {  # JSON: what answerability, correctness, decision and validity make of it
    "true": (True,) * 4, "false": (False,) * 4, "1": (True,) * 4, "0": (False,) * 4, "2": (None,) * 4, "1.0": (None, True, True, True), "0.0": (None, False, False, False), "1.0000000001": (None, True, None, None), "null": (None,) * 4, "[true]": (None,) * 4,
    '" Yes "': (True,) * 4, '"no"': (False,) * 4, '"1"': (True,) * 4, '"1.0"': (None, True, None, True), '"correct"': (None, True, True, True), '"incorrect"': (None, False, False, False), '"valid"': (None, None, None, True), '"invalid"': (None, None, None, False), '"maybe"': (None,) * 4,
}


def test_flags_by_what_a_variant_holds(spark):
    df = spark.createDataFrame([(t,) for t in FLAGS], "t string").withColumn("v", F.parse_json("t"))
    kinds = ("answerability", "correctness", "decision", "validity")
    got = {r.t: tuple(r[1:]) for r in df.select("t", *(V.variant_flag(F.col("v"), k).alias(k) for k in kinds)).collect()}
    assert got == FLAGS
    with pytest.raises(Exception, match="not a flag of decision"):
        df.where("t = '2'").select(V.variant_flag(F.col("v"), "decision", strict=True)).collect()


def test_flags_by_column_type(spark):
    df = spark.createDataFrame([(True, 1, 1.0, "valid", [1]), (False, 0, 0.5, "no", [0]), (None, 3, None, None, None)], "a boolean, b int, c double, d string, e array<int>")
    got = [tuple(r) for r in df.select(*(V.flag_column(df, c, "validity") for c in df.columns)).collect()]
    assert got == [(True, True, True, True, None), (False, False, None, False, None), (None, None, None, None, None)]


def test_flags_and_numbers(spark):
    df = spark.createDataFrame([("yes", "0.5"), ("Correct", "nan"), ("no", "inf"), ("maybe", "x")], "f string, n string")
    rows = df.select(V.flag(F.col("f"), "correctness").alias("f"), V.finite(F.col("n")).alias("n")).collect()
    assert [(r.f, r.n) for r in rows] == [(True, 0.5), (True, None), (False, None), (None, None)]
    with pytest.raises(Exception, match="not a flag"):
        df.select(V.flag(F.col("f"), "answerability", strict=True)).collect()


def test_weighted_geometric_mean_ends(spark):
    df = spark.createDataFrame([(0.0, 0.5, 1.0), (0.0, 0.5, 0.0), (0.0, 0.5, 0.5), (0.81, 0.25, 0.5)], "a double, b double, w double")
    got = [r.m for r in df.select(V.weighted_geometric_mean(F.col("a"), F.col("b"), F.col("w")).alias("m")).collect()]
    assert got == pytest.approx([0.0, 0.5, 0.0, 0.45])
