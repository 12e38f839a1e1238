"""Held-out accuracy of the trained operators, and their edges."""

import os
import random
import zlib

import numpy as np
import pytest

from prudence.llm import language, quality, toxicity

DATA = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "  \n "), (4, "123 !!"), (5, "x" * 200_000), (6, "a"), (6, "a"), (None, "a b")]


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def edges(spark, clash):
    return clash(spark.createDataFrame(EDGES, "doc_id long, text string")).selectExpr("*", "cast(null as string) AS lang")


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, pairs, z = language.forward_backward(e, trans, start)
    total_pairs = np.zeros((3, 3))
    for n in range(2):
        weight, mass = 0.0, np.zeros((4, 3))
        own = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=4):
            w = np.exp(start[path[0]] + sum(e[n, i, k] for i, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            for i, k in enumerate(path):
                mass[i, k] += w
            for a, b in itertools.pairwise(path):
                own[a, b] += w
        total_pairs += own / weight
        assert np.allclose(post[n], mass / weight) and np.isclose(z[n], np.log(weight))
    assert np.allclose(pairs, total_pairs)


def test_language_held_out(tables):
    docs, _ = tables
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_mixed_text_and_edges(spark, tables, edges):
    docs, _ = tables
    known = docs.select("doc_id", "text", "lang")
    two = [r.text for lang in ("de", "es") for r in known.where(f"lang = '{lang}' AND length(text) > 2000").orderBy("doc_id").limit(1).collect()]
    mixed = spark.createDataFrame([(10**9, two[0][:900] + " " + two[1][:1000])], "doc_id long, text string").selectExpr("*", "cast(null as string) AS lang")
    both = known.unionByName(mixed).unionByName(edges.select("doc_id", "text", "lang"))
    got = {(r.doc_id, r.lang_pred): r for r in language.identify(both).where("doc_id IS NULL OR doc_id < 7 OR doc_id = 1000000000").collect()}
    import json

    mix = next(json.loads(r.mix) for (i, _), r in got.items() if i == 10**9)
    assert mix["de"] > 0.25 and mix["es"] > 0.25
    out = [r for r in language.identify(edges).collect()]
    assert len(out) == len(EDGES) and {r.lang_pred for r in out} == {"und"}
    assert language.identify(edges.limit(0)).count() == 0
    kept = language.keep_identified(both)
    assert kept.columns == both.columns and kept.where("doc_id = 4 AND text = '123 !!'").count() == 0


def small_model():
    rng = random.Random(8)
    words = {lang: [a + b for a in first for b in second] for lang, first, second in (("aa", ("ka", "lo", "mi"), ("ra", "le", "ni", "po")), ("bb", ("qu", "zh", "tk"), ("ix", "oy", "uw", "ev")))}
    return words, language.train([(lang, " ".join(rng.choices(w, k=32))) for lang, w in words.items() for _ in range(60)])


def test_long_texts_are_labelled_in_bounded_runs(monkeypatch):
    import pyarrow as pa

    words, model = small_model()
    rng = random.Random(1)
    text = "  ".join(rng.choice(words[rng.choice(["aa", "bb", "bb"])]) for _ in range(5000)) + " \n"
    whole = [x[0] for x in list(model.documents(pa.array([text])))[0][1:]]
    for most in (400, 1111, 20_000):
        monkeypatch.setattr(language, "SLICE_BYTES", most)
        parts = list(language.runs_of_chains(text, most))
        assert "".join(parts) == text and len(parts) > 1 and all(len(p.split()) % language.CHAIN == 0 for p in parts[:-1])
        _, mass, counted, fits = list(model.documents(pa.array([text])))[0]
        assert counted[0] == whole[1] == 5000 and np.allclose(mass[0], whole[0], rtol=1e-4) and np.allclose(fits[0], whole[2])
    assert max(map(len, language.cut_words("x" * 5500 + " y").split())) == language.LONGEST_WORD


def test_memory_of_a_long_text_is_bounded():
    """20 MB of one text in a process of its own: what is added to its memory stays below 15 bytes a byte, text and all."""
    import subprocess
    import sys

    code = """
import random, sys
sys.path.insert(0, "tests/llm")
import pyarrow as pa
from test_classifiers import small_model
from prudence.llm import language
words, model = small_model()
rng = random.Random(2)
pool = [a + b for a in words["aa"] for b in words["bb"]]
text = pa.array([" ".join(rng.choices(pool, k=2_300_000))])
peak = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM"))
before = peak()
got = language.predicted(model, text)
print(len(text[0].as_py()), (peak() - before) * 1024, got[0][0])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    size, added, label = out.stdout.split()
    assert int(size) > 19_000_000 and int(added) < 300_000_000 and label in ("aa", "bb"), out.stderr


def test_rare_languages_are_learned_and_other_scripts_rejected(spark, clash):
    rng = random.Random(5)
    words, _ = small_model()
    say = lambda lang, k=40: " ".join(rng.choices(words[lang], k=k))
    rows = [(i, say("aa"), "aa") for i in range(3000)] + [(5000 + i, say("bb"), "bb") for i in range(12)]
    rows += [(6000, say("aa"), None), (6001, say("bb"), None), (6002, "\u0436\u0448 \u044f\u0439\u0446\u043e " * 40, None), (6003, None, None), (6004, say("aa", 20) + " " + say("bb", 20), None), (None, say("bb"), None)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string")).drop("lang_pred", "held_out", "score")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).where("doc_id >= 5000 OR doc_id IS NULL").collect()}
    assert got[6000] == "aa" and got[6001] == got[None] == "bb" and all(got[5000 + i] == "bb" for i in range(12))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id >= 6000 OR doc_id IS NULL").collect()} - {6004} == {6000, 6001, None}


def test_repeated_rows_do_not_crowd_out_a_language(spark):
    words, _ = small_model()
    rows = [(1, " ".join(words["aa"] * 4), "aa")] * 3000 + [(i, " ".join(words["bb"] * 4), "bb") for i in range(2, 30)]
    chains = sorted(map(tuple, language.training_chains(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()))
    assert {lang for lang, _ in chains} == {"aa", "bb"} and sum(lang == "aa" for lang, _ in chains) <= 2


def test_sample_takes_the_least_hashes_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGE_DOCS", 20)
    rows = [(i, f"w{i}", "aa") for i in range(6000)] + [(10_000 + i, f"w{10_000 + i}", "bb") for i in range(15)] + [(7, "w7", "aa")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chains = sorted(map(tuple, language.training_chains(docs, "doc_id", "text", "lang").collect()))
    order = docs.where(~language.held_out("doc_id")).distinct().orderBy(language.F.xxhash64("doc_id"), "doc_id").collect()
    for lang in ("aa", "bb"):
        assert {c for x, c in chains if x == lang} == {r.text for r in [r for r in order if r.lang == lang][:20]}


def test_one_long_word_does_not_widen_the_training_words():
    """A word of the greatest length among 60,000 others: what training adds to a process stays far below their number times that length."""
    import subprocess
    import sys

    code = """
import random
from prudence.llm import language
rng = random.Random(1)
words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
rows = [("xy"[i % 2], " ".join(rng.choices(words, k=32))) for i in range(2000)] + [("x", "z" * 1000)]
peak = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmHWM"))
before = peak()
language.train(rows)
print((peak() - before) * 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(out.stdout) < 100_000_000, out.stderr


def test_isotonic_equals_brute_force():
    rng = random.Random(2)
    x, y = np.array([rng.random() for _ in range(60)]), np.array([float(rng.random() < 0.5) for _ in range(60)])
    centres, levels = quality.isotonic(x, y)
    assert (np.diff(levels) > 0).all() and (np.diff(centres) > 0).all()
    order = np.argsort(x)
    ys = y[order]
    best = [max(min(ys[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert sorted(set(np.round(best, 9))) == sorted(set(np.round(levels, 9)))


def test_quality_held_out(tables, edges):
    docs, labels = tables
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = quality.score_quality(edges, labels.limit(0)).collect()
    assert len(out) == len(EDGES) and {r.score for r in out} == {0.5}
    assert quality.score_quality(docs.select("doc_id", "text").limit(0), labels).count() == 0


def test_statistics_of_edges():
    import pyarrow as pa

    s = quality.all_statistics(pa.array([t for _, t in EDGES]))
    assert s.shape == (len(EDGES), quality.NAMES) and np.isfinite(s).all()


def test_toxicity_held_out(tables, edges):
    docs, labels = tables
    rows = toxicity.grade_toxicity(docs, labels.where("doc_id % 4 <> 2")).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("doc_id % 4 = 2").collect()
    assert sum(r.toxic for r in rows if not r.y) / sum(not r.y for r in rows) < 0.05
    assert all(0 <= r.severity <= 3 and (r.toxic == (r.p_toxic >= 0.5)) for r in rows)
    out = toxicity.grade_toxicity(edges, labels.limit(0)).collect()
    assert len(out) == len(EDGES) and {r.severity for r in out} == {0.0}


def test_ordinal_fit_orders_grades():
    rng = random.Random(3)
    rows, grade = [], []
    for _ in range(400):
        g = rng.randint(0, 3)
        rows.append(np.array(sorted(rng.sample(range(6), g * 2)), np.int64))
        grade.append(g)
    w, cuts = toxicity.fit(rows, np.array(grade), 6)
    assert (np.diff(cuts) > 0).all() and (w > 0).all()
    model = toxicity.Model(np.zeros(0, np.int64), w, cuts)
    expected = model.passing(np.array([w[r].sum() if len(r) else 0.0 for r in rows])).sum(1)
    means = [expected[np.array(grade) == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] > 2 and means[0] < 0.5


def test_ordinal_gradient():
    """A step along the fitted direction lowers the likelihood's loss: one feature, two grades."""
    w, cuts = toxicity.fit([np.array([0])] * 50 + [np.zeros(0, np.int64)] * 50, np.array([1] * 50 + [0] * 50), 1)
    assert w[0] > cuts[0] > 0


def test_long_words_are_cut_at_every_size(monkeypatch):
    """Padding of digits without a space between moves a text over the size at which it is labelled in parts; its label and score stay."""
    words, model = small_model()
    text = " ".join(words["aa"][:12] * 40) + " " + "".join(words["bb"]) * 400 + " "
    got = []
    for most in (10**9, 5_000):
        monkeypatch.setattr(language, "SLICE_BYTES", most)
        pred, score, _, _ = language.predicted(model, language.pa.array([text, "".join(words["aa"]) * 100, "x", None]))
        got.append((pred, [round(float(x), 5) for x in score]))
    assert got[0] == got[1]


def test_quality_equals_a_direct_fit(tables):
    """The query's scores from one plain solution: no partial sums, normal equations as least squares, isotonic by its min-max formula."""
    docs, labels = tables
    sample = quality.training_rows(docs, labels, "doc_id", "text").toPandas()
    stats = quality.all_statistics(language.pa.array(sample.text))
    y, fit = sample.y.to_numpy(float), (sample.part > 0).to_numpy()
    mean, spread = stats.mean(0), np.where(stats.std(0) > 1e-9, stats.std(0), 1.0)
    x = quality.fourier((stats - mean) / spread)
    penalty = np.full(x.shape[1], quality.RIDGE * max(1.0, fit.sum()) / 100)
    penalty[0] = 1e-9
    rows = np.concatenate([x[fit], np.diag(np.sqrt(penalty))])
    weights = np.linalg.lstsq(rows, np.concatenate([y[fit], np.zeros(len(penalty))]), rcond=None)[0]
    raw = x[~fit] @ weights
    order = np.argsort(raw, kind="stable")
    level = np.array([max(min(y[~fit][order][i : j + 1].mean() for j in range(k, len(order))) for i in range(k + 1)) for k in range(len(order))])
    steps = [raw[order][level == v].mean() for v in np.unique(level)], np.unique(level)
    model = quality.Model(mean, spread, weights, steps)
    every = docs.select("doc_id", "text").toPandas()
    want = dict(zip(every.doc_id, model.score(quality.all_statistics(language.pa.array(every.text))), strict=True))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == len(every) and np.allclose([got[k] for k in got], [want[k] for k in got], atol=1e-6)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, quality.NAMES))
    cosines = quality.fourier(x)[:, 1 + quality.NAMES :]
    want = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(2))
    error = np.abs(cosines @ cosines.T - want)
    assert error.mean() < 2 / np.sqrt(quality.FOURIER) and error.max() < 6 / np.sqrt(quality.FOURIER)


def test_ordinal_fit_has_no_numeric_gradient():
    """At the fitted weights and thresholds the penalised loss is flat: central differences of the loss written out by its formula."""
    rng = np.random.default_rng(5)
    size, n = 5, 300
    rows = [np.flatnonzero(rng.random(size) < 0.4) for _ in range(n)]
    grade = np.array([min(3, max(0, int(round(sum([0.8, 0.5, -0.4, 1.0, 0.1][k] for k in r) + rng.normal() * 0.7)))) for r in rows])
    assert set(grade) == {0, 1, 2, 3}
    balance = np.where(grade == 0, 0.5 / (grade == 0).sum(), 0.5 / (grade > 0).sum()) * n

    def loss(z):
        w, low, gaps = z[:size], z[size], z[size + 1 :]
        edges = np.concatenate([[-np.inf], low + np.concatenate([[0], np.cumsum(np.exp(gaps))]), [np.inf]])
        s = np.array([w[r].sum() for r in rows])
        p = 1 / (1 + np.exp(s - edges[grade + 1])) - 1 / (1 + np.exp(s - edges[grade]))
        return -(balance * np.log(p)).sum() / n + toxicity.L2 / 2 * (w**2).sum() + 1e-3 / 2 * (gaps**2).sum()

    w, cuts = toxicity.fit(rows, grade, size)
    z = np.concatenate([w, [cuts[0]], np.log(np.diff(cuts))])
    step = 1e-5
    gradient = np.array([(loss(z + step * e) - loss(z - step * e)) / (2 * step) for e in np.eye(len(z))])
    start = np.concatenate([np.zeros(size), [1.0], np.zeros(2)])
    assert np.abs(gradient).max() < 5e-3 and loss(z) < loss(start) - 0.05


def test_toxicity_recall_on_held_out_rows(spark):
    """On the larger tables, since the smaller ones have seven such rows."""
    large = DATA.replace("sf0.01", "sf0.1")
    if not os.path.isdir(large):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.grade_toxicity(docs, labels.where("doc_id % 4 <> 2")).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where("doc_id % 4 = 2").collect()
    assert sum(r.toxic for r in rows if r.y) / max(1, sum(r.y for r in rows)) > 0.85
