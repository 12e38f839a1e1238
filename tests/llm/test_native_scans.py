import random
from collections import Counter

import pytest

from prudence.llm import decontamination, licenses
from prudence.llm.decontamination import contamination

SCHEMA = "doc_id long, text string"


def test_licenses(spark, clash):
    rows = [(1, "Prose first. Released under the MIT License.\nmore"), (2, "LICENSED under the APACHE license version 2 0!"), (3, None), (4, ""), (5, "nothing here " * 2000), (6, "This work is licensed under CC BY-NC 4.0"), (6, "This work is licensed under CC BY-NC 4.0"), (None, "MIT"), (None, "Released under the MIT License")]
    out = {r.doc_id: r for r in licenses.scan_licenses(clash(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [(out[i].licence, out[i].n_notices) for i in (1, 2, 3, 4, 5, 6, None)] == [("MIT", 1), ("Apache-2.0", 1), ("", 0), ("", 0), ("", 0), ("CC-BY-NC-4.0", 1), ("MIT", 1)]
    assert out[1].dice == 1.0 and licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_texts_headers_and_wrapped_notices(spark):
    rng = random.Random(4)
    prose = lambda k: " ".join(f"p{rng.randrange(500)}" for _ in range(k))
    rows, want = [], {}
    for licence, own in licenses.TEXTS.items():
        for text in own:
            w = text.split()
            edited = list(w)
            for k in range(10, len(w), 25):
                edited[k] = "changed"
            # as it is; with a word in 25 changed, wrapped into short lines of comments and inside of prose
            rows.append((len(rows), "The Title\n\nCopyright (c) 2001 A. Holder\n\n" + text))
            rows.append((len(rows), prose(30) + " " + "\n * ".join(" ".join(edited[k : k + 9]) for k in range(0, len(w), 9)) + "\n" + prose(30)))
            want |= {len(rows) - 2: licence, len(rows) - 1: licence}
    rows += [(900, "It is licensed under the\nApache License,\nVersion 2.0"), (901, "The tool, which is released under the MIT License and may be copied by all, is here."), (902, prose(2000)), (903, "of the software and the use of the software for any purpose")]
    want |= {900: "Apache-2.0", 901: "MIT", 902: "", 903: ""}
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.licence for i, r in out.items()} == want
    assert all(r.n_notices == bool(want[i]) for i, r in out.items() if i != 0) and out[0].dice == 1.0


def test_size_bounds_lose_nothing():
    for n in range(1, 30):
        for m in range(1, 60):
            reachable = 2 * min(n, m) / (n + m) >= 0.8
            assert (m in licenses.size_bounds(n, 0.8)) or not reachable


def shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(vocab, k=rng.choice([3, 12, 20, 40]))) for i in range(12)]
    docs = []
    for d in range(40):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        if d % 2:
            part = list(rng.choice(items)[1])
            if d % 4 == 1 and len(part) > 20:
                part[rng.choice([0, len(part) - 1, len(part) // 2])] = "changed"
            at = rng.randint(0, len(w))
            w = w[:at] + part + w[at:]
        docs.append((d, w))
    return docs, items


def test_contamination_equals_brute_force(spark, clash, planted):
    docs, items = planted
    rows = [(d, ", ".join(w).upper() + ".") for d, w in docs] + [(100, None), (101, ""), (0, ", ".join(docs[0][1]).upper() + ".")]
    bench = [(i, " ".join(w)) for i, w in items] + [(200, None), (201, "...")]
    got = {(r.doc_id, r.item_id): r for r in contamination(clash(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for d, w in docs:
        for i, item in items:
            n = len(item)
            best = max((jaccard(shingles(w[s : s + n]), shingles(item)) for s in range(max(1, len(w) - n + 1))), default=0) if w else 0
            if best >= 0.8:
                want[d, i] = best
    assert got.keys() == want.keys() and want
    for k, v in want.items():
        assert got[k].similarity == pytest.approx(v, abs=1e-9)


def test_shuffled_way_finds_the_same(spark, planted, monkeypatch):
    docs, items = planted
    df, bench = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], SCHEMA), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = sorted(contamination(df, bench).collect())
    monkeypatch.setattr(decontamination, "SMALL_INDEX", 0)
    monkeypatch.setattr(decontamination, "SMALL_ITEMS", 0)
    monkeypatch.setattr(decontamination, "MOST_FLAGS", 64)
    monkeypatch.setattr(decontamination, "LEAST_FLAGS", 64)
    assert sorted(contamination(df, bench).collect()) == want
    assert contamination(df.limit(0), bench).count() == 0 and contamination(df, bench.limit(0)).count() == 0


def test_windows_off_all_diagonals_are_found(spark):
    item = [f"i{k}" for k in range(60)]
    copy = ["x", *item[1:30], "y", "z", *item[30:59], "u"]
    text = ["a"] * 7 + copy + ["b"] * 9
    similar = [round(jaccard(shingles(text[s : s + 60]), shingles(item)), 9) for s in range(len(text) - 59)]
    assert max(similar[7], similar[9]) < 0.8 <= similar[8]
    rows = [(1, " ".join(text)), (1, " ".join(item)), (2, " ".join(item[:50])), (None, " ".join(text))]
    bench = [(5, " ".join(item)), (5, " ".join(item[:12])), (6, "one two three"), (None, "one two three")]
    out = {(r.doc_id, r.item_id): r for r in contamination(spark.createDataFrame([*rows, (3, "zero one two three")], SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(out) == {(1, 5), (2, 5), (None, 5), (3, 6), (3, None)}
    assert (out[None, 5].similarity, out[None, 5].start_word) == (0.806451613, 8) and out[1, 5].similarity == 1.0 and out[3, 6].start_word == 1


def simhash(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_counting(spark):
    rng = random.Random(3)
    lists = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 3, 7, 8, 30, 64, 100)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<bigint>").selectExpr("i", decontamination.fingerprint("h", 100) + " AS f").collect()
    assert {r.i: r.f % 2**64 for r in rows} == {i: simhash([h % 2**64 for h in x]) for i, x in enumerate(lists)}


def test_index_finds_all_within_the_radius(spark):
    """Any two fingerprints that differ in RADIUS bits or fewer meet in the index, once."""
    rng = random.Random(5)
    signed = lambda x: x - 2**64 if x >> 63 else x
    items = [(3, i, signed(rng.getrandbits(64))) for i in range(20)]
    probes = []
    for i, (_, _, f) in enumerate(items):
        for n in (0, 1, 7, 12, decontamination.RADIUS):
            probes.append((len(probes), i, signed((f ^ sum(1 << b for b in rng.sample(range(64), n))) % 2**64)))
    table = decontamination.index(spark.createDataFrame(items, "len int, key bigint, fi bigint"))
    looked = spark.createDataFrame(probes, "p int, i bigint, fw bigint").selectExpr("p", "i", "fw", f"inline({decontamination.blocks('fw')})").selectExpr("*", decontamination.place("3", "b", "v") + " AS place")
    met = looked.join(table, "place").where("bit_count(fw ^ fi) <= " + str(decontamination.RADIUS)).where(decontamination.first_block("fw", "fi"))
    got = Counter((r.p, r.i) for r in met.where("item = i").collect())
    assert got == Counter((p, i) for p, i, _ in probes)


def test_long_items(spark):
    """Items of 5,000 words, one with repeated shingles, copied with edits into a longer text."""
    rng = random.Random(9)
    item = [f"w{rng.randrange(900)}" for _ in range(5000)]
    item[1000:1200] = item[:200]
    copy = list(item)
    for k in range(0, 5000, 100):
        copy[k] = "edit"
    text = ["x"] * 50 + copy + ["y"] * 70
    want = max(jaccard(shingles(text[s : s + 5000]), shingles(item)) for s in range(44, 57))
    out = contamination(spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item[:3000]))], SCHEMA), spark.createDataFrame([(5, " ".join(item)), (6, "a b")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in out] == [(1, 5)] and out[0].similarity == pytest.approx(want, abs=1e-9) and 0.8 <= want < 1


def test_recall_against_all_windows(spark):
    """Copies edited down to the threshold: SimHash may part a pair in the index, but nearly all are found and none wrongly."""
    rng = random.Random(21)
    items = [[f"v{rng.randrange(4000)}" for _ in range(rng.choice([25, 30, 40, 60]))] for _ in range(60)]
    docs, want = [], set()
    for d in range(240):
        i = d % 60
        part = list(items[i])
        for _ in range(d // 60):
            part[rng.randrange(len(part))] = "edit"
        w = [f"u{rng.randrange(4000)}" for _ in range(30)] + part + [f"u{rng.randrange(4000)}" for _ in range(30)]
        docs.append((d, " ".join(w)))
        if max(jaccard(shingles(w[s : s + len(part)]), shingles(items[i])) for s in range(len(w) - len(part) + 1)) >= 0.8:
            want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 70
