"""Conversation repair against its oracle, brute force over all edits, and odd tables."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from prudence.llm.conversations import Chart, Grammar, oracle, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Cheapest edits of (role, truncated, must_go) rows by trying them all, with up to two insertions at each place."""
    best = None
    gaps = [list(itertools.chain(*(itertools.product("ua", repeat=n) for n in range(3)))) for _ in range(len(rows) + 1)]
    choices = [["D"] if gone else ["D", "K", "u", "a"] for _, _, gone in rows]
    for edits in itertools.product(*choices):
        for added in itertools.product(*gaps):
            out, audit, cost = "".join(added[0]), "I" * len(added[0]), 2 * sum(map(len, added))
            for (role, cut, _), edit, more in zip(rows, edits, added[1:], strict=True):
                cost += {"D": 3, "K": 0}.get(edit, 2) + (cut and edit != "D")
                audit += edit if edit in "DK" else "R"
                out += "" if edit == "D" else role[:1] or "-" if edit == "K" else edit
                out, audit = out + "".join(more), audit + "I" * len(more)
            if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_chart_finds_what_brute_force_finds():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 3))]
        chart = Chart()
        for role, cut, gone in rows:
            chart.read(role, "x", cut, gone)
        assert chart.repaired()[:2] == brute(rows)


def test_long_chart_keeps_trails_and_one_digest():
    """Over many rows of one role an insertion at the very start stays possible: trails and digest still agree."""
    chart, n = Chart(), 9000
    for i in range(n):
        chart.read("user", f"Text {i}.", False, False)
    cost, audit, digest = chart.repaired()
    assert (cost, audit) == (n, "KR" * (n // 2))
    want = "\n".join(f"{'assistant' if i % 2 else 'user'}:Text {i}." for i in range(n))
    assert digest == hashlib.sha256(want.encode()).hexdigest()


def test_grammar_must_be_right_linear():
    with pytest.raises(ValueError):
        Grammar({"S": [("S", "u"), ()]}, "S")


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_oracle(spark, clash, seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "Hi.", "Hi.", "No\t", "Yes! ", "what", "a.b?", "\n"]
    rows = [(c, rng.choice([None, *range(7)]), rng.choice([None, "user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    duck = duckdb.connect()
    duck.register("conversations", df.toArrow())
    assert by_id(repair(clash(df)).collect()) == by_id(duck.sql(oracle()).fetchall())


def test_empty_table_and_lost_conversation(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_copies_by_the_thousand(spark):
    """Rows repeated as a whole, and one text in every turn, are duplicates of the first."""
    rows = [(1, 1, "user", "Hello.")] * 3000 + [(2, t, "user", "Hello.") for t in range(3000)]
    one, two = (tuple(r) for r in by_id(repair(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert one[1:4] in {(0, 0, 2999), (0, 0, 5999), (0, 3000, 0), (0, 0, 0)} and two[2] + two[3] > 2500
