import random
import zlib

import numpy as np
import pytest

from prudence.llm.bpe import TextEncoder, default_vocabulary
from prudence.llm.packing import cuts, pack, plan

ODD = ["", None, "a  b", " x", "x ", "\n\n a\tb \n c", "don't 'll 12 3a b  c", "<|endoftext|> a b", "é" * 10 + " \U0001f600 z", "a\n b", "a \nb", "x" * 9000, "word " * 3000, " \xa0 a　b"]


def test_column_ids_equal_the_tokenizer(hypothesis_texts=200):
    import pyarrow as pa

    enc, rng = TextEncoder(default_vocabulary()), random.Random(7)
    made = ["".join(rng.choices(" \n\tabcXYZ019.,!'éß漢\U0001f600\xa0", k=rng.randint(0, 60))) for _ in range(hypothesis_texts)]
    texts, got = [*ODD, *made], []
    for _, flat, starts in enc.columns(pa.array(texts)):
        got += [flat[starts[i] : starts[i + 1]].tolist() for i in range(len(starts) - 1)]
    assert got == [enc.whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [9, 64, 2048])
def test_plan_places_every_item_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {rng.randint(1, capacity): rng.randint(0, 30) for _ in range(rng.randint(1, 30))}
        rows, made = plan(counts, capacity)
        bins, seen = {}, dict.fromkeys(counts, 0)
        for length, lo, hi, first, each, base in rows:
            assert lo == seen[length]
            seen[length] = hi
            for k in range(hi - lo):
                bins.setdefault(first + k // each, []).append((base + k % each * length, length))
        assert seen == counts and len(bins) == made
        for items in bins.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        # no more than first-fit decreasing may need
        assert made <= 11 / 9 * -(-sum(k * n for k, n in counts.items()) // capacity) + sum(n for k, n in counts.items() if 2 * k > capacity) + 1


def test_large_items_are_matched_at_most_twice():
    rows, made = plan({700: 5, 1300: 2, 1000: 2}, 2048)
    assert made == 5


def test_cuts():
    assert cuts(4097, 2048) == [0, 1, 2049] and cuts(4096, 2048) == [0, 2048] and cuts(5, 2048) == [0] and cuts(2048, 2048) == [0]


def test_round_trip(spark, clash):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "nobody")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    enc = TextEncoder(default_vocabulary())
    out = pack(df, with_ids=True).collect()
    by_doc = {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(ODD):
        if i != 3:
            pieces = sorted(by_doc[i], key=lambda r: r.piece)
            assert sum((p.ids for p in pieces), []) == [*enc.whole.encode(t or "", add_special_tokens=False).ids, 0]
            assert [p.start for p in pieces] == cuts(sum(p.length for p in pieces), 2048)
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(df.limit(0)).count() == 0
