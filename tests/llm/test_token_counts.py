import numpy as np
import pytest

from prudence.llm.bpe import TextEncoder, default_vocabulary
from prudence.llm.token_counts import attribute, section_token_counts

TEXTS = ["", None, "one\ntwo\n\nthree", "\n", "é漢\U0001f600\nü", "a" * 5000 + "\n" + "b c " * 400, "tail\n", "\r\n\r\n x \n\n\n y"]


def brute(enc, text, rule):
    raw, ends, at = (text or "").encode(), [], 0
    for line in raw.split(b"\n"):
        at += len(line) + 1
        ends.append(min(at, len(raw)))
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    counts, at = [0.0] * len(ends), 0
    for i in enc.whole.encode(text or "", add_special_tokens=False).ids:
        size = int(enc.n_bytes[i])
        owners = [next(s for s, e in enumerate(ends) if p < e) for p in range(at, at + size)]
        share = {s: owners.count(s) for s in sorted(set(owners))}
        if rule == "share":
            for s, k in share.items():
                counts[s] += k / size
        else:
            counts[owners[0] if rule == "first" else owners[-1] if rule == "last" else max(share, key=lambda s: (share[s], -s))] += 1
        at += size
    return counts


@pytest.mark.parametrize("rule", ["first", "last", "most", "share"])
def test_equals_brute_force(spark, clash, rule):
    enc = TextEncoder(default_vocabulary())
    df = clash(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    got = {}
    for r in section_token_counts(df, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        assert [r.n_tokens for r in got[i]] == pytest.approx(brute(enc, t, rule))
        assert got[i][0].start_char == 0 and got[i][-1].end_char == len(t or "")
        assert "".join((t or "")[r.start_char : r.end_char] for r in got[i]) == (t or "")


def test_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert section_token_counts(df).count() == 2 and section_token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        section_token_counts(df, rule="none")
    counts, edges = attribute(np.array([4]), np.array([2, 4]), "most")
    assert counts.tolist() == [1, 0] and edges.tolist() == [1, 1]
