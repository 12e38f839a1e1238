"""Token counts of the sections of documents by offset mapping.

Every document is encoded once, as a whole. The byte span of each token follows from the lengths of the tokens before
it, and a search of the sorted section bounds (an interval join inside the document) says which sections it touches.
A token that crosses a bound is given out by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudence.llm.bpe import default_vocabulary, encoder
from prudence.llm.features import released

RULES = ("first", "last", "most", "share")


def section_ends(text: bytes, separator: bytes) -> np.ndarray:
    """Byte after each section; a section keeps the separator that ends it, so the sections cover the text."""
    ends, at = [], text.find(separator)
    while at >= 0:
        ends.append(at + len(separator))
        at = text.find(separator, ends[-1])
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def attribute(token_ends: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that it touches also touch another.

    first and last: a token counts where it begins or where it ends; most: where most of its bytes are, the first on a
    tie; share: in proportion to its bytes.
    """
    begin = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)[: len(token_ends)]
    a = np.searchsorted(ends, begin, side="right")
    b = np.searchsorted(ends, token_ends - 1, side="right")
    n, crossing = len(ends), np.flatnonzero(a != b)
    edges = np.zeros(n, np.int64)
    if rule == "last":
        counts = np.bincount(b, minlength=n).astype(float)
    else:
        counts = np.bincount(a, minlength=n).astype(float)
    for t in crossing:
        edges[a[t] : b[t] + 1] += 1
        if rule in ("most", "share"):
            parts = np.diff(np.concatenate([[begin[t]], ends[a[t] : b[t]], [token_ends[t]]]))
            counts[a[t]] -= 1
            if rule == "most":
                counts[a[t] + int(np.argmax(parts))] += 1
            else:
                counts[a[t] : b[t] + 1] += parts / parts.sum()
    return counts, edges


def section_token_counts(docs: DataFrame, separator: str = "\n", rule: str = "first", vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every section of every whole text.

    Returns one row per section: doc_id, section (from 0), start_char and end_char (code points, its separator with
    it), n_tokens (double under rule share, else whole numbers), n_crossing (tokens that it shares with a neighbour).
    Null and empty texts have one empty section without tokens. Repeated rows are reported as often as they stand, an
    empty table gives an empty table, and further columns are ignored. The counts of a text add up to its tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not separator:
        raise ValueError("separator must not be empty")
    path, sep = vocabulary or default_vocabulary(), separator.encode()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if enc.n_bytes is None:
            raise ValueError("offsets need a byte-level vocabulary")
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for at, flat, starts in enc.columns(texts):
                rows: list[tuple[np.ndarray, ...]] = []
                for row in range(len(starts) - 1):
                    raw = texts[at + row].as_buffer()
                    text = raw.to_pybytes() if raw is not None else b""
                    ends = section_ends(text, sep)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[ends]
                    counts, edges = attribute(np.cumsum(enc.n_bytes[flat[starts[row] : starts[row + 1]]]), ends, rule)
                    k = len(ends)
                    rows.append((np.full(k, at + row), np.arange(k), np.concatenate([[0], chars[:-1]]), chars, counts, edges))
                row, section, first, last, counts, edges = map(np.concatenate, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(counts if rule == "share" else counts.astype(np.int64)), pa.array(edges, pa.int64())],
                    ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
                )

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, section int, start_char bigint, end_char bigint, n_tokens {'double' if rule == 'share' else 'bigint'}, n_crossing bigint"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(counted), schema)
