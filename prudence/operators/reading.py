"""Extractive question answering over contexts of any length.

A context is cut into overlapping windows of tokens that keep their places in the text. Any reader gives each window
start and end logits; its best spans are found inside the window, and the windows' spans of a context are merged.

A context is a row, so the answering operators cut, read and merge it in one pass: a few hundred windows are held at a
time, no window leaves the task, and only a context's best few spans do. `windows` and what reads its rows give the
windows themselves; their spans are merged by a rank that Spark limits to the best few before rows move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prudence.functions.values import sigmoid
from prudence.operators.correctness import first_candidate, native_decision
from prudence.operators.entailment import by_length

#: Places of a text's tokens: begin and end of each.
Tokenizer = Callable[[str], list[tuple[int, int]]]
#: Takes the tokens of questions and windows; gives each window's start and end logits, that of no answer first.
Reader = Callable[[list[list[str]], list[list[str]]], list[tuple[np.ndarray, np.ndarray]]]
WINDOW = "window int, question_tokens array<string>, tokens array<string>, begins array<int>, ends array<int>"
#: Decimals of log scores beyond which spans count as equal.
DIGITS = 9
#: Contexts and windows that a task holds at a time.
CONTEXTS, MOST = 256, 512


def words(text: str) -> list[tuple[int, int]]:
    """Tokens between white space."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    token = np.zeros(len(code) + 2, bool)
    token[1:-1] = (code != 32) & ((code < 9) | (code > 13))
    edges = np.flatnonzero(token[1:] != token[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


@dataclass(frozen=True)
class Spec:
    """Sizes of a reading: tokens of a window with its question and marks, tokens that neighbours share, tokens of a question that are kept (None: all), tokens of an answer, spans that are kept."""

    max_length: int = 384
    stride: int = 128
    max_question: int | None = 64
    max_answer: int = 15
    top_k: int = 5
    marks: int = 3

    def cuts(self, n: int, asked: int) -> list[tuple[int, int]]:
        """Begin and end of the windows over n tokens beside a question of so many; raises where no window can move on."""
        room = self.max_length - asked - self.marks
        if room < 1 or n > room and room <= self.stride:
            raise ValueError(f"a question of {asked} tokens leaves no room for a window with a stride of {self.stride}")
        last = -(-max(n - room, 0) // (room - self.stride)) if n > room else 0
        return [(k * (room - self.stride), min(k * (room - self.stride) + room, n)) for k in range(last + 1)]


def windows(df: DataFrame, spec: Spec = Spec(), tokenize: Tokenizer = words, key: str = "row_idx", question: str = "question", context: str = "context", keep: tuple[str, ...] = (), most: int = 512) -> DataFrame:  # noqa: B008
    """Cut every context into overlapping windows: key, the columns to keep, window, question_tokens, tokens, begins, ends.

    Null questions and contexts count as empty; a context without tokens has one window without tokens. Windows leave a
    task at most `most` at a time, so a long context isn't held as windows.
    """
    taken = df.select(key, *keep, F.coalesce(F.col(question), F.lit("")).alias("_q"), F.coalesce(F.col(context), F.lit("")).alias("_c"))
    first = [key, *keep]
    names = [*first, *(f.split()[0] for f in WINDOW.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                *own, q, c = row
                asked = [q[a:b] for a, b in tokenize(q)][: spec.max_question]
                places = tokenize(c)
                for k, (a, b) in enumerate(spec.cuts(len(places), len(asked))):
                    part = places[a:b]
                    out.append((*own, k, asked, [c[x:y] for x, y in part], [x for x, _ in part], [y for _, y in part]))
                    if len(out) == most:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    kinds = dict(taken.dtypes)
    return taken.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in first), WINDOW]))


def spans(start: np.ndarray, end: np.ndarray, spec: Spec, with_null: bool) -> tuple[list[tuple[float, int, int]], float | None]:
    """The best spans of a window, (log score, first token, last token), best first, and the log score of no answer.

    Scores are products of start and end probabilities over the window's tokens, and over no answer too if asked for.
    Equal ones go by first, then last token.
    """

    def logs(x: np.ndarray) -> tuple[np.ndarray, float]:
        used = x if with_null else x[1:]
        if not len(used):
            return x[1:], 0.0
        top = used.max()
        return x[1:] - (total := top + np.log(np.exp(used - top).sum())), x[0] - total

    (s, s0), (e, e0) = logs(np.asarray(start, float)), logs(np.asarray(end, float))
    n, width = len(s), min(spec.max_answer, len(s))
    none = s0 + e0 if with_null else None
    if not n:
        return [], none
    ahead, seen = e, 1  # the best end within an answer's width of each token
    while seen < width:
        step = min(seen, width - seen)
        ahead, seen = np.maximum(ahead, np.concatenate([ahead[step:], np.full(step, -np.inf)])), seen + step
    most = s + ahead

    def near(x: float) -> float:
        """Less than anything that rounds to what x rounds to."""
        return x - 2 * 10.0**-DIGITS - abs(x) * 1e-14

    # the best spans begin at the tokens with the best span each; equal ones are told apart below
    some = np.arange(n)
    if n > spec.top_k and np.isfinite(s).all() and np.isfinite(e).all():
        some = np.flatnonzero(most >= near(np.partition(most, -spec.top_k)[-spec.top_k]))
    padded = np.concatenate([e, np.full(width, -np.inf)])
    flat = (s[some, None] + padded[some[:, None] + np.arange(width)]).ravel()
    flat = np.round(flat, DIGITS) + 0.0  # no negative zero
    k = min(spec.top_k, int(np.isfinite(flat).sum()))
    floor = np.partition(flat, -k)[-k]
    among = np.flatnonzero(flat >= floor)
    among = among[np.argsort(-flat[among], kind="stable")][:k]
    return [(float(flat[i]), int(some[i // width]), int(some[i // width] + i % width)) for i in among], none


LOGITS = "start_logits array<double>, end_logits array<double>"
SPANS = "spans array<struct<log_score: double, first: int, last: int>>, null_log double"


def _read(cut: DataFrame, load: Callable[[], Reader], batch: int, names: list[str], outputs: str, made: Callable) -> DataFrame:
    """Windows with what `made` takes from a reader's logits, without their tokens."""
    kept = [c for c in cut.columns if c not in ("question_tokens", "tokens")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = load()
        for rows in batches:
            asked, tokens = ([list(x) for x in rows[c]] for c in ("question_tokens", "tokens"))
            found = [made(*pair) for pair in logits(reader, asked, tokens, batch)]
            yield pd.concat([rows[kept], pd.DataFrame(found, columns=names, index=rows.index)], axis=1)

    kinds = dict(cut.dtypes)
    return cut.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), outputs]))


def with_logits(cut: DataFrame, load: Callable[[], Reader], batch: int = 32) -> DataFrame:
    """Windows with start_logits and end_logits; the first of each is that of no answer."""
    return _read(cut, load, batch, ["start_logits", "end_logits"], LOGITS, lambda s, e: (list(map(float, s)), list(map(float, e))))


def with_spans(cut: DataFrame, load: Callable[[], Reader], spec: Spec = Spec(), with_null: bool = False, batch: int = 32) -> DataFrame:  # noqa: B008
    """Windows with their best spans and the log score of no answer (null unless asked for)."""
    return _read(cut, load, batch, ["spans", "null_log"], SPANS, lambda s, e: spans(s, e, spec, with_null))


def logits(reader: Reader, asked: list[list[str]], tokens: list[list[str]], batch: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A reader's logits of windows, in their order; it is given windows of like length together."""
    found: list = [None] * len(asked)
    for some in by_length([len(a) + len(t) for a, t in zip(asked, tokens, strict=True)], batch):
        for i, pair in zip(some, reader([asked[i] for i in some], [tokens[i] for i in some]), strict=True):
            if len(pair[0]) != len(tokens[i]) + 1 or len(pair[1]) != len(tokens[i]) + 1:
                raise ValueError("a reader gives a logit for no answer and one for each token")
            found[i] = pair
    return found


class Best:
    """The best spans of a context over its windows, and its least log score of no answer."""

    OUTPUTS = "_spans array<struct<log_score: double, window: int, first: int, last: int, start: int, end: int>>, _null double"

    def __init__(self, spec: Spec, with_null: bool):
        self.spec, self.with_null, self.best, self.none = spec, with_null, [], None

    def add(self, window: int, asked: int, places: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> None:
        found, none = spans(start, end, self.spec, self.with_null)
        # windows come in their order and spans of a window best first, so a stable order leaves equal scores as they stand
        self.best = sorted([*self.best, *((p, window, i, j, places[i][0], places[j][1]) for p, i, j in found)], key=lambda x: -x[0])[: self.spec.top_k]
        if none is not None:
            self.none = least(self.none, float(none))

    def told(self) -> tuple:
        return [dict(zip(("log_score", "window", "first", "last", "start", "end"), x, strict=True)) for x in self.best], self.none


class Held:
    """The highest logit of a span in a context's windows that hold all of it, and the least logit of no answer."""

    OUTPUTS = "_held struct<col1: double, window: int, span: array<int>>, _null double"

    def __init__(self, spec: Spec, start: int | None, end: int | None):
        self.spec, self.start, self.end, self.held, self.none = spec, start, end, None, None

    def add(self, window: int, asked: int, places: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> None:
        self.none = least(self.none, float(start[0]) + float(end[0]))
        if self.start is None or self.end is None:
            return
        i = next((k for k, (a, b) in enumerate(places) if a <= self.start < b), None)
        j = next((k for k, (a, b) in enumerate(places) if a < self.end <= b), None)
        if i is not None and j is not None and i <= j:
            logit, shift = float(start[i + 1]) + float(end[j + 1]), asked + self.spec.marks - 1
            if self.held is None or rank(-logit) < rank(self.held[0]):
                self.held = -logit, window, [i + shift, j + shift]

    def told(self) -> tuple:
        return self.held and dict(zip(("col1", "window", "span"), self.held, strict=True)), self.none


def rank(x: float) -> tuple[bool, float]:
    """Spark's order of doubles: what isn't a number comes last."""
    return x != x, x


def least(x: float | None, y: float) -> float:
    return y if x is None else min(x, y, key=rank)


def read_contexts(df: DataFrame, load: Callable[[], Reader], merged: Callable[..., Best | Held], outputs: str, spec: Spec = Spec(), tokenize: Tokenizer = words, question: str = "question", context: str = "context", given: tuple[str, ...] = (), batch: int = 32) -> DataFrame:  # noqa: B008
    """Every row with what its context's windows come to: each is cut, read and merged in one pass, a few windows at a time.

    `merged` takes the row's given columns, meets every window of its context in order, and tells the outputs.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL(outputs).fields])
    made = to_arrow_schema(StructType.fromDDL(outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = load()

        def look(waiting: list[tuple]) -> None:
            for (out, k, places, asked, _), pair in zip(waiting, logits(reader, [w[3] for w in waiting], [w[4] for w in waiting], batch), strict=True):
                out.add(k, len(asked), places, *pair)

        for rows in batches:
            for at in range(0, rows.num_rows, CONTEXTS):
                part = rows.slice(at, CONTEXTS)
                outs = [merged(*own) for own in zip(*(part.column(c).to_pylist() for c in given), strict=True)] if given else [merged() for _ in range(part.num_rows)]
                waiting: list[tuple] = []
                for out, q, c in zip(outs, part.column(question), part.column(context), strict=True):
                    q, c = q.as_py() or "", c.as_py() or ""
                    asked = [q[a:b] for a, b in tokenize(q)][: spec.max_question]
                    places = tokenize(c)
                    tokens = [c[a:b] for a, b in places]
                    for k, (a, b) in enumerate(spec.cuts(len(places), len(asked))):
                        waiting.append((out, k, places[a:b], asked, tokens[a:b]))
                        if len(waiting) == MOST:
                            look(waiting)
                            waiting = []
                look(waiting)
                told = zip(*(out.told() for out in outs), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, f.type) for x, f in zip(told, made, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def read_spans(df: DataFrame, load: Callable[[], Reader], spec: Spec = Spec(), tokenize: Tokenizer = words, question: str = "question", context: str = "context", with_null: bool = False, batch: int = 32) -> DataFrame:  # noqa: B008
    """Every row with the best spans of its context, _spans, and the least log score of no answer, _null (null unless asked for)."""
    return read_contexts(df, load, lambda: Best(spec, with_null), Best.OUTPUTS, spec, tokenize, question, context, (), batch)


def best_spans(df: DataFrame, load: Callable[[], Reader], spec: Spec = Spec(), tokenize: Tokenizer = words, key: str = "row_idx", question: str = "question", context: str = "context", batch: int = 32) -> DataFrame:  # noqa: B008
    """What n_best gives of the contexts' windows, which never leave their task."""
    texts = df.select(key, F.col(question).alias("_q"), F.col(context).alias("_c"))
    long = read_spans(texts, load, spec, tokenize, "_q", "_c", False, batch).select(key, F.inline("_spans"))
    best = W.partitionBy(key).orderBy(F.desc("log_score"), "window", "first", "last")
    return long.select(key, "window", "first", "last", "log_score", "start", "end").withColumn("place", F.row_number().over(best)).where(F.col("place") <= spec.top_k)


def n_best(read: DataFrame, top_k: int = 5, key: str = "row_idx") -> DataFrame:
    """The best spans of each context over all its windows: key, place (from 1), log_score, start, end, window, first, last.

    Equal scores go by window, then first and last token; a span that several windows see counts once for each, as in
    the windows. The rank is limited inside each task before rows are dealt by key.
    """
    long = read.select(key, "window", "begins", "ends", F.inline("spans"))
    long = long.select(key, "window", "first", "last", "log_score", F.get("begins", F.col("first")).alias("start"), F.get("ends", F.col("last")).alias("end"))
    best = W.partitionBy(key).orderBy(F.desc("log_score"), "window", "first", "last")
    return long.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top_k)


def answer_text(context: Column, start: Column, end: Column) -> Column:
    return F.substring(context, start + 1, end - start)


def forced_answers(df: DataFrame, load: Callable[[], Reader], spec: Spec = Spec(), tokenize: Tokenizer = words, key: str = "row_idx", question: str = "question", context: str = "context", strict: bool = True, batch: int = 32) -> DataFrame:  # noqa: B008
    """Answer every question with the best span that has text: prediction_text, pipeline_score, start, end, decision.

    No answer isn't a choice. A context without a usable span raises, or leaves nulls if not strict. Keys must differ;
    rows that share one get the answer that counts best under it.
    """
    best = best_spans(df, load, spec, tokenize, key, question, context, batch)
    found = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "start", "end", "log_score"))).alias("_s")).withColumnRenamed(key, "_key")
    out = df.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    listed = F.transform(F.coalesce("_s", F.array().cast("array<struct<place: int, start: int, end: int, log_score: double>>")), lambda x: F.struct(answer_text(F.col(context), x["start"], x["end"]).alias("answer"), F.exp(x["log_score"]).alias("score"), x["start"].alias("start"), x["end"].alias("end")))
    chosen = first_candidate(listed) if strict else F.get(F.filter(listed, lambda c: (F.trim(c["answer"]) != "") & (c["end"] > c["start"])), F.lit(0))
    out = out.withColumn("_a", chosen)
    return out.withColumns({"prediction_text": F.col("_a.answer"), "pipeline_score": F.col("_a.score"), "start": F.col("_a.start"), "end": F.col("_a.end"), "decision": F.lit("ANSWER")}).drop("_key", "_s", "_a")


def native_answers(df: DataFrame, load: Callable[[], Reader], spec: Spec = Spec(), tokenize: Tokenizer = words, key: str = "row_idx", question: str = "question", context: str = "context", batch: int = 32) -> DataFrame:  # noqa: B008
    """Answer, or abstain where the least log score of no answer over the windows is above the best span's: prediction_text (empty), pipeline_score, start, end, decision.

    The score is that of what was chosen; without tokens it is that of no answer.
    """
    read = read_spans(df, load, spec, tokenize, question, context, True, batch)
    first = F.get("_spans", F.lit(0))
    shared = W.partitionBy(key)
    # a context's first span is its best, so the least struct of a key is its best
    out = read.withColumn("_s", F.struct(-first["log_score"], first["window"].alias("window"), first["first"], first["last"], first["start"].alias("start"), first["end"].alias("end")))
    out = out.withColumn("_s", F.min(F.when(first.isNotNull(), F.col("_s"))).over(shared)).withColumn("_n", F.min(F.round("_null", DIGITS)).over(shared))
    log_score = -F.col("_s")["col1"]
    chosen = F.coalesce(log_score >= F.col("_n"), F.lit(False))
    out = out.withColumn("prediction_text", F.when(chosen, F.trim(answer_text(F.col(context), F.col("_s.start"), F.col("_s.end")))).otherwise(""))
    out = out.withColumns({"pipeline_score": F.exp(F.when(chosen, log_score).otherwise(F.col("_n"))), "start": F.when(chosen, F.col("_s.start")).otherwise(0), "end": F.when(chosen, F.col("_s.end")).otherwise(0)})
    return out.withColumn("decision", native_decision(F.col("prediction_text"))).drop("_spans", "_null", "_s", "_n")


def span_confidence(df: DataFrame, load: Callable[[], Reader], spec: Spec = Spec(), tokenize: Tokenizer = words, key: str = "row_idx", question: str = "question", context: str = "context", start: str = "start", end: str = "end", strict: bool = True, batch: int = 32) -> DataFrame:  # noqa: B008
    """How much more an answer's span weighs than no answer: answer_span_logit, null_logit, answer_null_margin, confidence, confidence_chunk, confidence_token_span.

    Of the windows that hold the whole span the highest logit counts, the first among equals; of no answer the least
    logit of all windows. The token span counts from the window's first mark. A span that no window holds raises, or
    leaves nulls if not strict.
    """
    read = read_contexts(df, load, lambda a, b: Held(spec, a, b), Held.OUTPUTS, spec, tokenize, question, context, (start, end), batch)
    shared = W.partitionBy(key)
    out = read.withColumn("_b", F.min("_held").over(shared)).withColumn("_n", F.min("_null").over(shared))
    found = -F.col("_b")["col1"]
    if strict:
        found = F.when(F.col("_b").isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no window holds the answer's span: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("double"))
    out = out.withColumns({"answer_span_logit": found, "null_logit": F.col("_n"), "confidence_chunk": F.col("_b.window"), "confidence_token_span": F.col("_b.span")})
    out = out.withColumn("answer_null_margin", F.col("answer_span_logit") - F.col("null_logit")).withColumn("confidence", sigmoid(F.col("answer_null_margin")))
    return out.withColumns({"confidence_type": F.lit("uncalibrated_answer_vs_null"), "confidence_is_calibrated": F.lit(False)}).drop("_held", "_null", "_b", "_n")


#: Tokens on either side in which the lexical reader looks for words of the question.
NEAR = 8


def lexical_reader() -> Reader:
    """A reader without a trained model: spans that begin after and end before words of the question weigh most, words of the question themselves least."""

    def read(asked: list[list[str]], tokens: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        # one pass over the batch's tokens end to end; low and high are where each token's own window begins and ends
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        stops = np.cumsum(sizes)
        known = ({t.lower() for t in question} for question in asked)
        hit = np.fromiter(chain.from_iterable(map(k.__contains__, map(str.lower, window)) for k, window in zip(known, tokens, strict=True)), float, int(sizes.sum()))
        size = np.fromiter(map(len, chain.from_iterable(tokens)), np.int64, len(hit))
        total = np.concatenate([[0.0], np.cumsum(hit)])
        i, low, high = np.arange(len(hit)), np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
        before = total[i] - total[np.maximum(i - NEAR, low)]
        after = total[np.minimum(i + NEAR + 1, high)] - total[i + 1]
        none = 2 + (total[stops] - total[stops - sizes]) / 32
        start = before + after / 2 - 2 * hit + size % 7 / 7
        end = after + before / 2 - 2 * hit + size % 5 / 5
        return [(np.concatenate([[x], start[b - n : b]]), np.concatenate([[x], end[b - n : b]])) for x, b, n in zip(none, stops, sizes, strict=True)]

    return read
