"""Entailment models: labels resolved by name, batches of like length, and a model without training."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: What every model must tell apart, in the order of results.
CLASSES = ("entailment", "neutral", "contradiction")


@dataclass(frozen=True)
class EntailmentModel:
    """A model's labels by class number, and its logits: a row of them for each premise and hypothesis."""

    id2label: Mapping[int | str, str]
    logits: Callable[[list[str], list[str]], np.ndarray]


def label_ids(id2label: Mapping[int | str, str], exact: bool = False) -> list[int]:
    """Class numbers of CLASSES by the names that the model gives, whatever their order.

    Names hold the stem of a class, or must equal it if exact; case and outer white space are ignored. A class that no
    label names raises; of several labels that name one the last counts, the first if exact.
    """
    plain = {int(k): str(v).strip().lower() for k, v in id2label.items()}
    found = {}
    for k, name in reversed(list(plain.items())) if exact else plain.items():
        if exact:
            found |= {c: k for c in CLASSES if name == c}
        elif stem := next((c for c in CLASSES if {"entailment": "entail", "neutral": "neutral", "contradiction": "contrad"}[c] in name), None):
            found[stem] = k
    if missing := [c for c in CLASSES if c not in found]:
        raise ValueError(f"no label for {', '.join(missing)} among {dict(id2label)}")
    return [found[c] for c in CLASSES]


def by_length(sizes: list[int], batch: int) -> Iterator[np.ndarray]:
    """Indices in batches of rows of like size, longest first, so that little is padded whatever the order of rows."""
    if batch < 1:
        raise ValueError("a batch has a row or more")
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    for at in range(0, len(order), batch):
        yield order[at : at + batch]


def softmax(logits: np.ndarray) -> np.ndarray:
    x = np.exp(logits - logits.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def with_entailment(df: DataFrame, load: Callable[[], EntailmentModel | Callable], premise: str, hypothesis: str, names: tuple[str, str, str], exact: bool = False, batch: int = 32, where: str | None = None) -> DataFrame:
    """Add the probabilities of entailment, neutrality and contradiction under the given names; columns of those names are replaced.

    The model is loaded once a worker and its labels are resolved before the first row. A plain function in a model's
    place gives the three probabilities of each pair in this order. Where a flag is named, the model sees only rows
    whose flag is true; the others' probabilities are 0.
    """
    kept = df.drop(*names)
    columns = kept.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        if isinstance(model, EntailmentModel):
            ids = label_ids(model.id2label, exact)
            told = lambda p, c: softmax(np.asarray(model.logits(p, c), float))[:, ids]
        else:
            told = lambda p, c: np.asarray(model(p, c), float)
        for rows in batches:
            asked = np.flatnonzero(rows[where].eq(True)) if where else np.arange(len(rows))
            premises, claims = (rows[c].iloc[asked].tolist() for c in (premise, hypothesis))
            found = np.zeros((len(rows), len(CLASSES)))
            for some in by_length([len(p) + len(c) for p, c in zip(premises, claims, strict=True)], batch):
                found[asked[some]] = told([premises[i] for i in some], [claims[i] for i in some])
            yield pd.concat([rows[columns], pd.DataFrame(found, columns=list(names), index=rows.index)], axis=1)

    return kept.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), *(f"`{n}` double" for n in names)]))


def lexical_entailment() -> EntailmentModel:
    """A model without training: the share of a claim's different words that its premise has, in lower case between white space."""

    def words(text: str) -> set[str]:
        return set(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))

    def logits(premises: list[str], claims: list[str]) -> np.ndarray:
        out = []
        for p, c in zip(premises, claims, strict=True):
            asked = words(c)
            share = len(asked & words(p)) / len(asked) if asked else 0.0
            out.append((2 - 4 * share, 8 * share - 4, 0.5))
        return np.array(out).reshape(-1, 3)

    return EntailmentModel({0: "CONTRADICTION", 1: "ENTAILMENT", 2: "NEUTRAL"}, logits)
