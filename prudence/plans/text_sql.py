"""DuckDB SQL of the text functions, for oracles. Articles are taken out token by token."""

from __future__ import annotations

from prudence.functions import text as T

_SPACE = r"[\s\x{a0}\x{3000}]+"


def _split(x: str) -> str:
    return f"string_split_regex({x}, '{_SPACE}')"


def _bare(x: str, by: str = "") -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '{by}', 'g')"


def plain_tokens(x: str) -> str:
    return f"list_filter({_split(_bare(x))}, lambda w: w <> '')"


def answer_tokens(x: str) -> str:
    return f"list_filter({_split(_bare(x))}, lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def claim_tokens(x: str, drop: bool = False) -> str:
    words = ("", *T.CLAIM_STOPWORDS) if drop else ("",)
    return f"list_filter({_split(_bare(x, ' '))}, lambda w: w NOT IN ({', '.join(repr(w) for w in words)}))"


def content_words(x: str) -> str:
    return f"list_distinct(list_filter({_split(_bare(x))}, lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in T.EVIDENCE_STOPWORDS)})))"


def shared(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda v: v = w)), len(list_filter({b}, lambda v: v = w))))), 0)"


def f1(x: str, y: str, both_empty: int) -> str:
    """Token F1 of two texts; both_empty is what two texts without tokens give."""
    return f"list_transform([{{'a': {answer_tokens(x)}, 'b': {answer_tokens(y)}}}], lambda p: {f1_of('p.a', 'p.b', both_empty)})[1]"


def f1_of(a: str, b: str, both_empty: int) -> str:
    score = f"CASE WHEN s = 0 THEN 0e0 ELSE 2 * (s / len({a})) * (s / len({b})) / (s / len({a}) + s / len({b})) END"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {both_empty}e0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE list_transform([{shared(a, b)}], lambda s: {score})[1] END"


def best_f1(x: str, refs: str, both_empty: int = 0) -> str:
    return f"coalesce(list_max(list_transform({refs}, lambda y: {f1(x, 'y', both_empty)})), 0.0)"


def exact_match(x: str, refs: str) -> str:
    return f"CASE WHEN len(list_filter({refs}, lambda y: {answer_tokens('y')} = {answer_tokens(x)})) > 0 THEN 1e0 ELSE 0e0 END"


def error_type(can: str, em: str, score: str) -> str:
    return f"CASE WHEN NOT {can} THEN 'UNANSWERABLE_FORCED_ANSWER_CANDIDATE' WHEN {em} = 1 THEN 'CORRECT_EXACT' WHEN {score} >= 0.8 THEN 'MINOR_SPAN_MISMATCH' WHEN {score} >= 0.5 THEN 'PARTIAL_ANSWER' ELSE 'WRONG_ANSWER' END"


def _numbers(x: str) -> str:
    return f"regexp_extract_all({x}, '\\b\\d+(?:[.,]\\d+)?%?\\b')"


def numbers_kept(a: str, c: str) -> str:
    x, y = _numbers(a), _numbers(c)
    return f"len(list_filter(list_distinct({x}), lambda w: len(list_filter({y}, lambda v: v = w)) < len(list_filter({x}, lambda v: v = w)))) = 0"


def negation_kept(q: str, a: str, c: str) -> str:
    terms = f"[{', '.join(repr(w) for w in T.NEGATIONS)}]"
    return f"(NOT list_has_any({claim_tokens(f'{q} || chr(32) || {a}')}, {terms}) OR list_has_any({claim_tokens(c)}, {terms}))"


def asks(c: str) -> str:
    clean = f"trim(regexp_replace({c}, '{_SPACE}', ' ', 'g'))"
    return f"(ends_with({clean}, '?') OR regexp_matches(lower({clean}), '^({'|'.join(T.QUESTION_PREFIXES)}) '))"


def claim_fields(q: str, a: str, c: str) -> str:
    """coverage, copied, n and reasons of a claim."""
    x, y, p, r = claim_tokens(a, True), claim_tokens(c, True), claim_tokens(a), claim_tokens(c)
    coverage = f"CASE WHEN len({x}) > 0 THEN {shared(x, y)} / len({x}) WHEN len({p}) > 0 THEN {shared(p, r)} / len({p}) ELSE 1.0 END"
    s = claim_tokens(q)
    copied = f"CASE WHEN len({s}) > 0 THEN {shared(s, r)} / len({s}) ELSE 0.0 END"
    tests = (
        (f"trim({c}) = ''", "EMPTY_CLAIM"), (asks(c), "QUESTION_FORM"), (f"len({p}) > 0 AND {r} = {p}", "ANSWER_ONLY_FRAGMENT"), (f"len({s}) > 0 AND {r} = {s}", "QUESTION_REPEATED"), (f"len({r}) < 4", "TOO_SHORT"),
        (f"({coverage}) < 0.8", "ANSWER_NOT_PRESERVED"), (f"NOT {numbers_kept(a, c)}", "NUMBER_NOT_PRESERVED"), (f"NOT {negation_kept(q, a, c)}", "NEGATION_NOT_PRESERVED"), (f"({copied}) >= 0.98 AND {asks(c)}", "EXCESSIVE_QUESTION_COPY"),
    )
    reasons = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + "], lambda z: z IS NOT NULL)"
    return f"{coverage} AS coverage, {copied} AS copied, len({r}) AS n, {reasons} AS reasons"


def window(context: str, start: str, end: str, size: int = 120) -> str:
    first = f"greatest({start} - {size}, 0)"
    return f"substring({context}, {first} + 1, {end} + {size} - {first})"


def overlap(a: str, b: str) -> str:
    x = content_words(a)
    return f"CASE WHEN len({x}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {content_words(b)})) / len({x}) END"


def context_score(a: str, c: str) -> str:
    x, y = (f"array_to_string({plain_tokens(t)}, ' ')" for t in (a, c))
    return f"CASE WHEN {x} = '' THEN 0.0 WHEN contains({y}, {x}) THEN 1.0 ELSE {overlap(a, c)} END"
