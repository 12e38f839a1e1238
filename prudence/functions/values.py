"""Numbers, flags and checks over Columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that each kind of flag accepts.
TRUE_WORDS = {"answerability": ("true", "1", "yes"), "correctness": ("true", "1", "yes", "correct", "1.0"), "decision": ("true", "1", "yes", "correct"), "validity": ("true", "yes", "correct", "1", "1.0", "valid")}
FALSE_WORDS = {"answerability": ("false", "0", "no"), "correctness": ("false", "0", "no", "incorrect", "0.0"), "decision": ("false", "0", "no", "incorrect"), "validity": ("false", "no", "incorrect", "0", "0.0", "invalid")}


def flag(value: Column, kind: str, strict: bool = False) -> Column:
    """Boolean of a value that may be a boolean, a number or a word; other values are null, or raise if strict."""
    word = F.lower(F.trim(value.cast("string")))
    out = F.when(word.isin(*TRUE_WORDS[kind]), True).when(word.isin(*FALSE_WORDS[kind]), False)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"not a flag of {kind}: "), F.coalesce(word, F.lit("null")))).cast("boolean")) if strict else out


def _unread(kind: str, shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a flag of {kind}: "), F.coalesce(shown, F.lit("null")))).cast("boolean")


def _word_flag(word: Column, kind: str) -> Column:
    word = F.lower(F.trim(word))
    return F.when(word.isin(*TRUE_WORDS[kind]), True).when(word.isin(*FALSE_WORDS[kind]), False)


def _whole_flag(x: Column) -> Column:
    return F.when(x == 1, True).when(x == 0, False)


def _real_flag(x: Column, kind: str) -> Column:
    """Answerability takes no fractions; correctness takes what is within a billionth of 1."""
    if kind == "answerability":
        return F.lit(None).cast("boolean")
    one = F.abs(x - 1) <= 1e-9 * F.greatest(F.abs(x), F.lit(1.0)) if kind == "correctness" else x == 1
    return F.when(one, True).when(x == 0, False)


def variant_flag(value: Column, kind: str, strict: bool = False) -> Column:
    """Boolean of a VARIANT by what it holds: a boolean, a whole number, a fraction or a word, each by the rules of the kind; null or an error for the rest."""
    held = F.schema_of_variant(value)
    out = (
        F.when(held == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(held == "BIGINT", _whole_flag(F.try_variant_get(value, "$", "bigint")))
        .when(held.startswith("DECIMAL") | held.isin("DOUBLE", "FLOAT"), _real_flag(F.try_variant_get(value, "$", "double"), kind))
        .when(held == "STRING", _word_flag(F.try_variant_get(value, "$", "string"), kind))
    )
    return F.coalesce(out, _unread(kind, value.cast("string"))) if strict else out


def flag_column(df: DataFrame, name: str, kind: str, strict: bool = False) -> Column:
    """Boolean of a column by its type: boolean, whole number, fraction, text or VARIANT. Other types have none."""
    x, held = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if held == "variant":
        return variant_flag(x, kind, strict)
    if held == "boolean":
        out = x
    elif held in ("tinyint", "smallint", "int", "bigint"):
        out = _whole_flag(x)
    elif held in ("float", "double") or held.startswith("decimal"):
        out = _real_flag(x.cast("double"), kind)
    elif held == "string":
        out = _word_flag(x, kind)
    else:
        out = F.lit(None).cast("boolean")
    return F.coalesce(out, _unread(kind, x.cast("string"))) if strict else out


def finite(value: Column) -> Column:
    """The value as a double; null where it isn't a finite number."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def first_finite(values: Iterable[Column]) -> Column:
    """First value that is a finite number; others are passed over."""
    return F.coalesce(*map(finite, values))


def in_range(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Whether a value is a finite number within the bounds; false for null."""
    return F.coalesce(finite(value).between(low, high), F.lit(False))


def checked(value: Column, name: str, low: float = 0.0, high: float = 1.0) -> Column:
    """The value, or an error where it isn't finite or lies outside the bounds."""
    return F.when(in_range(value, low, high), value.cast("double")).otherwise(F.raise_error(F.lit(f"{name} must lie between {low} and {high}")).cast("double"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole, or `empty` where whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole).otherwise(F.lit(empty).cast("double"))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def logit_loss(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def log_loss(p: Column, y: Column, edge: float = 1e-12) -> Column:
    """Binary cross-entropy of a probability kept away from 0 and 1."""
    q = clamp(p, edge, 1 - edge)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def geometric_mean(a: Column, b: Column) -> Column:
    return F.sqrt(a * b)


def weighted_geometric_mean(a: Column, b: Column, alpha: Column) -> Column:
    """exp(alpha ln a + (1 - alpha) ln b): exactly a at 1 and b at 0; 0 if either is 0 in between."""
    inner = F.exp(alpha * F.log(F.greatest(a, F.lit(5e-324))) + (1 - alpha) * F.log(F.greatest(b, F.lit(5e-324))))
    return F.when(alpha == 1, a).when(alpha == 0, b).when((a == 0) | (b == 0), 0.0).otherwise(inner)


def signed_to_unit(score: Column) -> Column:
    """Score of [-1, 1] as one of [0, 1]."""
    return (score + 1) / 2


def gated(valid: Column, score: Column) -> Column:
    """0 where the claim isn't valid; null validity raises."""
    return F.when(valid, score).when(~valid, 0.0).otherwise(F.raise_error(F.lit("claim validity is missing")).cast("double"))


def place_among(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the rising bounds aren't over the value, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.expr(f"array({', '.join(f"double('{b!r}')" for b in bounds)})")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))
