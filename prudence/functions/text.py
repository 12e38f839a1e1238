"""Text functions over Columns: normalisation, token lists, exact match, token F1, claim checks.

All are built-in expressions, so they stay inside the JVM. White space and word characters are those of Unicode. The
three F1 functions differ in what empty token lists give and are kept apart on purpose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prudence.functions.values import variant_flag

PUNCTUATION = r"[!-/:-@\[-`{-~]"

#: Words without weight in claim checks.
CLAIM_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "from", "with", "as", "is", "are", "was", "were", "be", "been", "being",
    "do", "does", "did", "has", "have", "had", "that", "this", "these", "those", "it", "its", "their", "his", "her", "them",
)
#: Words without weight in evidence overlap.
EVIDENCE_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "of", "to", "in", "on", "at", "for", "from",
    "with", "by", "and", "or", "but", "if", "because", "while", "as", "than", "then", "also", "into", "over", "under", "between", "after", "before", "during",
    "through", "about", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "this", "that", "these", "those", "it", "its", "they", "them",
    "their", "he", "him", "his", "she", "her", "hers", "we", "us", "our", "ours", "you", "your", "yours", "i", "me", "my", "mine", "all", "any", "each", "every",
    "other", "such", "some", "many", "much", "more", "most", "few", "less", "very", "can", "could", "should", "would", "will", "may", "might", "according", "name",
)
#: Beginnings of questions, beginnings that generated claims lose, words that negate.
QUESTION_PREFIXES = ("what", "who", "when", "where", "why", "how", "which", "whose", "whom", "is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should", "has", "have", "had")
CLAIM_PREFIXES = ("statement:", "claim:", "declarative statement:", "declarative claim:", "final statement:", "answer:")
CLAIM_PREFIXES_V1 = ("statement:", "claim:", "declarative statement:", "answer:")
NEGATIONS = ("not", "no", "never", "neither", "nor", "without", "cannot")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body refers to it, inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """White space collapsed; null becomes the empty text."""
    return squeeze(F.coalesce(text, F.lit("")))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, white space collapsed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def normalize_plain(text: Column) -> Column:
    """Lower case, no ASCII punctuation, white space collapsed."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""))


def normalize_for_comparison(text: Column) -> Column:
    """Lower case, ASCII punctuation becomes a space, white space collapsed."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " "))


def tokens(normal: Column) -> Column:
    """Tokens of a normalised text; none if it is empty."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def tokenize(text: Column, drop_stopwords: bool = False) -> Column:
    """Tokens for claim checks."""
    out = tokens(normalize_for_comparison(text))
    return F.filter(out, lambda t: ~t.isin(*CLAIM_STOPWORDS)) if drop_stopwords else out


def content_words(text: Column) -> Column:
    """Distinct tokens of two or more characters that aren't stop words of evidence overlap."""
    return F.array_distinct(F.filter(tokens(normalize_plain(text)), lambda t: ~t.isin(*EVIDENCE_STOPWORDS) & (F.length(t) > 1)))


def numbered(words: Column) -> Column:
    """Words with the number of each among its equals, which makes a multiset a set."""
    return let(F.sort_array(words), lambda s: F.transform(s, lambda w, i: F.concat_ws(" ", w, (i - F.array_position(s, w)).cast("string"))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of words without spaces."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def _f1(a: Column, b: Column, both_empty: float) -> Column:
    """Harmonic mean of precision and recall of two token lists; 0 without overlap."""

    def score(shared: Column) -> Column:
        precision, recall = shared / F.size(a), shared / F.size(b)
        return F.when(shared == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))

    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, let(multiset_overlap(a, b), score)).when(F.size(a) + F.size(b) == 0, both_empty).otherwise(0.0)


def _pair_f1(prediction: Column, reference: Column, both_empty: float) -> Column:
    return let(tokens(normalize_answer(prediction)), lambda a: let(tokens(normalize_answer(reference)), lambda b: _f1(a, b, both_empty)))


def f1_or_zero(prediction: Column, reference: Column) -> Column:
    """Token F1 of two texts; 0 if either has no tokens."""
    return _pair_f1(prediction, reference, 0.0)


def overlap_f1(a: Column, b: Column) -> Column:
    """Agreement of two answers: 0 if either is empty after normalisation."""
    return f1_or_zero(a, b)


def f1_pair(prediction: Column, reference: Column) -> Column:
    """Token F1 of two texts: 1 if both have no tokens, 0 if one has none."""
    return _pair_f1(prediction, reference, 1.0)


def exact_match(prediction: Column, references: Column) -> Column:
    """1.0 if a reference equals the prediction after normalisation, 0.0 if none does or there is none."""
    return let(normalize_answer(prediction), lambda p: F.coalesce(F.exists(references, lambda r: normalize_answer(r) == p), F.lit(False)).cast("double"))


def _best(prediction: Column, references: Column, both_empty: float) -> Column:
    score = let(tokens(normalize_answer(prediction)), lambda a: F.array_max(F.transform(references, lambda r: let(tokens(normalize_answer(r)), lambda b: _f1(a, b, both_empty)))))
    return F.coalesce(score, F.lit(0.0))


def best_f1(prediction: Column, references: Column) -> Column:
    """Best token F1 over the references; 0 without references or without tokens of the prediction."""
    return _best(prediction, references, 0.0)


def best_f1_pair(prediction: Column, references: Column, drop_empty: bool = False) -> Column:
    """Best pairwise F1; with drop_empty, references that normalise to nothing are left out."""
    return _best(prediction, F.filter(references, lambda r: normalize_answer(r) != "") if drop_empty else references, 1.0)


def _share(a: Column, b: Column, empty: Column | float) -> Column:
    return F.when(F.size(a) > 0, multiset_overlap(a, b) / F.size(a)).otherwise(empty)


def token_coverage(source: Column, target: Column) -> Column:
    """Share of the source's tokens found in the target, as multisets; stop words count only if there is nothing else; 1 without tokens."""

    def weighty(words: Column) -> Column:
        return F.filter(words, lambda t: ~t.isin(*CLAIM_STOPWORDS))

    def score(a: Column, b: Column) -> Column:
        return let(weighty(a), lambda x: F.when(F.size(x) > 0, _share(x, weighty(b), 1.0)).otherwise(_share(a, b, 1.0)))

    return let(tokenize(source), lambda a: let(tokenize(target), lambda b: score(a, b)))


def copy_ratio(question: Column, claim: Column) -> Column:
    """Share of the question's tokens found in the claim, as multisets; 0 without tokens."""
    return let(tokenize(question), lambda a: let(tokenize(claim), lambda b: _share(a, b, 0.0)))


def looks_like_question(claim: Column) -> Column:
    """Ends with a question mark or begins like a question."""
    plain = clean_text(claim)
    return F.endswith(plain, F.lit("?")) | F.lower(plain).rlike(f"^({'|'.join(QUESTION_PREFIXES)}) ")


def numbers(text: Column) -> Column:
    """Numbers of a text, with one decimal part and a per cent sign that is followed by a word character."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\d+(?:[.,]\d+)?%?\b"), 0)


def numbers_preserved(answer: Column, claim: Column) -> Column:
    """Every number of the answer occurs in the claim at least as often."""
    return let(numbers(answer), lambda a: let(numbers(claim), lambda b: multiset_overlap(a, b) == F.size(a)))


def negation_preserved(question: Column, answer: Column, claim: Column) -> Column:
    """If question or answer negate, so does the claim. Apostrophes part words, so contractions never count."""
    words = F.array(*map(F.lit, NEGATIONS))
    source = tokenize(F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))))
    return ~F.arrays_overlap(source, words) | F.arrays_overlap(tokenize(claim), words)


def normalise_claim(claim: Column, prefixes: Iterable[str] = CLAIM_PREFIXES) -> Column:
    """A generated claim without its label and quotes, ending in . ! or ?"""
    plain = clean_text(claim)
    plain = F.trim(F.regexp_replace(plain, f"(?i)^({'|'.join(prefixes)})", ""))
    plain = F.btrim(plain, F.lit("\"' "))
    return F.when((plain == "") | plain.rlike(r"[.!?]$"), plain).otherwise(F.concat(plain, F.lit(".")))


def claim_template(question: Column, answer: Column) -> Column:
    return F.format_string('The answer to the question "%s" is "%s".', clean_text(question), clean_text(answer))


def qa2d_prompt(question: Column, answer: Column) -> Column:
    """Input of a question-to-claim model."""
    return F.concat_ws(". ", normalize_plain(question), normalize_plain(answer))


def answer_position(context: Column, answer: Column) -> Column:
    """Place from 0 of the first occurrence of the answer, case ignored; null if there is none or the answer is blank."""
    wanted = F.lower(F.trim(answer))
    at = F.instr(F.lower(context), wanted) - 1
    return F.when((wanted != "") & (at >= 0), at)


def evidence_window(context: Column, start: Column, end: Column, size: int = 120) -> Column:
    """Text from size characters before start to size after end, trimmed."""
    first = F.greatest(start - size, F.lit(0))
    return F.regexp_replace(F.substring(context, first + 1, end + size - first), r"(?U)^\s+|\s+$", "")


def upper_label(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def variant_reasons(value: Column, depth: int = 3) -> Column:
    """Reasons of a VARIANT in upper case with _ for spaces; blank ones are dropped.

    A text is parted by commas, semicolons and bars, unless it is JSON: then it counts as what it encodes, be that
    encoded once more. Of an object those keys count whose value is a true flag, of a list all items, each read in the
    same way down to `depth` lists within each other; deeper ones are read as texts. Other values are their text.
    """

    def label(text: Column) -> Column:
        return F.replace(F.upper(clean_text(text)), F.lit(" "), F.lit("_"))

    def decoded(v: Column) -> Column:
        """What a text encodes; Spark reads JSON up to its end and passes over what follows, so the last character must fit."""
        text = F.trim(F.try_variant_get(v, "$", "string"))
        ends = F.when(text.startswith("["), text.endswith("]")).when(text.startswith("{"), text.endswith("}")).when(text.startswith('"'), (F.length(text) > 1) & text.endswith('"')).otherwise(text.rlike(r"^(true|false|null|-?\d+(\.\d+)?([eE][+-]?\d+)?)$"))
        return F.when((F.schema_of_variant(v) == "STRING") & ends, F.coalesce(F.try_parse_json(text), v)).otherwise(v)

    def read(v: Column, left: int) -> Column:
        once = F.transform(F.array(v), lambda x: decoded(decoded(x)))

        def told(x: Column) -> Column:
            held = F.schema_of_variant(x)
            plain = F.try_variant_get(x, "$", "string")
            flags = F.try_variant_get(x, "$", "map<string,variant>")
            out = F.when(held.startswith("OBJECT"), F.transform(F.map_keys(F.map_filter(flags, lambda _, active: F.coalesce(variant_flag(active, "validity"), F.lit(False)))), label))
            if left:
                out = out.when(held.startswith("ARRAY"), F.flatten(F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda i: read(i, left - 1))))
            return out.when(held == "STRING", F.transform(F.split(plain, "[,;|]"), label)).when(held != "VOID", F.array(label(x.cast("string"))))

        return F.filter(F.coalesce(F.flatten(F.transform(once, told)), F.array().cast("array<string>")), lambda r: r != "")

    return read(value, depth)


def parse_reasons(text: Column) -> Column:
    """Reasons of a text, JSON or not, by the rules of variant_reasons."""
    return variant_reasons(F.variant_get(F.parse_json(F.to_json(F.struct(text.alias("v")))), "$.v", "variant"))


def markdown_cell(text: Column, limit: int) -> Column:
    """A text for a Markdown table: bars escaped, lines joined, cut to limit characters with an ellipsis."""
    plain = F.replace(clean_text(text), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, max(1, limit - 1))), F.lit("…")))


def first_present(columns: Iterable[str], available: Iterable[str]) -> Column:
    """First non-null of the aliases that a table has; null if it has none."""
    have = [F.col(c) for c in columns if c in set(available)]
    return F.coalesce(*have) if have else F.lit(None)
