"""Main text of web pages: the maximum-scoring run of words and tags.

Words score positive and tags negative; what each kind scores is its log-odds of standing inside the main text, from
the labelled pages below. One linear scan finds the best contiguous region; page furniture inside it is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements whose content is never text, elements that stand in a line, and furniture.
SILENT = "script style noscript template svg title textarea select option button iframe object canvas audio video datalist"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr"
VOID = "area base br col embed hr img input link meta param source track wbr"
FURNITURE = "nav footer aside form menu dialog fieldset"
CONTENT = "article main"
#: Whole words of class, id and role that mark furniture.
HINTS = (
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "copyright discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription teaser toc toolbar alert complementary"
)
#: Inline elements that break no sentence: they score nothing, so that a picture or an emphasis can't cut off the words beside it.
QUIET = "abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strong sub sup time u var wbr"
_BLOCKS = frozenset(("section", "div", "article", "main"))
_QUIET = frozenset(x for name in QUIET.split() for x in (name, "/" + name))
_SILENT, _INLINE, _VOID, _FURNITURE, _CONTENT, _HINTS = (frozenset(x.split()) for x in (SILENT, INLINE, VOID, FURNITURE, CONTENT, HINTS))

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<silent>{'|'.join(_SILENT)})\b(?:[^>]*+\Z|[^>]*+(?<=/)>|[^>]*+>.*?(?:</(?P=silent)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|</?[a-zA-Z!?][^<>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Pages with their main text between [[ and ]]. The marks are taken out before a page is read.
LABELLED = (
    "<html><head><title>T</title></head><body><nav><ul><li><a href=x>home</a></li><li><a href=x>news</a></li><li><a href=x>sport today</a></li></ul></nav>"
    "<div class=ad>buy two of these now</div>[[<article><h1>The river rose again</h1><p>On the second day the river rose by a metre and the lower road was closed to all.</p>"
    "<p>Nobody was hurt, and by the evening most of the families had gone back to their homes.</p></article>]]<footer>&copy; 2020 the paper and its owners</footer></body></html>",
    "<body><div id=top><a href=x>sign in</a> <a href=x>help</a></div><div class=menu><a href=x>one</a><a href=x>two</a><a href=x>three</a></div>[[<div id=story><h2>A short tale</h2>"
    "<p>There was a man who kept bees at the edge of the wood, and he was never stung.<br>He said that they knew him.</p><p>When he grew old the bees grew old with him, or so the children said to each other.</p></div>]]"
    "<div class=related><h3>More</h3><ul><li><a href=x>another tale</a></li><li><a href=x>a third tale</a></li></ul></div></body>",
    "<body><header><h1>Site name</h1><p>All the best recipes</p></header><main>[[<h1>Bread</h1><p>Mix the flour with water, salt and a little yeast, then leave the dough for a night in a cool place.</p>"
    "<ul><li>a pound of flour</li><li>a pint of water</li></ul><p>Bake it in a hot oven until the crust is dark and it sounds hollow when you knock on it.</p>]]</main>"
    "<section class=comments><h3>2 comments</h3><div class=comment><p>Mine did not rise, sadly.</p></div><div class=comment><p>Great, thank you!</p></div></section><footer><a href=x>contact</a> <a href=x>imprint</a></footer></body>",
    "<body><table><tr><td><a href=x>index</a></td><td><a href=x>archive</a></td></tr></table>[[<p>In the first part of this report we set out how the data were gathered and what was left out.</p>"
    "<p>In the second part we turn to the <b>results</b>, which are <i>not</i> what we had thought they would be, and we say why.</p>]]<table><tr><td><a href=x>previous</a></td><td><a href=x>next</a></td></tr></table></body>",
    "<body><div class=cookie>we use cookies to make this site work</div><aside><ul><li><a href=x>popular now</a></li><li><a href=x>most read</a></li></ul></aside><div class=post>[[<h1>Notes</h1>"
    "<p>These are notes from a long walk over the hills, made with wet hands and a bad pencil, so forgive the gaps.</p><p>The first hut was locked. The second had no roof.</p>]]</div>"
    "<form action=x><label>your email</label><input name=e><p>sign up for our letter</p></form></body>",
)

#: Stands at both ends of the main text while weights are counted.
MARK = "\ue000"


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """(kind, text) along the page: kind is "" for text, the tag's name in lower case with / before it where it closes, or "!" for what is skipped. Tags carry their attributes as text."""
    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield "", page[at : m.start()]
        at = m.end()
        name = m["name"]
        yield (m["close"] + name.lower(), m["attrs"] or "") if name else ("!", "")
    if at < len(page):
        yield "", page[at:]


def hinted(attrs: str) -> bool:
    if "=" not in attrs:
        return False
    return any(word in _HINTS for m in NAMED.finditer(attrs) for word in (m[1] or m[2] or m[3] or "").lower().split())


def units(page: str) -> list[tuple[str, int, str, bool]]:
    """Units of the page, without the hints that would take its main text away.

    Where no article or main element is left, a hint doesn't count whose element is or holds one, or holds over half of
    the page's words outside of links.
    """
    free: set[int] = set()
    while True:
        held: dict[int, list[int]] = {}
        out = marked_units(page, free, held)
        if any(k in _CONTENT for k, _, _, f in out if not f):
            return out
        words = sum(n for k, n, _, _ in out if k.startswith("word"))
        lost = {i for i, (_, content) in held.items() if content} or {i for i, (n, _) in held.items() if 2 * n > words}
        if not lost:
            return out
        free |= lost


def marked_units(page: str, free: set[int], held: dict[int, list[int]]) -> list[tuple[str, int, str, bool]]:
    """(kind, number of words or 1, text, inside furniture) along the page; kinds: word, link, and tags by name. Where the page has an article or main element, kinds outside it end in ~. Hints of the tags numbered in free don't count; held gets, for each tag whose hint makes furniture of what wasn't, the words and article or main elements lost."""
    out: list[tuple[str, int, str, bool]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, content, number of the tag by whose hint it is furniture or -1
    standing: Counter[str] = Counter()  # open elements by name, so that stray closing tags cost no search
    boxed = 0  # open blocks that are furniture
    links, inside = 0, False
    for number, (kind, text) in enumerate(pieces(page)):
        if kind == "":
            shown = html.unescape(text)
            if n := len(shown.split()):
                out.append(("link" if links else "word", n, shown, bool(stack) and stack[-1][1]))
                if stack and stack[-1][3] >= 0 and not links:
                    held[stack[-1][3]][0] += n
            elif out:
                out.append(("", 0, shown, False))
            inside = bool(stack) and stack[-1][2]
        elif kind == "!":
            continue
        elif kind[0] == "/":
            name = kind[1:]
            if name == "a":
                links = max(0, links - 1)
            if name not in _INLINE and standing[name]:
                shut = ""
                while shut != name:
                    shut, hidden = stack.pop()[:2]
                    standing[shut] -= 1
                    boxed -= hidden and shut in _BLOCKS
            out.append((kind, 1, "", bool(stack) and stack[-1][1]))
        else:
            if kind == "a":
                links += 1
            furniture, inside, owner = stack[-1][1:] if stack else (False, False, -1)
            marked = kind not in ("body", "html") and number not in free and hinted(text)
            if kind in _CONTENT and not marked:
                if furniture and not boxed:
                    furniture, owner = False, -1  # furniture that was never closed ends where the content begins
                inside = True
            if marked and not furniture and kind not in _FURNITURE and kind != "header":
                owner = number
                held[owner] = [0, 0]
            if kind in _CONTENT and owner >= 0:
                held[owner][1] += 1
            furniture = furniture or marked or kind in _FURNITURE or kind == "header" and not inside
            if kind not in _INLINE and kind not in _VOID and kind not in ("p", "li", "dt", "dd", "tr", "td", "th") or marked and kind in ("p", "li", "td"):
                stack.append((kind, furniture, inside, owner))
                standing[kind] += 1
                boxed += furniture and kind in _BLOCKS
            links = 0 if kind in _CONTENT else links
            out.append((kind, 1, "", furniture))
        if out and out[-1][0]:
            k, n, t, f = out[-1]
            out[-1] = (k if inside else k + "~", n, t, f)
    if not any(k in _CONTENT for k, _, _, f in out if not f):
        return [(k.removesuffix("~"), n, t, f) for k, n, t, f in out]
    return out


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Score of each kind: its smoothed log-odds inside against outside the main text of LABELLED, without a sign change of words or tags."""
    inside, outside = Counter(), Counter()
    for page in LABELLED:
        before, rest = page.split("[[")
        main, after = rest.split("]]")
        cut = [0] * 2
        seen = units(before + MARK + main + MARK + after)
        for kind, n, text, furniture in seen:
            cut[0] |= MARK in text
            (inside if cut[0] and not cut[1] and not furniture else outside)[kind.removesuffix("~")] += n
            cut[1] |= MARK in text
    total_in, total_out = sum(inside.values()), sum(outside.values())
    score = {k: math.log((inside[k] + 0.5) / (total_in + 10)) - math.log((outside[k] + 0.5) / (total_out + 10)) for k in {*inside, *outside}}
    return {k: max(0.1, v) if k == "word" else min(-0.1, v) for k, v in score.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the maximum-scoring run, the first of equals; (0, 0) if nothing scores above 0."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def main_text(page: str | None) -> str:
    """Text of the best region without furniture: references decoded, white space collapsed, blocks joined by one space."""
    if not page:
        return ""
    seen, weight = units(page), weights()
    tag = min(-0.5, sum(v for k, v in weight.items() if k not in ("word", "link")) / max(1, len(weight) - 2))
    scores = []
    for kind, n, _, furniture in seen:
        name = kind.removesuffix("~")
        s = 0.0 if not name or name in _QUIET else weight.get(name, tag) * n
        if furniture:
            # furniture inside the main text costs its tags, not its words, so that it doesn't cut the text in two
            s = min(s, 0.0) * 0.25
        elif kind.endswith("~") and s > 0:
            s = -s  # a page that marks its article has no main text elsewhere
        scores.append(s)
    a, b = best_region(scores)
    if any(k.endswith("~") for k, *_ in seen):
        # the region is part of an article or main element, all of which belongs to it
        while 0 < a < b and not seen[a - 1][0].endswith("~"):
            a -= 1
        while a < b < len(seen) and not seen[b][0].endswith("~"):
            b += 1
    out = []
    for kind, _, text, furniture in seen[a:b]:
        if text and not furniture:
            out.append(text)
        elif kind.removesuffix("~").removeprefix("/") not in _INLINE or furniture:
            out.append(" ")
    return " ".join("".join(out).split())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page.

    Returns one row per input row: page_id, url, text, n_chars (code points). Null and empty pages, and pages of markup
    alone, have the empty text. Repeated rows are extracted as often as they stand, an empty table gives an empty
    table, and further columns are ignored.
    """
    kinds = dict(pages.dtypes)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(extracted, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
