import pytest

from prudence.llm.html_text import best_region, extract_text, main_text

ARTICLE = "<h1>Storm on the coast</h1><p>The storm came in at night &amp; took the pier with it,<br>as it had once before.</p><p>By <b>mor</b>ning the sea was&nbsp;calm again, and people came to look at what was left of it."
WANT = "Storm on the coast The storm came in at night & took the pier with it, as it had once before. By morning the sea was calm again, and people came to look at what was left of it."
PAGES = [
    f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- ad --><div class='ad'>Buy now</div><article>{ARTICLE}</article><footer>&copy; us</footer>",
    f"<body><header><p>The daily paper of the town</p></header><div class='notice'>We use cookies on this site, please agree to that.</div><main>{ARTICLE}</main><aside><p>Most read this week of all</p></aside></body>",
    f"<body><nav><a>one</a><article>{ARTICLE}<form><p>Subscribe to our letter now</p></form></article><section id='comments'><article class='comment'><p>What a sad thing to read about this morning, really.</p></article></section></body>",
    f"<div id='wrap'><div class='menu'><a>a</a> <a>b</a></div><div class='content'>{ARTICLE}</div></div><div class='sidebar'><p>Weather for today is fair</p></div></div>",
    f"<body><article>{ARTICLE}</p><div class='advert'>Half price boats</div></article></body>",
]


@pytest.mark.parametrize("page", PAGES)
def test_article_is_found(page):
    assert main_text(page) == WANT


def test_best_region_equals_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_edges(spark, clash):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "2 < 3 & 4"), (4, "u", "2 < 3 & 4"), (None, "u", "<a><b"), (5, "u", "<p>" + "word " * 50_000)]
    out = extract_text(clash(spark.createDataFrame(rows, "page_id long, url string, html string")))
    got = sorted(((r.page_id or 0), r.text[:20], r.n_chars) for r in out.collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (3, "", 0), (4, "2 < 3 & 4", 9), (4, "2 < 3 & 4", 9), (5, "word word word word ", 249_999)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='layout has-sidebar'><article>{ARTICLE}</article></div><div class='ad'>Buy now</div>",
        f"<body><div class='no-sidebar'>{ARTICLE}</div><div class='sidebar'><p>Weather for today is fair</p></div>",
        f"<body><nav><a>one</a></nav><main class='search-results'>{ARTICLE}</main>",
        f"<body><div class='social'><article>{ARTICLE}</article></div><div class='ad'>Buy now</div>",
        f"<body><main class='search'>{ARTICLE}</main><div class='ad'>Buy now</div>",
        f"<body><div class='modal'><div class='notice'>{ARTICLE}</div></div><div class='ad'>Buy now</div>",
    ],
)
def test_hints_do_not_remove_the_article(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><nav><a>one</a></nav><article class='share'>{ARTICLE}</article>", WANT),
        (f"<body><article><div class='article-header'><h1>Flood</h1></div><p class='byline'>By A. Writer</p>{ARTICLE}</article>", "Flood By A. Writer " + WANT),
        (f"<body><article><p>Let <math><mi>x</mi></math> be it.</p>{ARTICLE}</article>", "Let x be it. " + WANT),
        (f"<body><nav><a>one</a></nav><article><p>foo<img src=a>bar went on and on.</p>{ARTICLE}</article>", "foo bar went on and on. " + WANT),
        (f"<body><nav><a>one</a></nav><article>{ARTICLE}</p><p><a href=x>The whole report is here</a></p><p>It ends.</p></article><footer>us</footer>", WANT + " The whole report is here It ends."),
    ],
)
def test_nothing_of_the_article_is_lost(page, want):
    assert main_text(page) == want


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<script " * 80_000, "<div>" * 40_000 + "</p></section>" * 40_000 + "words of it", "<style a" * 50_000 + ">", "<!-- " * 80_000, "<a <b " * 60_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 8
