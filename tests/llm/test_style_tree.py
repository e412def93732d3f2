"""Style tree: small hosts, class words as a prior, several articles, hidden branches, boxes inside articles."""

import pytest

from fieldlens.llm import html_tree

LONG = "This sentence is the prose of page {0} and it says what number {0} means to its readers."


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def by_rule(*pages):
    """Texts of pages that stand alone on their hosts, without the style tree."""
    return ["\n".join(b.text for b in html_tree.main_blocks(list(html_tree.parse(p)), set(), set())) for p in pages]


def test_hosts_of_any_size_lose_their_frames(spark):
    """Hosts of 1 to 12 pages, one style: the small ones borrow from the others; another style on one page stays."""
    rows, want = [], {}
    for n in (1, 2, 3, 7, 8, 12):
        for i in range(n):
            d = len(rows)
            rows.append((d, f"http://h{n}/{i}", f"<div class=top>Site {n} since 1999</div><div class=text><p>{LONG.format(d)}</p></div>"))
            want[d] = LONG.format(d)
    rows.append((900, "http://alone/", f"<div class=other>Only once</div><p>{LONG.format(900)}</p>"))
    want[900] = "Only once\n" + LONG.format(900)
    # boxes of an article: the same notice on each page goes; repeated headings, paragraphs and table heads stay
    for i in range(9):
        d = 1000 + i
        rows.append((d, f"http://boxes/{i}", f"<article><h1>T {d}</h1><h2>Summary</h2><p>{LONG.format(d)}</p><div class=box>Subscribe to our letter</div>"
                     f"<div class=head><h2>Sources</h2></div><table><tr><th>Date</th></tr></table><p>The end</p></article>"))
        want[d] = f"T {d}\nSummary\n{LONG.format(d)}\nSources\nDate\nThe end"
    got = extracted(spark, rows)
    assert got == want


def test_the_tree_decides(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<div class=top>Our site</div><p>{LONG.format(i)}</p>") for i in range(5)]
    assert set(extracted(spark, rows).values()) == {LONG.format(i) for i in range(5)}
    none = spark.createDataFrame([], "host string, node long, value double")
    monkeypatch.setattr(html_tree, "site_trees", lambda _: none)
    assert set(extracted(spark, rows).values()) == {"Our site\n" + LONG.format(i) for i in range(5)}


@pytest.mark.parametrize("name", [
    "related-work", "share-price", "notice-of-decision", "ad-hoc-analysis", "menu-review", "search-engine-history", "login-guide", "comment-text",
    "social-history", "banner-story", "widget-content", "post-content related", "comments-page-article", "cookie-recipe", "navigation-history",
])
def test_class_words_are_a_prior(name):
    assert by_rule(f"<div>Our site</div><div class='{name}'><h2>Title</h2><p>{LONG.format(1)}</p></div><footer>end</footer>") == [f"Our site\nTitle\n{LONG.format(1)}"]


@pytest.mark.parametrize("name", ["comments", "related", "sidebar-left", "ad-slot", "cookie-banner", "social-share", "newsletter-box", "site-nav", "comment-list"])
def test_frames_beside_prose_go(name):
    assert by_rule(f"<div class=text><p>{LONG.format(1)}</p></div><div class='{name}'><p>{LONG.format(2)} {LONG.format(3)}</p></div>") == [LONG.format(1)]
    assert by_rule(f"<article><p>{LONG.format(1)}</p><div class='{name}'><p>{LONG.format(2)}</p></div></article>") == [LONG.format(1)]


def test_several_articles():
    one, two, three = (LONG.format(i) for i in (1, 2, 3))
    teaser = "<article><h2>Other</h2><p>short</p></article>"
    assert by_rule(
        f"<main><article><h1>T</h1><p>{one}</p></article>{teaser}{teaser}</main>",
        f"<article><p>{one} {two}</p></article>{teaser}",
        f"<main><article><h1>T</h1><p>{one}</p><div><article><p>{two} {three}</p></article></div></article></main>",  # a comment
        f"<main><h1>T</h1><p>{one}</p><p>{two}</p><div><article><p>{three}</p></article></div></main>",
        f"<main><article><h1>T</h1><p>{one}</p></article><div><article><p>{two} {three}</p></article></div></main>",
        f"<article><h2>A</h2><p>{one}</p></article><article><h2>B</h2><p>{two}</p></article>",  # equals
        f"<main><p>lead</p><article><p>{one}</p></article><p>after</p></main>",
    ) == [f"T\n{one}", f"{one} {two}", f"T\n{one}", f"T\n{one}\n{two}", f"T\n{one}", f"A\n{one}\nB\n{two}", f"lead\n{one}\nafter"]


def test_hidden_branches_go():
    assert by_rule(
        "<article><p>a</p><p hidden>x</p><p style='color:red; display : none'>y</p><div aria-hidden=true>b</div><p class=hidden-gem>c</p></article>",
        "<article><p>a <span hidden>x <span>y</span></span> b <i style='display:none'>z</i>c</p></article>",
        "<body style='display:none'><article data-hidden=1>a <b hidden>b</article></body>",
        "<article><div hidden><p>x</p><article>y</article></div><p>a</p></article>",
    ) == ["a\nb\nc", "a b c", "a b", "a"]
