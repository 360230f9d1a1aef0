"""Operator 7: what is no article goes in any element, what the article owns stays, templates decide where nothing is named."""

from __future__ import annotations

import pytest

from docloom.llm.html_text import Page, main_texts, telling

KEPT = ['<div class="share-price-table">text</div>', '<p class="notice">text</p>', '<div class="reply">text</div>', '<section class="related-work">text</section>', '<details class="widget">text</details>', '<p class="menu">text</p>', '<blockquote class="comment-free">text</blockquote>', '<div id="banner-history">text</div>', '<h2 class="nav">text</h2>', "<header>text</header>"]
GONE = ['<article class="comment"><p>text</p></article>', '<article class="ad">text</article>', '<div class="comments"><p>text</p></div>', '<ol id="comment-list"><li>text</li></ol>', '<div class="ad-slot-3">text</div>', '<p class="advertisement">text</p>', '<div class="related-posts"><a href="x">text</a></div>', '<div class="share"><a>text</a></div>', "<aside>text</aside>", "<nav>text</nav>", "<form>text</form>", '<div role="alert">text</div>', '<div class="cookie-notice">text</div>', '<section class="newsletter">text</section>', '<div class="site-footer">text</div>', '<div id="disqus_thread">text</div>', "<div hidden>text</div>"]


@pytest.mark.parametrize("part", KEPT)
def test_an_article_keeps_its_own_parts(part):
    assert Page(f"<body><article><h1>T</h1>{part}<p>end</p></article></body>").main_text(set()) == "T\ntext\nend"


@pytest.mark.parametrize("part", GONE)
@pytest.mark.parametrize("page", ["<article><h1>T</h1>{}<p>end</p></article>", "<article><h1>T</h1><p>end</p></article>{}", "{}<article><h1>T</h1><p>end</p></article>", "<div><h1>T</h1>{}<p>end</p></div>"])
def test_what_is_no_article_goes(part, page):
    assert Page("<body>" + page.format(part) + "</body>").main_text(set()) == "T\nend"


def test_one_of_several_articles():
    teasers = "<article><p>A teaser that is longer than the text itself, but has no heading of the page.</p></article>" * 2
    assert Page(f"{teasers}<article><h1>T</h1><p>end</p></article>{teasers}").main_text(set()) == "T\nend"
    assert Page("<article>short</article><article>the longer one</article><article>short too</article>").main_text(set()) == "the longer one"
    assert Page("<article>one<article>part of one</article></article>").main_text(set()) == "one\npart of one"


def test_names_are_told_whole():
    assert telling(frozenset(["share-price-table"])) == (False, False)
    assert telling(frozenset(["post", "ad_box2"])) == (True, False)
    assert telling(frozenset(["social-bar"])) == (False, True)
    assert telling(frozenset(["adventure", "navy", "", "12"])) == (False, False)


def plain_pages(n, host, bare):
    """Pages without article, main or telling names; the same boxes on each page of the host."""
    box = "<div class='x1'><p>Welcome to the site</p></div><div class='x2'><b>Buy</b> our things</div>"
    end = "<div class='x9'><p>All rights kept</p></div>"
    own = "<div class='x3'><h1>Title {0}</h1><p>Text {0} of {1}.</p><p>Same sentence everywhere.</p></div>"
    return [(i, f"http://{host}/{i}", ("" if bare else box) + own.format(i, host) + ("" if bare else end)) for i in range(n)]


@pytest.mark.parametrize("limit", [10**6, 0], ids=["broadcast", "joined"])
def test_templates_decide_where_nothing_is_named(spark, limit):
    rows = plain_pages(12, "a.example", False) + plain_pages(3, "b.example", False)
    df = spark.createDataFrame([(p + 100 * (u > "http://b"), u, h) for p, u, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(df, broadcast_limit=limit).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nText {i} of a.example."  # outside an article a recurring paragraph is template too
    for i in range(3):  # too few pages of the host to tell
        assert got[100 + i].startswith("Welcome to the site\nBuy our things\nTitle")
