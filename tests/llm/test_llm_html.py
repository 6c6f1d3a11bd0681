"""Main text: names that weigh, linear parsing, scoring against brute force."""

import random
import re
import time

import pytest

from ranksmith.llm import html_text

PARA = "This is a real paragraph of the article, with commas, and words enough to count."


@pytest.mark.parametrize("name", ["content social", "post search-result", "article-page toc-enabled", "widget-area-main content",
                                  "login-required post", "legal-article", "discussion-topic", "story promo"])
def test_names_do_not_drop_the_article(name):
    body = " ".join(f"{PARA} {i}" for i in range(4))
    page = (f'<body><div class="{name}"><h1>Title</h1>' + "".join(f"<p>{PARA} {i}</p>" for i in range(4))
            + "</div><div>Short thing.</div></body>")
    assert html_text.main_text(page) == f"Title {body}"
    # beside another article the same words close their subtree out, or leave it to the points
    other = page.replace("<div>Short thing.</div>", '<div class="post">' + "".join(
        f"<p>{PARA} Another, longer, one of {i}.</p>" for i in range(12)) + "</div>")
    assert "Another, longer, one of 11." in html_text.main_text(other)


def test_comments_stay_out_however_many():
    page = ('<body><div class="post"><h1>T</h1><p>A first, real paragraph of some length.</p></div><div id="comments">'
            + f'<div class="comment"><p>{PARA}</p></div>' * 500 + "</div></body>")
    assert html_text.main_text(page) == "T A first, real paragraph of some length."


@pytest.mark.parametrize("page", [
    "<a " * 1_700_000, '<a href="x>' * 300_000 + "'", '<a x=">" y <a ">" "' * 100_000, "<div>" * 100_000 + "text, here" + "</div>" * 100_000,
    "<div><p>para, text that is long enough to count</p>" * 50_000, "<div>" * 50_000 + "</section>" * 100_000 + "<p>x</p>" * 50_000,
    "<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<button>x" * 100_000, "<span hidden>" * 50_000 + "<div></div>" * 50_000,
    "<" * 3_000_000, "<p>" + "<a" * 1_500_000, '<div class="widget">' * 50_000 + PARA, "<!" * 1_000_000, "&#" + "9" * 100_000 + ";"],
    ids=lambda p: p[:12])
def test_time_grows_with_the_length_only(page):
    t0 = time.time()
    html_text.main_text(page)
    assert time.time() - t0 < 30


def test_unclosed_quotes_and_missing_ends():
    assert html_text.main_text('<p title="a > b">One, two.</p><p class="x>Three.</p>') == "One, two. Three."
    assert html_text.main_text("<p>a < b and <i>c</i> <b") == "a < b and c <b"
    assert html_text.main_text("<p>&#99999999999999999999; &amp; &lt;x") == "� & <x"


def brute_points(nodes):
    """Points of every node, each paragraph walking up to the root."""
    got = {id(n): 0.0 for n in nodes}
    for n in nodes:
        own = "".join(x if type(x) is str else " " for x in n.items)
        length = sum(map(len, own.split()))
        if not length or n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "body", "html"):
            continue
        points = length / 100 if length < 25 else 1 + len(re.findall("[,،、，]", own)) + min(length / 100, 3)
        if n.tag in ("div", "section", "article", "main", "td", "center"):
            got[id(n)] += points
        at, level = n, 0
        while at.up is not None and not at.out:
            at, level = at.up, level + 1
            got[id(at)] += points * (1 if level == 1 else 1 / 2 if level == 2 else 0.7 ** (level - 3) / 6)
    return got


@pytest.mark.parametrize("seed", range(5))
def test_points_brute_force(seed):
    rnd = random.Random(seed)

    def tree(depth):
        if not depth or rnd.random() < 0.2:
            return f"<p>{', '.join(['some words'] * rnd.randrange(8))}</p>"
        tag = rnd.choice(["div", "section", "td", "ul", "div class=sidebar", "h2", "blockquote"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randrange(4))) + "bare, text here" * rnd.randrange(3) + f"</{tag.split()[0]}>"

    nodes = html_text._order(html_text.parse("<body>" + "".join(tree(7) for _ in range(4)) + "</body>"))
    html_text._close(nodes)
    html_text._score(nodes)
    want = brute_points(nodes)
    assert len(nodes) > 30
    assert all(abs(n.points - want[id(n)]) < 1e-9 for n in nodes)
    # words and links of what is open add up
    for n in nodes:
        own = sum(len(w) for x in n.items if type(x) is str for w in x.split())
        assert n.words >= own or n.out
