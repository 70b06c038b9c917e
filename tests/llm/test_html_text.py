from itertools import product

import numpy as np
import pytest

from bazaar.llm import html_text as H

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a>x</a></ul></nav><div id="cookie-notice">We use cookies, accept them please, all of you.</div><main><article>
<h1>Title</h1><p>First&nbsp;para with &lt;b&gt; <b>bold</b>text. <script>var t="</p>";</script><ul><li>one<li>two</ul>
<aside class="sidebar">Side text</aside><table><tr><td>1<td>2</table><p>End <em>it</em> &amp</article>
<section class="comments"><p>I like this article very much. It is so good, truly.</p></section></main>
<form>Name <input> <button>Go</button></form><footer>&copy; 2020</footer>"""


def test_article_without_boilerplate():
    assert H.main_text(PAGE) == "Title First para with <b> boldtext. one two 1 2 End it &"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), (" \n", ""), ("plain  text", "plain text"), ("<p>a<p>a", "a a"),
                                       ("<article><p>cut &am", "cut &am"), ("<article>x<b", "x"), ("<!-- <p>no</p>", ""),
                                       ("<article><p>q &#x41;&#66;</p></article>", "q AB")])
def test_odd_pages(html, text):
    assert H.main_text(html) == text


def test_minimum_cut_equals_trying_all_labellings():
    draw = np.random.default_rng(2)
    for _ in range(200):
        n = int(draw.integers(1, 8))
        terminal = [tuple(x) for x in draw.random((n, 2)).round(2)]
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(draw.integers(0, n, 6), draw.integers(0, n, 6), draw.random(6).round(2)) if a != b]

        def cost(labels):
            return sum(t[1] if yes else t[0] for t, yes in zip(terminal, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost(x) for x in product([True, False], repeat=n))
        assert abs(cost(H.minimum_cut(terminal, edges)) - best) < 1e-6


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "e"), (1, "u", PAGE, "e"), (None, None, None, None)],
                                  "page_id long, url string, html string, text string")
    rows = H.extracted(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, 56, 56] and all(r.n_chars == len(r.text) for r in rows)
    assert H.extracted(pages.limit(0)).collect() == []


LONG = "The river rose slowly in the night, and the people moved their boats to the higher ground. " * 8


@pytest.mark.parametrize("name", ["container no-sidebar", "wrapper has-sidebar", "page with-sidebar", "site sticky-header", "layout has-footer"])
def test_names_of_a_layout_ban_nothing(name):
    assert H.main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG.strip()
    assert H.main_text(f'<div class="{name}"><main><article><p>Short one.</p></article></main></div>') == "Short one."


def test_names_weigh_less_than_much_text_and_end_at_an_article():
    assert H.main_text(f'<div class="widget"><p>{LONG}</p></div>') == LONG.strip()
    assert H.main_text(f'<div class="widget"><article><p>{LONG}</p></article></div>') == LONG.strip()
    assert H.main_text('<div class="widget"><p>Subscribe to our letter now.</p></div>') == ""
    assert H.main_text(f"<p><a class='related-link'>See also</a> {LONG}</p>") == f"See also {LONG.strip()}"


def test_inline_elements_speak_for_their_own_text_only():
    assert H.main_text(f"<p><span hidden>Not shown.</span> {LONG}</p>") == LONG.strip()
    assert H.main_text("<div><span class='ad'>Buy it here today, now.</span></div>") == ""


SAID = "I have lived by that river all my life, and we never moved any boat, nor did my father before. "


@pytest.mark.parametrize("words", [20, 40, 60, 100, 200])
@pytest.mark.parametrize("around", [
    '<section class="comments"><p>{}</p></section>',
    '<div id="comments"><ol class="comment-list"><li><article class="comment-body"><div class="comment-content"><p>{}</p></div></article></li></ol></div>',
    '<div id="comments"><article><p>{}</p></article></div>',
    '<div class="replyList"><div class="replyBody"><p>{}</p></div></div>',
    '<div itemprop="comment"><p>{}</p></div>',
    '<div class="sidebar-content"><p>{}</p></div>',
    '<div class="sidebar"><p>{}</p></div>',
    '<div class="cookie-notice-text"><p>{}</p></div>',
    '<div class="cookieNotice"><p>{}</p></div>',
    '<div class="newsletter-signup__text"><p>{}</p></div>',
    '<form class="contact"><p>{}</p></form>',
])
def test_comments_sidebars_and_notices_of_any_length(words, around):
    said = " ".join((SAID * 12).split()[:words])
    other = around.format(said)
    body = f"<h1>The river</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"The river {LONG.strip()} {LONG.strip()}"
    assert H.main_text(f"<main><article>{body}</article>{other}</main>") == want
    assert H.main_text(f"<article class='post'><div class='entry-content'>{body}</div>{other}</article>") == want
    assert H.main_text(f"<div class='post-content'>{body}</div>{other}") == want
    assert H.main_text(f"{other}<div id='content'>{body}</div>") == want


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "comments-open", "post-body", "storyContent", "has-comments"])
def test_names_that_only_hold_such_a_word(name):
    assert H.main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG.strip()


def test_header_of_an_entry_is_part_of_it():
    assert H.main_text(f'<article><header class="entry-header"><h1 class="entry-title">The river</h1></header><p>{LONG}</p></article>') == f"The river {LONG.strip()}"


def test_very_long_page():
    page = "<main><article>" + f"<p>{LONG}</p>" * 3000 + "</article></main><div class=sidebar>" + f"<p>{SAID}</p>" * 3000 + "</div>"
    assert H.main_text(page) == " ".join([LONG.strip()] * 3000)
