"""The main text on layouts whose class names speak of what they are not."""

import pytest

from presswork.llm.html_text import main_text

PARAGRAPHS = [
    "First paragraph of the story with quite a number of words in it to read and enjoy today, number one.",
    "Second paragraph of the story goes on with more words for everyone who reads it to the very end.",
    "Short end of it.",
]
TEXT = "\n\n".join(PARAGRAPHS)
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
AD = '<div class="ad"><p>Buy this great product now, it is the best that there ever was in the whole wide world.</p></div>'
COMMENTS = '<section id="comments"><ol class="comment-list"><li><article class="comment-body"><p>I really liked this article and I read it twice because it was so good to read it.</p></article></li></ol></section>'
MENU = '<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>'
LAYOUTS = [
    '<div class="layout no-sidebar">{}</div>',
    '<div class="page has-banner"><article>{}</article></div>',
    '<div class="content-with-sidebar"><main><article>{}</article></main></div>',
    '<div id="app" class="menu-closed"><article>{}</article></div>',
    '<div class="elementor-widget-container">{}</div>',
    '<div class="post hentry comments-closed">{}</div>',
    '<div class="post comments-open">{}</div>',
    '<div class="layout-sidebar-right"><div class="inner">{}</div></div>',
    '<div class="widget">{}</div>',
    '<form id="aspnetForm">{}</form>',
    '<div class="sidebar-page-container">{}</div>',
    '<body class="has-navbar single-post ad-free">{}',
    '<div class="with-footer">{}</div>',
    '<div class="subscription-content"><div>{}</div></div>',
    '<div class="toolbar-fixed is-menu-open"><article>{}</article></div>',
    '<div class="banner"><main>{}</main></div>',
    '<div class="paywall"><div itemprop="articleBody">{}</div></div>',
    '<div class="row ad-layout"><div class="col">{}</div></div>',
    '<div class="widget widget_text">{}</div>',
    '<div class="modal-closed"><div>{}</div></div>',
    '<div class="newsletter-page"><article>{}</article></div>',
    '<div id="promo-wrapper"><div id="story">{}</div></div>',
    '<article class="has-ads comments-enabled">{}</article>',
    '<main class="no-nav">{}</main>',
    '<div class="related-enabled"><section>{}</section></div>',
    '<div class="cookie-consent-active">{}</div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_keep_the_story_and_nothing_else(layout):
    assert main_text(layout.format(BODY)) == TEXT
    assert main_text(MENU + layout.format(BODY) + COMMENTS) == TEXT
    assert main_text(MENU + layout.format(BODY + AD) + COMMENTS + "<footer>Bye</footer>") == TEXT
    assert main_text("<noscript><p>Please enable JavaScript in your browser to read all of this page in full.</p></noscript>" + layout.format(BODY)) == TEXT
    more = '<div class="adbox">Buy this great product now, it is the best there was in the whole wide world.</div><div class="more-stories"><p>Another long teaser of some other story with words in it to read some day soon.</p></div>'
    assert main_text(layout.format(BODY + more)) == TEXT


@pytest.mark.parametrize("name", ["comment-text", "promo-text", "related-text"])
def test_a_piece_of_the_story_may_have_any_compound_name(name):
    piece = "A piece of the story that has a class of its own and is long enough to be one."
    assert main_text(f'<main>{BODY}<p class="{name}">{piece}</p></main>') == f"{TEXT}\n\n{piece}"


def test_comments_go_even_where_they_are_most_of_the_page():
    many = "".join(f"<li><article><p>{p} So I say, reader {i}.</p></article></li>" for i in range(9) for p in PARAGRAPHS)
    for name in ("comments", "comment-list", "respond"):
        assert main_text(f'<main>{BODY}</main><div id="{name}"><ol>{many}</ol></div>') == TEXT
