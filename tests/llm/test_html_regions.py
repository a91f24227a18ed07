"""Pages whose wrappers, attributes and raw elements once hid the article."""

import pytest

from stancepanel.llm.html_text import DEFAULT_WEIGHTS, main_text

LONG = "The council met on Monday and agreed to the plan for the new bridge after a long debate."
MORE = "Work on the bridge starts in spring and is to last for about two years in all."
MENU = '<nav><a href="/">Home</a><a href="/news">News</a></nav>'


@pytest.mark.parametrize("page, want", [
    (f'<body>{MENU}<div class="layout has-sidebar"><article><p>{LONG}</p><p>{MORE}</p></article>'
     '<div class="sidebar"><a>Other</a></div></div></body>', [LONG, MORE]),
    (f"<body><p>{LONG}</p><svg/><p>{MORE}</p></body>", [LONG, MORE]),
    (f"<body><p>{LONG}</p><script/><p>{MORE}</p></body>", [LONG, MORE]),
    (f"<body><p title=it's>{LONG}</p><p>{MORE} It's late.</p></body>", [LONG, MORE + " It's late."]),
    (f'<article><div class="article-header"><h1>The bridge</h1></div><p>{LONG}</p></article>', ["The bridge", LONG]),
    (f'<article><p class="social-policy">{LONG}</p><p>{MORE}</p></article>', [LONG, MORE]),
    # markup without <article>
    (f'<body>{MENU}<div class="page with-sidebar"><div class="content"><h1>The bridge</h1><p>{LONG}</p><p>{MORE}</p></div>'
     '<div class="sidebar"><ul><li><a>Other</a></li></ul></div></div></body>', ["The bridge", LONG, MORE]),
    (f'<body><div id=main-content><p>{LONG}</p><div class="related-posts"><p>Read next: a storm</p></div><p>{MORE}</p>'
     '</div><div class="comments"><article class="comment"><p>I doubt it.</p></article></div></body>', [LONG, MORE]),
    (f'<body><p data-class="ad">{LONG}</p><p title="a > b">{MORE}</p></body>', [LONG, MORE]),
])
def test_article_is_kept(page, want):
    assert main_text(page, DEFAULT_WEIGHTS).split("\n") == want


def test_what_is_not_the_article_goes():
    page = (f'<article><p>{LONG}</p><div class="ad-slot"><p>Buy one now</p></div><p class="advert">Buy two now</p>'
            f'<p style="display:none">Hidden</p><p>{MORE}</p></article><div class="comment-list"><p>First!</p></div>')
    assert main_text(page, DEFAULT_WEIGHTS).split("\n") == [LONG, MORE]
    assert main_text("", DEFAULT_WEIGHTS) == "" == main_text("<div class=", DEFAULT_WEIGHTS)
