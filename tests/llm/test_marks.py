"""Marks, forms and depth that must not cost a page its text."""

import pytest

from spanloom.llm import wrappers

ARTICLE = "<article><p>The text of the page</p></article>"
NAV = "<nav>Home</nav>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="no-sidebar">{NAV}{ARTICLE}</body>',
        f'<body class="sidebar">{NAV}{ARTICLE}</body>',
        f'<div class="page has-header">{ARTICLE}</div>',
        f'<div class="page header">{ARTICLE}</div>',
        '<article class="post with-comments"><p>The text of the page</p></article>',
        f"<body><form action=/>{NAV}{ARTICLE}</form></body>",
        f"<body><form action=/>{NAV}<p>The text of the page</p></form></body>",
        "<main class=widget><p>The text of the page</p></main><p>no</p>",
        f'<article><p>The text</p><div class="cookie-banner">no</div>{"<div>" * 200}<ul class=menu><li>no</li></ul>{"</div>" * 200}<p>of the page</p></article>',
        "<div id=sidebar><article>no</article></div><div><p>The text of the page</p></div>",
        f'{ARTICLE}<section class="comments"><article><p>no</p></article></section>',
    ],
)
def test_text_is_kept(page):
    assert wrappers.main_text(page, None, False) == "The text of the page"
