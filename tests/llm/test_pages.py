"""Malformed pages: time in proportion to their length, and a defined text."""

import time

import pytest

from spanloom.llm import wrappers

N = 100_000
PAGES = {
    "quotes": "<p>a</p><a " + '"' * N,
    "open tags": "<p>a</p>" + "<a " * N,
    "values": "<p>a</p>" + '<a x=">" z' * (N // 10),
    "single quotes": "<p>a</p>" + "<a x='" * N,
    "comments": "<p>a</p>" + "<!-- " * N,
    "deep": "<div>" * N + "a" + "</div>" * N,
    "deep and unclosed": "<p>a</p>" + "<div><section>" * N,
    "ends": "<p>a</p>" + "</div>" * N,
    "scripts": "<p>a</p>" + "<script>" * N,
    "entities": "<p>a</p>" + "&#x" * N,
    "attributes": "<p>a</p><b " + "class=x id='y' " * N + ">",
}


@pytest.mark.parametrize("name", PAGES)
def test_linear_time(name):
    started = time.process_time()
    text = wrappers.main_text(PAGES[name], None, False)
    assert time.process_time() - started < 5
    assert text.startswith("a")


def test_quotes_in_tags():
    read = lambda page: wrappers.main_text(page, None, False)
    assert read('<p title="a > b">x</p><p title=\'>\'>y</p>') == "x y"
    assert read('<p title="never closed>x</p><p>y</p>') == "x y"
    assert read("<p it's>x</p>") == "x"
    assert read('<div class="ad" x=">">gone</div><p>x<br/>y</p>') == "x y"
    assert read("<p>1 < 2 and <b") == "1 < 2 and <b"
    assert read('<p a=b=">" c>x</p>') == "x"
