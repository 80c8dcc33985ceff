"""Text right before blocks of links is kept, whether or not an article encloses it."""

import pytest

from factloom.llm import html_text

LINKS = ['<footer><a href="/">Home</a></footer>', '<div class="pager"><a href="/2">Next page</a></div>', '<p><a href="/x">More stories like this one</a></p>', '<nav><a href="/">A</a></nav>']


@pytest.mark.parametrize("links", LINKS)
@pytest.mark.parametrize("words", [3, 12, 18, 25, 120, 400])
def test_article_before_links(links, words):
    last = " ".join(["word"] * words) + "."
    page = f"<body><article><h1>Title</h1><p>{'some text ' * 20}</p><p>{last}</p></article>{links}</body>"
    assert last in html_text.main_text(page, html_text.train()).split("\n")
    page = f"<body><article><p>{'some text ' * 20}</p><h2>A heading here</h2><p><a href='/x'>{'link ' * 9}</a></p><p>{last}</p></article></body>"
    assert {"A heading here", last} <= set(html_text.main_text(page, html_text.train()).split("\n"))


@pytest.mark.parametrize("links", LINKS)
@pytest.mark.parametrize("words", [18, 25, 120, 400])
def test_prose_before_links(links, words):
    last = " ".join(["word"] * words) + "."
    page = f"<body><p>{'some text ' * 20}</p><p>{last}</p>{links}</body>"
    assert last in html_text.main_text(page, html_text.train()).split("\n")


def test_links_stay_out():
    page = f"<body><ul><li><a>Home</a><li><a>News of the day</a></ul><article><p>{'some text ' * 20}</p></article><p><a>{'link ' * 30}</a></p><p><a>Next</a></p></body>"
    assert html_text.main_text(page, html_text.train()) == ("some text " * 20).strip()
