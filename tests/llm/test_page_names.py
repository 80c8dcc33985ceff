"""Class names and ids that say furniture, and those that only look so."""

import pytest

from factloom.llm import html_text

PROSE = ("some plain text " * 10).strip()


def _text(page):
    return html_text.main_text(page, html_text.train())


@pytest.mark.parametrize(
    "open_tag", ['body class="header-fixed"', 'div class="sidebar-layout"', 'main class="menu-open"', 'div class="no-sidebar"', 'article id="comment"', 'section id="related-work"', 'div class="page with_menu"']
)
def test_layout_names_do_not_empty_a_page(open_tag):
    tag = open_tag.split()[0]
    assert _text(f"<html><{open_tag}><p>{PROSE}</p></{tag}></html>") == PROSE


def test_headings_stay():
    assert _text(f'<article><h2 id="notice-of-change">Notice of change</h2><p>{PROSE}</p><h3 class="banner">More</h3></article>') == f"Notice of change\n{PROSE}\nMore"
    assert _text(f'<article><div class="post-header"><h1>Title</h1></div><p>{PROSE}</p></article>') == f"Title\n{PROSE}"


@pytest.mark.parametrize("name", ["user-comments", "site-nav", "page-footer", "eu_cookie", "cookie-consent", "comment-list", "ad-slot", "sidebar_left", "share-buttons", "x main-menu"])
def test_compounds_of_furniture_go(name):
    assert _text(f'<article><p>{PROSE}</p><div class="{name}"><p>{PROSE} again</p></div></article>') == PROSE
