"""The tree on blocks of pages: held-out rows, the text's features alone, neighbours, odd pages."""

import os
import re
import time

import pytest

from factloom.llm import html_text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TREE = html_text.train()
#: Rows that no name or element decides, and the tree that the text's features alone give.
UNNAMED = tuple(r for r in html_text.LABELLED if not r[8] and r[9] == 0)
TEXT_TREE = html_text.train(UNNAMED, names=html_text.TEXT_FEATURES)


@pytest.fixture(scope="module")
def pages(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def _plain(page):
    """The article's text by a cut at its tags: what the test pages say themselves."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer)", page, re.DOTALL)[1]
    found = [html_text.html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))) for x in re.split("</?(?:p|h1)>", body)]
    return "\n".join(" ".join(x.split()) for x in found if x.strip())


def test_all_pages(pages):
    assert [html_text.main_text(p, TREE) for p in pages] == [_plain(p) for p in pages]


def test_held_out_blocks():
    for rows, names in ((html_text.LABELLED, html_text.FEATURES), (UNNAMED, html_text.TEXT_FEATURES)):
        right = 0
        for fold in range(10):
            tree = html_text.train(tuple(r for n, r in enumerate(rows) if n % 10 != fold), names=names)
            right += sum(html_text.classify(tree, r[:-1]) == r[-1] for n, r in enumerate(rows) if n % 10 == fold)
        assert right >= 0.8 * len(rows)


def test_text_and_neighbours_decide_without_names(pages):
    same = changed = total = 0
    for page in pages:
        found = html_text.blocks(page)
        for block, x in zip(found, html_text.features(found)):
            verdict = html_text.classify(TEXT_TREE, x)
            same += verdict == int(block[4] and not block[3])
            changed += verdict != html_text.classify(TEXT_TREE, (*x[:4], 0, 0, 0, 0, *x[8:]))
            total += 1
    assert same >= 0.97 * total and changed >= 0.02 * total


def test_pages_of_nothing_but_divs(pages):
    """The same pages with every element a div and no names: all the tree has is text, links and neighbours."""
    right = 0
    for page in pages:
        soup = re.sub("<(/?)(?:nav|ul|li|article|footer|p|h1)>", r"<\1div>", page).replace(' class="ad"', "")
        right += html_text.main_text(soup, TREE) == _plain(page)
    assert right >= 0.9 * len(pages)


PROSE = ("some plain text " * 10).strip() + "."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Two short ones.</p><p>Here they are.</p>", "Two short ones.\nHere they are."),
        ('<article><p class="share-price-analysis">Shares rose.</p><p title="id of hidden role=menu">Titles say little.</p></article>', "Shares rose.\nTitles say little."),
        (f"<article><header><h1>A title</h1></header><p>{PROSE}</p></article>", f"A title\n{PROSE}"),
        (f"<header><p>Site name</p></header><article><p>{PROSE}</p></article>", PROSE),
        (f"<div><a>Home</a></div><div><a>News</a></div><div>A title</div><div>{PROSE}</div><div><a>More here</a> and there it goes on for a while, in prose.</div>", f"A title\n{PROSE}\nMore here and there it goes on for a while, in prose."),
        (f"<p>{PROSE}</p><p><a>a link amid prose</a></p><p>{PROSE} Two.</p>", f"{PROSE}\na link amid prose\n{PROSE} Two."),
        (f"<div><a>x</a></div><div>Topics</div><div><a>y</a></div><div><a>z</a></div><div>{PROSE}</div>", PROSE),
        (f"<div>{PROSE}</div><div>© 2020 somebody</div>", PROSE),
        ("<p>if a <b then c", "if a <b then c"),
        ('<p>x</p><p title="never closed>y</p><p>z</p>', "x\ny\nz"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page, TREE) == text


@pytest.mark.parametrize("page", ['<a "' * 500_000, "<div>" * 200_000 + "</p>" * 200_000, "<select>" * 250_000, "<a '\"" * 400_000, '<p class="' * 200_000, "<!--" * 500_000, "<p>x" * 500_000, "<a href=x>" * 200_000])
def test_work_is_in_proportion_to_the_page(page):
    began = time.perf_counter()
    html_text.main_text(page, TREE)
    assert time.perf_counter() - began < 15
