"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count, link density, how it ends and
begins, and the word counts and link densities of its two neighbours; besides, whether what encloses it is named as
furniture, and whether it lies in an article. A small labelled table trains the tree (Gini, axis-parallel splits), on
the driver, when the operator is built; blocks it calls text are joined in page order. Without the last two features
the same table trains a tree that agrees with it on more than 97 of 100 blocks of the test pages (README, tests).
Work is in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import no_null, ship

#: links: share of words in links, in percent. stops: it ends as a sentence does. notice: it begins as a copyright
#: notice does. article: 1 inside an article, -1 outside of the page's articles, 0 if it has none.
FEATURES = ("words", "links", "stops", "notice", "before_words", "before_links", "after_words", "after_links", "furniture", "article")
#: The features that a block's text and its neighbours' give.
TEXT_FEATURES = FEATURES[:8]

#: Labelled blocks: the features in the order of FEATURES, and 1 for text. Counts and neighbours are as found on pages.
LABELLED = (
    # menus: items among items, at the start of a page, before prose and behind it; also unnamed
    (1, 100, 0, 0, 0, 0, 1, 100, 1, -1, 0), (1, 100, 0, 0, 1, 100, 1, 100, 1, -1, 0), (1, 100, 1, 0, 1, 100, 9, 0, 1, -1, 0), (2, 100, 0, 0, 60, 0, 3, 100, 1, 0, 0),
    (1, 100, 0, 0, 0, 0, 1, 100, 0, 0, 0), (1, 100, 0, 0, 1, 100, 1, 100, 0, 0, 0), (1, 100, 1, 0, 1, 100, 12, 0, 0, 0, 0), (2, 100, 0, 0, 60, 0, 3, 100, 0, 0, 0),
    (3, 100, 0, 0, 2, 100, 8, 0, 0, 0, 0), (1, 100, 0, 0, 1, 100, 60, 0, 0, 0, 0), (4, 100, 0, 0, 3, 100, 0, 0, 0, 0, 0), (6, 100, 0, 0, 90, 0, 0, 0, 0, 0, 0),
    (12, 90, 0, 0, 10, 100, 4, 100, 0, 0, 0), (25, 80, 1, 0, 30, 70, 8, 100, 0, 0, 0), (30, 100, 0, 0, 40, 0, 1, 100, 0, 0, 0), (5, 80, 0, 0, 6, 70, 30, 0, 0, 0, 0),
    # headings of menus, short labels between links
    (2, 0, 0, 0, 3, 100, 2, 100, 0, 0, 0), (4, 0, 0, 0, 1, 100, 3, 100, 0, 0, 0), (1, 0, 0, 0, 5, 100, 1, 100, 0, 0, 0), (6, 0, 0, 0, 2, 100, 4, 90, 0, 0, 0),
    # adverts between a menu and a title
    (10, 0, 1, 0, 1, 100, 8, 0, 1, -1, 0), (5, 0, 1, 0, 1, 100, 12, 0, 1, -1, 0), (8, 0, 1, 0, 1, 100, 7, 0, 1, 0, 0), (13, 0, 1, 0, 1, 100, 14, 0, 1, -1, 0),
    (10, 0, 1, 0, 1, 100, 8, 0, 0, 0, 0), (5, 0, 1, 0, 1, 100, 12, 0, 0, 0, 0), (8, 0, 1, 0, 1, 100, 1, 0, 0, 0, 0), (13, 0, 1, 0, 1, 100, 14, 0, 0, 0, 0),
    (4, 0, 1, 0, 1, 100, 6, 0, 0, 0, 0), (7, 0, 1, 0, 2, 100, 10, 0, 0, 0, 0), (11, 0, 1, 0, 1, 100, 5, 0, 0, 0, 0), (9, 0, 1, 0, 3, 100, 9, 0, 0, 0, 0),
    # copyright lines
    (12, 0, 1, 1, 40, 0, 0, 0, 1, -1, 0), (7, 0, 1, 1, 69, 0, 0, 0, 0, 0, 0), (15, 0, 1, 1, 8, 0, 0, 0, 0, 0, 0), (9, 30, 0, 1, 15, 0, 3, 100, 0, 0, 0), (12, 0, 0, 1, 2, 100, 0, 0, 0, -1, 0),
    # sidebars, notices, forms, reader comments, of any length, in an article or out of it
    (60, 5, 1, 0, 30, 0, 40, 0, 1, 1, 0), (8, 0, 1, 0, 50, 0, 60, 0, 1, 1, 0), (150, 0, 1, 0, 20, 0, 30, 0, 1, -1, 0), (3, 0, 0, 0, 0, 0, 100, 0, 1, 1, 0),
    (40, 0, 1, 0, 70, 0, 5, 0, 1, 0, 0), (12, 0, 1, 0, 80, 0, 0, 0, 1, 0, 0), (2, 0, 0, 0, 5, 0, 3, 0, 1, 0, 0), (90, 0, 1, 0, 90, 0, 90, 0, 1, 1, 0),
    # outside of the page's article
    (20, 0, 1, 0, 40, 0, 6, 0, 0, -1, 0), (6, 0, 0, 0, 5, 90, 30, 0, 0, -1, 0), (45, 0, 1, 0, 8, 0, 0, 0, 0, -1, 0), (3, 0, 0, 0, 60, 0, 2, 100, 0, -1, 0), (80, 0, 1, 0, 30, 0, 20, 0, 0, -1, 0), (10, 0, 1, 0, 1, 100, 9, 0, 0, -1, 0),
    # in an article: titles behind an advert or a menu, paragraphs of any length, links and lists among them
    (12, 0, 0, 0, 11, 0, 25, 0, 0, 1, 1), (10, 0, 1, 0, 9, 0, 10, 0, 0, 1, 1), (7, 0, 0, 0, 1, 100, 23, 0, 0, 1, 1), (8, 0, 0, 0, 13, 0, 114, 0, 0, 1, 1),
    (226, 0, 1, 0, 50, 0, 3, 0, 0, 1, 1), (1, 0, 1, 0, 35, 0, 31, 0, 0, 1, 1), (9, 0, 1, 0, 1, 100, 8, 0, 0, 1, 1), (5, 100, 0, 0, 70, 0, 60, 0, 0, 1, 1),
    (11, 55, 1, 0, 20, 0, 30, 0, 0, 1, 1), (5, 100, 0, 0, 12, 0, 4, 100, 0, 1, 1), (3, 0, 0, 0, 4, 100, 2, 100, 0, 1, 1), (8, 0, 1, 0, 46, 0, 10, 0, 0, 1, 1),
    (120, 0, 1, 0, 60, 0, 1, 100, 0, 1, 1), (25, 0, 1, 0, 40, 0, 6, 100, 0, 1, 1), (3, 0, 1, 0, 70, 0, 4, 100, 0, 1, 1), (18, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1),
    # pages without an article element: titles, running text, short paragraphs, also beside links
    (8, 0, 0, 0, 1, 100, 70, 0, 0, 0, 1), (6, 0, 0, 0, 1, 100, 9, 0, 0, 0, 1), (9, 0, 0, 0, 1, 100, 4, 0, 0, 0, 1), (5, 0, 0, 0, 2, 100, 12, 0, 0, 0, 1), (7, 0, 0, 0, 1, 100, 20, 0, 0, 0, 1), (11, 0, 0, 0, 1, 100, 8, 0, 0, 0, 1), (9, 0, 1, 0, 9, 0, 35, 0, 0, 0, 1), (1, 0, 0, 0, 8, 0, 20, 0, 0, 0, 1),
    (12, 0, 0, 0, 11, 0, 7, 0, 0, 0, 1), (29, 0, 1, 0, 35, 0, 31, 0, 0, 0, 1), (1, 0, 1, 0, 46, 0, 30, 0, 0, 0, 1), (60, 0, 1, 0, 1, 100, 70, 0, 0, 0, 1),
    (20, 0, 1, 0, 1, 100, 15, 0, 0, 0, 1), (8, 0, 1, 0, 46, 0, 10, 0, 0, 0, 1), (17, 0, 1, 0, 23, 0, 0, 0, 0, 0, 1), (3, 0, 1, 0, 40, 0, 0, 0, 0, 0, 1),
    (2, 0, 1, 0, 0, 0, 2, 0, 0, 0, 1), (2, 0, 1, 0, 2, 0, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 0, 6, 0, 0, 0, 1), (4, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1),
    (22, 14, 1, 0, 40, 0, 35, 0, 0, 0, 1), (70, 20, 1, 0, 30, 0, 5, 60, 0, 0, 1), (9, 40, 1, 0, 30, 0, 45, 0, 0, 0, 1), (12, 0, 1, 0, 70, 0, 2, 100, 0, 0, 1),
    (45, 0, 1, 0, 60, 0, 3, 100, 0, 0, 1), (18, 0, 1, 0, 1, 100, 2, 100, 0, 0, 1), (120, 0, 1, 0, 1, 100, 1, 100, 0, 0, 1), (4, 0, 0, 0, 50, 0, 60, 0, 0, 0, 1),
    # a line of links amid prose
    (5, 100, 0, 0, 70, 0, 60, 0, 0, 0, 1), (9, 100, 0, 0, 30, 0, 45, 0, 0, 0, 1), (3, 100, 1, 0, 120, 0, 35, 0, 0, 0, 1), (12, 80, 1, 0, 50, 0, 28, 0, 0, 0, 1),
)

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template title textarea svg math iframe object select option button head".split())
_FURNITURE = frozenset("nav aside footer header form menu dialog fieldset figcaption".split()) - {"figcaption"}
_ARTICLE = frozenset(("article", "main"))
_FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments comments-area cookie cookies consent disqus footer header"
    " masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies share sharing"
    " sidebar side-bar site-header site-footer skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that may follow a furniture name in a compound, and first words that say something else than the last one.
_HOLDERS = frozenset("area bar block box buttons container group inner item items left links list menu nav panel right section slot unit widget wrap wrapper".split())
_NOT_ITS_OWN = frozenset("has hide is no show toggle with without".split())
_TITLED = frozenset("article content entry post story".split())
#: What a page's text is in: their names say how they look, not that they are furniture.
_NEVER_BY_NAME = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_MARKUP = re.compile(_OTHER + r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^"'>]++|"[^"]*"|'[^']*'|["'])*+)(>|\Z)""", re.DOTALL)
#: For what follows a tag whose quotes close after the next tag ends, if at all: quotes mean nothing.
_PLAIN_MARKUP = re.compile(_OTHER + r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_READ = frozenset("class id role hidden aria-hidden".split())
_STOPS = tuple(".!?…:;\"'”’»)。！？")
_NOTICES = ("©", "(c) ", "copyright ")


def _names_furniture(word: str) -> bool:
    """A furniture name, a compound that ends in one, or one that is followed only by words for what holds it."""
    if word in _FURNITURE_NAMES:
        return True
    first, *rest = [p for p in re.split("[-_]+", word) if p] or [""]
    if not rest or first in _NOT_ITS_OWN or first in _TITLED and rest[-1] == "header":
        return False
    return rest[-1] in _FURNITURE_NAMES or first in _FURNITURE_NAMES and _HOLDERS.issuperset(rest)


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _FURNITURE and not (tag == "header" and in_article):  # a header in an article holds its title
        return True
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _READ:
            continue
        value = "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and tag not in _NEVER_BY_NAME and any(map(_names_furniture, value.split())):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, furniture, article) for each flat text block of a page."""
    out: list[tuple[str, int, int, bool, bool]] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, in furniture, in an article
    opened: Counter[str] = Counter()
    link, at, markup = 0, 0, _MARKUP
    endless: set[str] = set()  # silent elements that nothing ends any more

    def close() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            _, furniture, article = stack[-1] if stack else ("", False, False)
            words = len(text.split())
            out.append((text, words, min(words, len(" ".join(linked).split())), furniture, article))
        pieces.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if link:
                linked.append(text)

    while True:
        found = markup.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag, attributes = (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        if not found[4]:  # the tag has no end outside of quotes: it ends at the next angle, or it is no tag
            over = page.find(">", found.start())
            if over < 0:
                say(page[found.start() :])
                break
            at, attributes, markup = over + 1, page[found.end(2) : over], _PLAIN_MARKUP
        closing = found[1] == "/"
        if tag in _SILENT and tag != "head":
            if not closing and not attributes.endswith("/") and tag not in endless:
                over = re.compile(f"</{tag}\\s*>", re.IGNORECASE).search(page, at)
                if over is None and tag in ("script", "style", "textarea", "title"):
                    at = len(page)  # as browsers do: their content runs to the end
                elif over is None:
                    endless.add(tag)
                else:
                    at = over.end()
            continue
        if tag in _INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
            continue
        close()
        link = 0
        if tag in _VOID or attributes.endswith("/"):
            continue
        if closing:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
        else:
            if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", tag):
                opened[stack.pop()[0]] -= 1  # these end where the next begins
            _, furniture, article = stack[-1] if stack else ("", False, False)
            stack.append((tag, furniture or _is_furniture(tag, attributes, article), article or tag in _ARTICLE))
            opened[tag] += 1
    close()
    return out


def features(found: list[tuple[str, int, int, bool, bool]]) -> list[tuple[float, ...]]:
    """The FEATURES of each block, neighbours included; a missing neighbour has no words."""
    plain = [(w, 100.0 * k / w) for _, w, k, _, _ in found]
    near = [(0, 0.0), *plain, (0, 0.0)]
    outside = -1.0 if any(a for *_, a in found) else 0.0
    said = [(float(t.endswith(_STOPS)), float(t[:10].lower().startswith(_NOTICES))) for t, *_ in found]
    return [(*near[i + 1], *said[i], *near[i], *near[i + 2], float(f), 1.0 if a else outside) for i, (_, _, _, f, a) in enumerate(found)]


def train(rows: tuple[tuple[float, ...], ...] = LABELLED, depth: int = 10, names: tuple[str, ...] = FEATURES) -> tuple:
    """A decision tree: (feature, threshold, at most, above), or (label,). The best Gini split over the features in ``names``
    is taken, ties by order."""

    def gini(part: list[tuple[float, ...]]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return 2 * share * (1 - share) * len(part)

    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (int(2 * ones >= len(rows)),)
    best = None
    for k in [k for k, name in enumerate(FEATURES) if name in names]:
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            left, right = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            score = gini(left) + gini(right)
            if best is None or score < best[0] - 1e-12:
                best = (score, k, cut, left, right)
    if best is None:
        return (int(2 * ones >= len(rows)),)
    _, k, cut, left, right = best
    return (k, cut, train(tuple(left), depth - 1, names), train(tuple(right), depth - 1, names))


def classify(tree: tuple, x: tuple[float, ...]) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    """The blocks that the tree calls text, in page order, joined by line feeds."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, x in zip(found, features(found)) if classify(tree, x))


def extract_main_text(spark: SparkSession, pages: DataFrame, html_col: str = "html", labelled: tuple = LABELLED) -> DataFrame:
    """``pages`` with the columns text (empty if there is none) and n_chars (code points) instead of the html column.

    Every row is answered on its own: null and empty pages give an empty text, repeated rows stay, an empty table
    gives no rows. Columns of ``pages`` called text or n_chars are replaced.
    """
    ship(spark)
    tree = train(labelled)
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kept = pages.select(*rest, no_null(html_col).alias("text"))
    names = [*rest, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(run, kept.withColumn("n_chars", F.lit(0).cast("bigint")).schema)
