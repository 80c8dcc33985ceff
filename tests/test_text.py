"""Text and number semantics, against Python's own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import fonts, text

SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace() and not 0xD800 <= c < 0xE000)
SAMPLES = [None, "", " a B　c ", SPACES + "x" + SPACES, "Heading 1", "正 文", "\x1cA\x85b ", "🙂 é"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")


def test_normalized_and_strip_follow_str(frame):
    for r in frame.select("s", text.normalized("s").alias("n"), text.strip("s").alias("t"), text.compact("s").alias("c")).collect():
        assert r.n == "".join((r.s or "").split()).lower()
        assert r.c == "".join((r.s or "").split())
        assert r.t == (None if r.s is None else r.s.strip())


def test_lines_follow_splitlines(spark):
    random.seed(3)
    rows = [("".join(random.choice("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85  ") for _ in range(random.randint(0, 12))),) for _ in range(300)]
    for r in spark.createDataFrame(rows, "s string").select("s", text.lines("s").alias("l"), text.line_count("s").alias("n")).collect():
        assert r.n == len(r.s.splitlines())
        if r.s:
            assert r.l == r.s.splitlines()


def test_close_is_made_in_doubles(spark):
    rows = [(5.0, 5.2), (12.0, 12.19), (12.0, 12.21), (None, 1.0), (1.0, None)]
    got = [r.ok for r in spark.createDataFrame(rows, "e double, a double").select(text.close(F.col("e"), F.col("a"), 0.2).alias("ok")).collect()]
    assert got == [abs(5.2 - 5) <= 0.2, True, False, False, False]


def test_headings(spark):
    rows = [("# Title",), ("## Subtitle",), ("Just a paragraph",), ("####### seven",), ("#nospace",), ("###### six  ",), (None,)]
    got = [(r.l, r.t) for r in spark.createDataFrame(rows, "s string").select(text.heading_level("s").alias("l"), text.heading_text("s").alias("t")).collect()]
    assert got == [(1, "Title"), (2, "Subtitle"), (None, None), (None, None), (None, None), (6, "six"), (None, None)]


def test_page_range(spark):
    rows = [("1-5,8", 10, [0, 1, 2, 3, 4, 7]), ("3-1", 10, []), (None, 3, [0, 1, 2]), ("0", 5, []), ("0-2", 5, [0, 1]), ("9-20", 10, [8, 9]), ("12", 10, []), ("1", 0, [])]
    for r in spark.createDataFrame(rows, "s string, n int, want array<int>").select("want", text.page_range(F.col("s"), F.col("n")).alias("got")).collect():
        assert r.got == r.want


def test_bounded_ids(spark):
    rows = [("7FFFFFFF", True), ("80000000", False), ("zz", None), ("0", True)]
    for r in spark.createDataFrame(rows, "s string, want boolean").select("want", text.bounded_id(F.col("s"), 16, 0x80000000).alias("got")).collect():
        assert r.got == r.want


def _names(value):
    """A plain model: each name takes its first free place, the small sizes before the others."""
    compact = "".join(value.split())
    taken, out = [False] * len(compact), []
    for name in fonts.SIZE_ORDER:
        for m in re.finditer(name + ("号?" if not name.endswith("号") else ""), compact):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                out.append(name)
                break
    return out


def test_size_names_against_a_model(spark):
    random.seed(5)
    rows = [("".join(random.choice("小初一二三四五六七八号 x") for _ in range(random.randint(0, 12))),) for _ in range(1500)]
    for r in spark.createDataFrame(rows, "s string").select("s", F.transform(fonts.named_sizes("s"), lambda x: x["name"]).alias("n")).collect():
        assert r.n == _names(r.s), r.s


def test_size_signals(spark):
    rows = [("小四号 12pt",), ("三号 15pt",), ("小四 和 四号",), ("12pt 14 PT",), ("none",)]
    got = [(r.x.conflicts, r.x.resolved) for r in spark.createDataFrame(rows, "s string").select(fonts.size_signals("s").alias("x")).collect()]
    assert got == [([], 12.0), (["named_and_explicit_differ"], None), (["several_named_sizes"], None), (["several_explicit_sizes"], None), ([], None)]
