"""Filters, distributions, the check engine, specifications and styles, on the cases of FIXTURES.md."""

import pytest

from factloom import schema
from factloom.api import Analysis
from factloom.operators import checks, compare, spec, stats, styles

PROPS = ("alignment", "line_spacing_mode", "line_spacing_value", "space_before_pt", "space_after_pt", "first_line_indent_pt", "font_family_east_asia", "font_family_ascii", "font_family", "font_size_pt", "bold", "italic", "underline")


def paragraph(index, text, style=None, **props):
    return ("d", f"p-{index + 1}", index, text, style, None, tuple(props.get(p) for p in PROPS), None, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schema.PARAGRAPHS)


LONG = "This is a sample paragraph with enough length."


@pytest.mark.parametrize(
    ("row", "wanted", "kept"),
    [
        ((LONG, "Normal", {}), {}, True),
        ((LONG, "Normal", {}), {"style_hints": ("normal",)}, True),
        ((LONG, "Normal", {}), {"style_hints": ("heading",)}, False),
        ((LONG, None, {}), {"min_length": 10}, True),
        (("Short", None, {}), {"min_length": 20}, False),
        ((LONG, None, {"alignment": "justify", "first_line_indent_pt": 24.0}), {"require_body_shape": True}, True),
        ((LONG, None, {"alignment": "left", "first_line_indent_pt": 0.0}), {"require_body_shape": True}, False),
        ((LONG, None, {}), {"require_body_shape": True}, False),
        ((LONG, None, {}), {"exclude_texts": ("sample",)}, False),
        ((LONG, None, {}), {"heading_prefixes": ("T[a-z]+",)}, False),
        ((LONG, None, {}), {"heading_prefixes": ("sample",)}, True),
        ((LONG, None, {}), {"heading_keywords": ("This",)}, False),
        (("a    b", None, {}), {"instruction_hints": ("zzz",)}, False),
        (("姓名：学号：", None, {}), {"instruction_hints": ("zzz",)}, False),
        (("姓名：学号：完。", None, {}), {"instruction_hints": ("zzz",)}, True),
        (("  ", None, {}), {}, False),
        ((None, None, {}), {}, False),
    ],
)
def test_filter(spark, row, wanted, kept):
    text, style, props = row
    assert (stats.matching(frame(spark, paragraph(0, text, style, **props)), stats.ParagraphFilter(**wanted)).count() == 1) == kept


def test_distributions_break_ties_by_first_seen(spark):
    rows = [paragraph(i, "字a", None, font_size_pt=s, font_family_east_asia="宋体", line_spacing_mode="exact" if i else None, line_spacing_value=20.0) for i, s in enumerate([12.0, 14.0, 12.0, 16.0])]
    got = {(r.metric, r["rank"]): (r.value, r.cnt) for r in stats.paragraph_stats(frame(spark, *rows)).collect()}
    assert got["font_size", 1] == ("12.0", 2) and got["font_size", 2] == ("14.0", 1) and got["font_size", 3] == ("16.0", 1)
    assert got["style", 1] == ("(none)", 4) and got["east_asia_font", 1] == ("宋体", 4)
    assert got["line_spacing", 1] == ("exact:20.0", 3) and got["line_spacing", 2] == ("None:20.0", 1)
    assert stats.paragraph_stats(frame(spark)).count() == 0
    assert len(stats.distributions(stats.paragraph_stats(frame(spark, *rows))).first().distributions) == 4


def test_checks(spark):
    rows = [paragraph(0, "one", "Body Text", font_size_pt=12.19, bold=True), paragraph(1, "two", "bodytext", font_size_pt=12.21), paragraph(2, " ", "bodytext", font_size_pt=1.0), paragraph(3, "Figure 1 x", "Caption", font_size_pt=10.0), paragraph(4, "Table 2", "z", font_size_pt=9.0)]
    batch = [
        {"type": "font_size", "selector": "style:Body Text", "style_aliases": ["BODYTEXT", "body text"], "expected": 12, "expected_display": "12pt"},
        {"type": "bold", "selector": "style:bodytext", "expected": True},
        {"type": "font", "selector": "style:bodytext", "expected": "宋体"},
        {"type": "font_size", "selector": "caption:figure", "expected": 10, "caption_prefix_patterns": ["Figure [0-9]"]},
        {"type": "font_size", "selector": "caption:figure", "expected": 10, "caption_prefix_patterns": ["igure", "Table"]},
        {"type": "font_size", "selector": "other", "expected": 10},
    ]
    results, issues = Analysis(spark).check(frame(spark, *rows), batch)
    got = {r.idx: (r.status, r.matched_count, r.actual) for r in results.collect()}
    assert got[0] == ("fail", 2, "1/2 mismatch") and got[1] == ("fail", 2, "1/2 mismatch")
    assert got[2] == ("unresolved", None, None) and got[3] == ("pass", 1, "1 ok")
    assert got[4] == ("fail", 1, "1/1 mismatch") and got[5] == ("unresolved", None, None)
    told = {(r.idx, r.paragraph_id): (r.location, r.expected, r.message) for r in issues.collect()}
    assert told[0, "p-2"] == (None, "12pt", "font_size_pt mismatch") and told[1, "p-2"] == (None, None, "bold missing")
    assert told[2, None] == ("style:bodytext", None, "no matching paragraphs") and told[5, None] == ("other", None, "no matching paragraphs")


def test_many_checks_give_the_same_verdicts(spark, monkeypatch):
    rows = [paragraph(n, f"Figure {n}" if n % 3 else " text", f"s{n % 4}", font_size_pt=10.0 + n % 2, font_family_ascii="A" if n % 5 else None) for n in range(40)]
    batch = [{"type": "font_size", "selector": f"style:S{n}", "expected": 10, "style_aliases": [f"s {(n + 1) % 4}"]} for n in range(5)]
    batch += [{"type": "font", "selector": "caption:figure", "expected": "a", "scope": "ascii", "caption_prefix_patterns": ["Figure [0-9]$", "Table"], "style_aliases": ["s2"]}, {"type": "font", "selector": "caption:table", "expected": "a"}]
    few = [sorted(map(tuple, x.collect()), key=repr) for x in Analysis(spark).check(frame(spark, *rows), batch)]
    monkeypatch.setattr(checks, "CONSTANT_CAPTIONS", 0)
    assert [sorted(map(tuple, x.collect()), key=repr) for x in Analysis(spark).check(frame(spark, *rows), batch)] == few
    monkeypatch.setattr(checks, "BROADCAST_CHECKS", 2)
    assert [sorted(map(tuple, x.collect()), key=repr) for x in Analysis(spark).check(frame(spark, *rows), batch)] == few
    assert any("(skipped" in str(r) for r in few[0])


def test_documents_without_paragraphs_have_verdicts(spark):
    batch = [{"type": "bold", "selector": "style:x", "expected": True}, {"type": "margin", "selector": "document:layout", "side": "top", "expected": 2}]
    table, docs = spark.createDataFrame(checks.to_rows(batch), schema.CHECKS), spark.createDataFrame([("lone",)], "doc_id string")
    layouts = spark.createDataFrame([], f"doc_id string, layout {schema.LAYOUT}")
    results, issues = checks.run_checks(table, frame(spark), layouts, docs)
    assert {(r.doc_id, r.idx, r.status, r.actual) for r in results.collect()} == {("lone", 0, "unresolved", None), ("lone", 1, "fail", None)}
    assert {(r.location, r.expected, r.message) for r in issues.collect()} == {("style:x", None, "no matching paragraphs"), ("document.layout:top", "2.0cm", "margin top mismatch")}


def test_the_facts_are_read_once(spark, tmp_path):
    frame(spark, *[paragraph(n, "Figure 1", "a", font_size_pt=1.0) for n in range(3)]).write.parquet(str(tmp_path / "p"))
    batch = [{"type": "font_size", "selector": "style:a", "expected": 1}, {"type": "font_size", "selector": "caption:figure", "expected": 1, "caption_prefix_patterns": ["Figure"]}]
    results, _ = Analysis(spark).check(spark.read.parquet(str(tmp_path / "p")), batch)
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and [r.matched_count for r in results.collect()] == [3, 3]


def test_invalid_batches_are_not_run(spark):
    assert len(checks.validate([{"type": "nope"}, {}, {"type": "margin", "selector": "x", "expected": 1}])) == 3
    with pytest.raises(ValueError):
        Analysis(spark).check(frame(spark), [{"type": "nope"}])


def _spec(spark, *lines):
    return spark.createDataFrame([("s", n, t) for n, t in enumerate(lines, 1)], schema.SPEC_LINES)


def test_conflicts(spark):
    assert spec.conflicts(_spec(spark, "# 正文格式", "正文使用宋体小四号字体")).count() == 0
    assert spec.conflicts(_spec(spark, "小四号 12pt", "三号 16pt")).count() == 0
    got = spec.conflicts(_spec(spark, "# A", "行距 20pt", "# B", "三号 12pt")).orderBy("pass_no").collect()
    assert [(r.pass_no, r.context) for r in got] == [(1, "B"), (3, "A")]
    got = spec.conflicts(_spec(spark, "小四 12pt 12pt", "# C", "小四 14pt")).orderBy("pass_no", "line_number").collect()
    across = [r for r in got if r.pass_no == 2]
    assert [(r.text, r.type, r.line_number, list(r.reasons), [x.pt for x in r.examples]) for r in across] == [("小四", "font_size_inconsistent_across_spec", 1, ["小四", "12.0", "14.0"], [12.0, 14.0])]
    assert spec.status(spec.conflicts(_spec(spark, "三号 12pt", "小四 14pt 12pt")), _spec(spark, "x")).first().conflict_types == ["font_size_conflict"]


def test_no_size_is_resolved_where_sizes_conflict(spark):
    from factloom.functions.fonts import size_signals

    rows = spark.createDataFrame([("三号 12pt",), ("小四 12pt 12pt",), ("三号 16.1pt",), ("小四",), ("小四 五号",)], "text string").select(size_signals("text").alias("s")).collect()
    assert [r.s.resolved for r in rows] == [None, 12.0, 16.1, 12.0, None] and rows[1].s.explicit == [12.0]


def test_structure(spark):
    names = ["# 正文格式", "# 标题", "# 字体", "# 页眉", "# 页脚", "# 页边距"]
    assert spec.structure(spark, _spec(spark, *names)).where("status = 'missing'").count() == 0
    assert "标题" in [r.section for r in spec.structure(spark, _spec(spark, "# 正文格式")).where("status = 'missing'").collect()]
    assert spec.structure(spark, _spec(spark, "# Custom Section"), {"x": ("Custom",)}).first().status == "covered"


def test_body_consistency(spark):
    rows = [paragraph(i, "字", None, font_size_pt=12.0, font_family_east_asia="宋体") for i in range(5)]
    evidence = stats.paragraph_stats(frame(spark, *rows))
    batch = [{"type": "font_size", "selector": "s", "expected": 12, "section": "正文"}, {"type": "font", "selector": "s", "expected": "宋体", "section": "正文"}, {"type": "font_size", "selector": "s", "expected": 16, "section": "标题"}]
    table = spark.createDataFrame(checks.to_rows(batch), schema.CHECKS)
    assert [r.verdict for r in spec.body_consistency(table, evidence, ("正文", "body")).collect()] == ["supported"] * 2
    assert spec.body_consistency(table, evidence).where("verdict = 'mismatch'").count() == 1


def test_style_cycles_end(spark):
    rows = [("d", "a", "b", 1.0, None), ("d", "b", "a", None, True)]
    got = {r.style_id: (r.size, r.bold) for r in styles.resolve_styles(spark, spark.createDataFrame(rows, "doc_id string, style_id string, base_style_id string, size double, bold boolean"), ["size", "bold"]).collect()}
    assert got == {"a": (1.0, True), "b": (1.0, True)}


_STYLE = "doc_id string, style_id string, base_style_id string, size double, bold boolean"


def test_long_chains_and_cycles(spark):
    rows = [("d", f"s{n:03d}", f"s{n - 1:03d}" if n else None, 7.0 if n == 0 else None, True if n == 0 else False if n == 99 else None) for n in range(100)]
    rows += [("c", "tail", "x", None, None), ("c", "x", "y", 1.0, None), ("c", "y", "z", 2.0, False), ("c", "z", "x", None, True), ("c", "self", "self", 3.0, None), ("c", "lost", "gone", 4.0, None), ("c", "lost", "gone", 4.0, None), (None, "n", "x", 5.0, None)]
    table = spark.createDataFrame(rows, _STYLE)
    got = {(r.doc_id, r.style_id): (r.size, r.bold) for r in styles.resolve_styles(spark, table, ["size", "bold"]).collect()}
    assert len(got) == 107 and all(got["d", f"s{n:03d}"] == (7.0, True) for n in range(100))
    # tail, x, y, z: the outermost before the chain comes back to x is z; from y it is x, which says nothing, then z
    assert got["c", "tail"] == (1.0, True) and got["c", "x"] == (1.0, True) and got["c", "y"] == (2.0, True) and got["c", "z"] == (1.0, False)
    assert got["c", "self"] == (3.0, None) and got["c", "lost"] == (4.0, None) and got[None, "n"] == (5.0, None)
    chains = {(r.doc_id, r.style_id, r.depth): r.ancestor for r in styles.style_chains(spark, table).collect()}
    assert chains["d", "s099", 99] == "s000" and chains["c", "z", 2] == "y" and ("c", "z", 3) not in chains and ("c", "lost", 1) not in chains


def test_two_million_styles(spark):
    from pyspark.sql import functions as F

    n = F.col("id")
    table = spark.range(2_000_000).select(F.expr("id div 25").alias("doc_id"), (n % 25).alias("style_id"), F.when(n % 25 > 0, n % 25 - 1).alias("base_style_id"), F.when(n % 25 == 0, n).alias("size"))
    out = styles.resolve_styles(spark, table, ["size"])
    assert out.where("size = doc_id * 25").count() == 2_000_000


def test_report(spark):
    rows = spark.createDataFrame([("a", "b", "layout", "w", "1", "2"), ("a", "b", "paragraph_count", "", "3", None)], "reference_id string, target_id string, type string, key string, reference string, target string")
    text = compare.report(rows).first().markdown
    assert "1. w: 1 -> 2" in text and "3 -> none" in text
