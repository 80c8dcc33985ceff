"""Markdown format specifications: heading context, contradictions, missing sections, evidence, common sense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.fonts import CHINESE_FONTS, WESTERN_FONTS, size_signals
from factloom.functions.text import WS, close, heading_level, heading_text, strip
from factloom.operators.checks import bounded

#: Words that name a line-spacing mode.
SPACING_MODES = ("固定值", "最小值", "多倍行距", "exact", "at_least", "multiple")
SPACING_VALUE = rf"(?i)行距[^|]*?([0-9]+\.?[0-9]*){WS}*pt"
#: Sections that a specification must cover, by words in headings.
SECTIONS = {
    "正文": ("正文", "正文格式", "body"),
    "标题": ("标题", "heading"),
    "字体": ("字体", "font"),
    "页眉": ("页眉", "header"),
    "页脚": ("页脚", "footer"),
    "页边距": ("页边距", "margin"),
}
_EAST, _WEST = "(?:中文字体|中文|east_asia|eastasia)", "(?:西文字体|西文|ascii|英文)"


def with_context(lines: DataFrame) -> DataFrame:
    """``lines`` (spec_id, line_number, text) with level, heading and context.

    context: the latest heading of each level, joined from the outside in; a heading ends those of deeper levels.
    Six running values over one order a specification; a level counts if it is later than all outer levels.
    """
    w = Window.partitionBy("spec_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = lines.withColumns({"level": heading_level("text"), "heading": heading_text("text")})
    last = {f"h{k}": F.last(F.when(F.col("level") == k, F.struct("line_number", "heading")), ignorenulls=True).over(w) for k in range(1, 7)}
    at = found.withColumns(last)
    shown = []
    for k in range(1, 7):
        outer = [F.coalesce(F.col(f"h{j}.line_number"), F.lit(0)) for j in range(1, k)]
        newest = F.greatest(*outer) if len(outer) > 1 else outer[0] if outer else F.lit(0)
        shown.append(F.when(F.col(f"h{k}.line_number") > newest, F.col(f"h{k}.heading")))
    return at.withColumn("context", F.array_join(F.array_compact(F.array(*shown)), " / ")).drop(*last)


def headings(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"level": heading_level("text"), "heading": heading_text("text")}).where("level is not null").select("spec_id", "line_number", "level", "heading")


_EXAMPLES = "array<struct<line_number:int,context:string,text:string,pt:double>>"


def conflicts(lines: DataFrame) -> DataFrame:
    """(spec_id, pass_no, line_number, context, text, type, reasons, examples) of what contradicts itself.

    1: a line whose sizes disagree. 2: a size name (the text of the row) with several explicit sizes over the lines
    that hold exactly one name and one size, at its first line, with these lines as examples. 3: a line spacing in pt
    without a mode (headings included, with their own context). examples is NULL in 1 and 3.
    """
    at = with_context(lines).withColumn("s", size_signals("text"))
    plain = at.where("level is null")
    none = F.lit(None).cast(_EXAMPLES).alias("examples")
    first = plain.where("size(s.conflicts) > 0").select(
        "spec_id", F.lit(1).alias("pass_no"), "line_number", "context", strip("text").alias("text"), F.lit("font_size_conflict").alias("type"), F.col("s.conflicts").alias("reasons"), none
    )
    single = plain.where("size(s.named) = 1 and size(s.explicit) = 1").select(
        "spec_id", "line_number", "context", strip("text").alias("text"), F.expr("s.named[0].name").alias("name"), F.expr("s.explicit[0]").alias("pt")
    )
    across = (
        single.groupBy("spec_id", "name")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("line_number").cast("int").alias("line_number"), "context", "text", "pt"))).alias("examples"))
        .withColumn("pts", F.array_sort(F.array_distinct(F.col("examples.pt"))))
        .where("size(pts) > 1")
        .select("spec_id", F.lit(2).alias("pass_no"), F.expr("examples[0].line_number").alias("line_number"), F.expr("examples[0].context").alias("context"), F.col("name").alias("text"),
                F.lit("font_size_inconsistent_across_spec").alias("type"), F.concat(F.array("name"), F.transform("pts", lambda x: x.cast("string"))).alias("reasons"), F.col("examples").cast(_EXAMPLES).alias("examples"))
    )
    has_mode = F.lit(False)
    for mode in SPACING_MODES:
        has_mode = has_mode | F.contains(F.lower("text"), F.lit(mode))
    spacing = at.where(F.col("text").rlike(SPACING_VALUE) & ~has_mode).select(
        "spec_id", F.lit(3).alias("pass_no"), "line_number", "context", strip("text").alias("text"), F.lit("line_spacing_mode_missing").alias("type"), F.array(F.lit("no_mode")).alias("reasons"), none
    )
    return first.unionByName(across).unionByName(spacing)


def structure(spark: SparkSession, lines: DataFrame, sections: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(spec_id, section, matched, first_line, status): the required sections by headings that hold one of their words."""
    rules = spark.createDataFrame([(n, s, list(k)) for n, (s, k) in enumerate((sections or SECTIONS).items())], "rank int, section string, words array<string>")
    specs = lines.select("spec_id").distinct().join(F.broadcast(rules), F.lit(True))  # every specification needs every section
    found = headings(lines)
    hit = specs.join(found, "spec_id", "left").withColumn("hit", F.coalesce(F.exists("words", lambda w: F.contains(F.col("heading"), w)), F.lit(False)))
    return hit.groupBy("spec_id", "rank", "section").agg(F.count_if("hit").alias("matched"), F.min(F.when(F.col("hit"), F.col("line_number"))).alias("first_line")).select(
        "spec_id", "section", "matched", "first_line", F.when(F.col("matched") > 0, "covered").otherwise("missing").alias("status")
    )


def body_consistency(checks: DataFrame, top: DataFrame, keywords: tuple[str, ...] = (), keys: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Checks against the top value of each distribution: (keys, idx, type, rule_text, expected, actual, verdict).

    top: (keys, metric, value, cnt, rank) of ``paragraph_stats``. docs: a table of all ``keys``, so that those without
    any evidence are answered too. verdict: supported or mismatch, also where there is nothing to compare with; fonts
    seen fewer than three times say nothing. A line spacing is compared by mode and by number, so 20 and 20.0 agree.
    Other types are not compared.
    """
    keys = keys or ["doc_id"]
    metric = (
        F.when(F.col("type") == "font", F.when(F.coalesce("scope", F.lit("east_asia")) == "east_asia", "east_asia_font").otherwise("ascii_font"))
        .when(F.col("type").isin("font_size", "line_spacing", "first_line_indent"), F.col("type"))
    )
    wanted = checks.withColumn("metric", metric).where("metric is not null")
    if keywords:
        wanted = wanted.where(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.coalesce(F.col("section"), F.lit("")), k)))
    firsts = F.collect_list(F.when(F.col("rank") == 1, F.struct("metric", F.struct("value", "cnt"))))
    groups = top.groupBy(*keys).agg(F.map_from_entries(firsts).alias("best"))
    if docs is not None:
        groups = docs.select(*keys).distinct().join(groups, keys, "left")
    best = F.try_element_at("best", F.col("metric"))
    rows = groups.join(bounded(wanted), F.lit(True)).withColumns({"value": best["value"], "cnt": best["cnt"]})  # every check meets every group's evidence
    spaced = F.split("value", ":")
    ok = (
        F.when(F.col("type") == "font_size", close(F.col("expected_num"), F.col("value").try_cast("double"), 0.2))
        .when(F.col("type") == "first_line_indent", close(F.col("expected_num"), F.col("value").try_cast("double"), 1.0))
        .when(
            F.col("type") == "line_spacing",
            F.coalesce((F.get(spaced, F.lit(0)) == F.col("expected_mode")) & (F.get(spaced, F.lit(1)).try_cast("double") == F.col("expected_value")), F.lit(False)),
        )
        .otherwise(F.coalesce(F.col("value") == F.col("expected_str"), F.lit(False)))
    )
    expected = F.coalesce(F.col("expected_num").cast("string"), "expected_str", F.concat_ws(":", "expected_mode", F.col("expected_value").cast("string")))
    kept = (F.col("type") != "font") | (F.coalesce("cnt", F.lit(0)) >= 3)
    return rows.where(kept).select(*keys, "idx", "type", "rule_text", expected.alias("expected"), F.col("value").alias("actual"), F.when(ok, "supported").otherwise("mismatch").alias("verdict"))


def common_sense(lines: DataFrame) -> DataFrame:
    """(spec_id, line_number, context, text, type, pattern, east_asia_font, ascii_font): Chinese fonts given for Western text.

    Four wordings: pair, named pair, reversed pair, Western alone. A place that two of them match is reported twice.
    """
    chinese = "|".join(CHINESE_FONTS)
    fonts = "|".join([*sorted(CHINESE_FONTS, key=len, reverse=True), *WESTERN_FONTS])
    gap, sep = f"{WS}*[，,]?{WS}*", f"[：:]{WS}*"
    wordings = {  # regex, group of the Chinese font's place, group of the Western place
        "pair": (f"({chinese}){WS}*[/／]{WS}*({chinese})", 1, 2),
        "named": (f"(?i){_EAST}{sep}({fonts}){gap}{_WEST}{sep}({fonts})", 1, 2),
        "reversed": (f"(?i){_WEST}{sep}({fonts}){gap}{_EAST}{sep}({fonts})", 2, 1),
        "western": (f"(?i){_WEST}{sep}({chinese})", None, 1),
    }
    at = with_context(lines).where("level is null")
    out = None
    for name, (regex, east, west) in wordings.items():
        got = lambda g: F.regexp_extract_all("text", F.lit(regex), F.lit(g))  # noqa: B023, E731
        pairs = F.arrays_zip(got(east or west).alias("e"), got(west).alias("w"))
        hits = at.select("spec_id", "line_number", "context", strip("text").alias("shown"), F.explode(pairs).alias("p")).select(
            "spec_id", "line_number", "context", F.col("shown").alias("text"), F.lit("font_common_sense_conflict").alias("type"), F.lit(name).alias("pattern"),
            (F.col("p.e") if east else F.lit(None).cast("string")).alias("east_asia_font"), F.col("p.w").alias("ascii_font"),
        )
        hits = hits.where(F.col("ascii_font").isin(*CHINESE_FONTS))
        out = hits if out is None else out.unionByName(hits)
    return out


def status(found: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, conflict_count, conflict_types, status) for every specification in ``specs``; the types are distinct and sorted."""
    counts = found.groupBy("spec_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return specs.select("spec_id").distinct().join(counts, "spec_id", "left").select(
        "spec_id", n.alias("conflict_count"), F.coalesce("types", F.array().cast("array<string>")).alias("conflict_types"), F.when(n == 0, "pass").otherwise("needs_revision").alias("status")
    )


def column_lines(spec_id: Column, text: Column) -> tuple[Column, Column]:
    """For a table of whole texts: the id, and an array of (line_number, text) to explode."""
    from factloom.functions.text import lines as split_lines

    return spec_id, F.transform(split_lines(text), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("text")))
