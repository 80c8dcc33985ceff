"""The check engine: selectors, tolerant comparisons, verdicts with evidence.

Checks are a small table by nature. Up to a bound (counted) they are read once to the driver: a paragraph then gets
the list of checks that select it in one pass over the facts, by a broadcast map from style names and by the caption
patterns as constants, and one aggregation a (document, check) gives the verdicts. Beyond the bound the style checks
are a shuffled equi-join and the caption checks a join on their patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import close, normalize_name, normalized, preview, strip

#: Check types: the fields that must be present, the property compared, the tolerance.
TYPES = {
    "font": (("type", "selector", "expected"), "font family of the scope", None),
    "font_size": (("type", "selector", "expected"), "font_size_pt", 0.2),
    "alignment": (("type", "selector", "expected"), "alignment", None),
    "line_spacing": (("type", "selector", "expected"), "line_spacing_mode and line_spacing_value", 0.1),
    "spacing_before": (("type", "selector", "expected"), "space_before_pt", 0.5),
    "spacing_after": (("type", "selector", "expected"), "space_after_pt", 0.5),
    "first_line_indent": (("type", "selector", "expected"), "first_line_indent_pt", 0.5),
    "margin": (("type", "selector", "expected", "side"), "page_margins", 0.05),
    "page_size": (("type", "selector", "expected"), "page_size", 0.1),
    "bold": (("type", "selector", "expected"), "bold", None),
    "italic": (("type", "selector", "expected"), "italic", None),
}
#: Paper sizes in cm.
PAPER = {"a4": (21.0, 29.7)}
BROADCAST_CHECKS = 10_000
#: So many caption checks are constants of the plan; more are a table.
CONSTANT_CAPTIONS = 64
PREVIEW = 80
LAYOUT_TYPES = ("margin", "page_size")
CAPTIONS = ("caption:figure", "caption:table")
#: A mark for every paragraph beside the checks that select it, so that documents are known from the same pass.
_EVERY = -1


def catalog(spark) -> DataFrame:
    """The check types, as a table."""
    rows = [(t, list(need), prop, tol) for t, (need, prop, tol) in TYPES.items()]
    return spark.createDataFrame(rows, "type string, required array<string>, property string, tolerance double")


def validate(checks: list[dict]) -> list[str]:
    """What is wrong with a batch of check instructions, in order; a batch with any error is not run."""
    errors = []
    for n, check in enumerate(checks):
        kind = check.get("type")
        if not kind:
            errors.append(f"check {n}: no type")
        elif kind not in TYPES:
            errors.append(f"check {n}: unknown type {kind}")
        else:
            errors += [f"check {n}: {kind} needs {f}" for f in TYPES[kind][0] if f not in check]
    return errors


def to_rows(checks: list[dict]) -> list[tuple]:
    """Check instructions as rows of schema.CHECKS; ``expected`` is split by its type."""
    rows = []
    for n, c in enumerate(checks):
        e = c.get("expected")
        number = float(e) if isinstance(e, (int, float)) and not isinstance(e, bool) else None
        mode, value = (e.get("mode"), e.get("value")) if isinstance(e, dict) else (None, None)
        rows.append(
            (n, c.get("type"), c.get("selector"), number, e if isinstance(e, str) else None, e if isinstance(e, bool) else None, mode,
             float(value) if value is not None else None, c.get("scope"), c.get("side"), c.get("style_name"), c.get("style_aliases") or [],
             c.get("caption_prefix_patterns") or [], c.get("id"), c.get("section"), c.get("rule_text"), c.get("expected_display"))
        )
    return rows


def _few(checks: DataFrame) -> list | None:
    """The checks' rows if there are at most BROADCAST_CHECKS, else None."""
    rows = checks.limit(BROADCAST_CHECKS + 1).collect()
    return rows if len(rows) <= BROADCAST_CHECKS else None


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with_style_key(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.withColumns({"said": strip(F.coalesce("text", F.lit(""))) != "", "style_key": normalized("style_name")})


def _names(row) -> list[str]:
    """The style names that a style check takes."""
    names = [*(row["style_aliases"] or []), row["style_name"], row["selector"].removeprefix("style:")]
    return [n for n in dict.fromkeys(map(normalize_name, names)) if n]


def _hits(paragraphs: DataFrame, rows: list, every: bool) -> DataFrame:
    """``paragraphs`` with the column idx, one row for each check that selects one (and for _EVERY)."""
    spark = paragraphs.sparkSession
    body = _with_style_key(paragraphs)
    listed: dict[str, list[int]] = {}
    for r in rows:
        if (r["selector"] or "").startswith("style:"):
            for n in _names(r):
                listed.setdefault(n, []).append(r["idx"])
    found = [F.array(F.lit(_EVERY))] if every else []
    if listed:
        styled = spark.createDataFrame([(n, sorted(set(i))) for n, i in listed.items()], "style_key string, styled array<int>")
        body = body.join(F.broadcast(styled), "style_key", "left")
        found.append(F.when(F.col("said"), F.coalesce("styled", _none("int"))).otherwise(_none("int")))
    shown = []
    for r in rows:
        if r["selector"] in CAPTIONS:
            aliases = [normalize_name(x) for x in r["style_aliases"] or []]
            patterns = "|".join(f"(?:{p})" for p in r["caption_prefix_patterns"] or [])
            by_text = F.col("text").rlike(f"^(?:{patterns})") if patterns else F.lit(False)
            shown.append(F.when(F.col("said") & (F.col("style_key").isin(aliases) | by_text if aliases else by_text), F.lit(r["idx"])))
    if shown:
        found.append(F.array_compact(F.array(*shown)))
    hits = F.concat(*found) if found else _none("int")
    return body.withColumn("idx", F.explode(hits)).drop("said", "style_key", "styled")


def _named(checks: DataFrame) -> DataFrame:
    return checks.withColumnRenamed("style_name", "check_style_name")


def select_paragraphs(checks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pairs (all columns of both) of a check and each paragraph it selects; blank paragraphs are not selected.

    Selectors: ``style:<name>`` takes the name, ``style_name`` and ``style_aliases``; ``caption:figure`` and
    ``caption:table`` take a style among the aliases or a text that a pattern matches at its start. Others take none.
    """
    rows = _few(checks)
    if rows is not None and sum(r["selector"] in CAPTIONS for r in rows) <= CONSTANT_CAPTIONS:
        return _hits(paragraphs, rows, False).join(F.broadcast(_named(checks)), "idx")
    return _joined(checks, paragraphs, rows is not None)


def _joined(checks: DataFrame, paragraphs: DataFrame, few: bool) -> DataFrame:
    """``select_paragraphs`` as joins, for any number of checks."""
    body = _with_style_key(paragraphs).where("said").drop("said")
    suffix = F.regexp_extract("selector", "(?s)^style:(.*)$", 1)
    names = F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("style_aliases", _none("string")), F.array("style_name", suffix)), normalized), lambda x: x != ""))
    named = _named(checks.where(F.startswith(F.col("selector"), F.lit("style:"))).withColumn("style_key", F.explode(names)))
    by_style = body.join(F.broadcast(named) if few else named, "style_key").drop("style_key")
    captions = _named(checks.where(F.col("selector").isin(*CAPTIONS)))
    aliases = F.transform(F.coalesce("style_aliases", _none("string")), normalized)
    shown = F.exists(F.coalesce("caption_prefix_patterns", _none("string")), lambda p: F.rlike("text", F.concat(F.lit("^(?:"), p, F.lit(")"))))
    by_caption = body.join(F.broadcast(captions) if few else captions, F.array_contains(aliases, F.col("style_key")) | shown).drop("style_key")
    return by_style.unionByName(by_caption)


def _given(value: Column) -> Column:
    """A number as given, whole ones with their fraction."""
    return value.cast("double").cast("string")


def compared(kind: Column, p: Column) -> tuple[Column, Column, Column, Column]:
    """(applies, ok, actual as text, property) for a selected paragraph with properties ``p`` under a check's columns.

    A switch counts as the number 1 or 0 on either side; texts are compared by their normalised form.
    """
    east = F.coalesce(F.col("scope"), F.lit("east_asia")) == "east_asia"
    scoped = F.when(east, p["font_family_east_asia"]).otherwise(p["font_family_ascii"])
    num, text = F.coalesce(F.col("expected_num"), F.col("expected_bool").cast("double")), F.col("expected_str")
    same = lambda a: F.coalesce(normalized(a) == normalized(text), F.lit(False)) & a.isNotNull() & text.isNotNull()
    mode, value = p["line_spacing_mode"], p["line_spacing_value"]
    spacing = mode.eqNullSafe(F.col("expected_mode")) & close(F.col("expected_value"), value, 0.1)
    spaced = F.when(mode.isNotNull() | value.isNotNull(), F.concat(F.coalesce(mode, F.lit("None")), F.lit(":"), F.coalesce(_given(value), F.lit("None"))))
    number = lambda name, tolerance: (close(num, p[name].cast("double"), tolerance), p[name].cast("string"), F.lit(name))
    cases = {
        "font": (same(scoped), scoped, F.when(east, "font_family_east_asia").otherwise("font_family_ascii")),
        "font_size": number("font_size_pt", 0.2),
        "alignment": (same(p["alignment"]), p["alignment"], F.lit("alignment")),
        "bold": number("bold", 0.0),
        "italic": number("italic", 0.0),
        "line_spacing": (spacing, spaced, F.lit("line_spacing")),
        "spacing_before": number("space_before_pt", 0.5),
        "spacing_after": number("space_after_pt", 0.5),
        "first_line_indent": number("first_line_indent_pt", 0.5),
    }
    ok, actual, prop = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (good, found, called) in cases.items():
        ok = F.when(kind == name, good).otherwise(ok)
        actual = F.when(kind == name, found).otherwise(actual)
        prop = F.when(kind == name, called).otherwise(prop)
    return (kind != "font") | scoped.isNotNull(), ok, actual, prop


def verdicts(pairs: DataFrame, checks: DataFrame, docs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row a (document, check): matched_count, failed, status and a text for the actual state.

    pairs: columns of ``group``, idx, ok. A check that selects nothing is unresolved: it keeps its row, and the
    counts and the actual state are NULL.
    """
    group = group or ["doc_id"]
    counts = pairs.groupBy(*group, "idx").agg(F.count("*").alias("matched_count"), F.count_if(~F.col("ok")).alias("failed"), F.lit(0).cast("bigint").alias("skipped"))
    every = docs.select(*group).distinct().join(bounded(checks), F.lit(True))  # each check meets each document by definition
    return _told(every.join(counts, [*group, "idx"], "left"), group, checks.columns)


def bounded(checks: DataFrame) -> DataFrame:
    """The checks, marked for broadcast if there are at most BROADCAST_CHECKS."""
    return F.broadcast(checks) if checks.limit(BROADCAST_CHECKS + 1).count() <= BROADCAST_CHECKS else checks


def _told(counted: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """The verdicts of rows with matched_count (NULL: none), failed and skipped (paragraphs without the font)."""
    there = F.coalesce(F.col("matched_count") > 0, F.lit(False))
    n, bad = F.col("matched_count").cast("string"), F.col("failed").cast("string")
    scope = F.coalesce(F.col("scope"), F.lit("east_asia")) if "scope" in columns else F.lit("east_asia")
    note = F.when(F.coalesce(F.col("skipped") > 0, F.lit(False)), F.concat(F.lit(" (skipped "), F.col("skipped").cast("string"), F.lit(" without "), scope, F.lit(" font)"))).otherwise("")
    return counted.select(
        *group,
        *columns,
        F.when(there, F.col("matched_count")).alias("matched_count"),
        F.when(there, F.col("failed")).alias("failed"),
        F.when(~there, "unresolved").when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"),
        F.when(there, F.concat(F.when(F.col("failed") > 0, F.concat(bad, F.lit("/"), n, F.lit(" mismatch"))).otherwise(F.concat(n, F.lit(" ok"))), note)).alias("actual"),
    )


def run_checks(checks: DataFrame, paragraphs: DataFrame, layouts: DataFrame | None = None, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, issues) for every document; ``checks`` is a valid table of schema.CHECKS, ``layouts`` has doc_id and layout.

    docs: a table with every doc_id. Without it documents are those of the paragraphs and layouts, and one that has
    neither is not known. issues: paragraphs and layouts that do not agree, and a row for each unresolved check.
    """
    shown = F.coalesce("expected_display", F.coalesce(F.col("expected_num").cast("string"), "expected_str", F.col("expected_bool").cast("string"), F.when(F.col("expected_mode").isNotNull(), F.concat_ws(":", "expected_mode", F.col("expected_value").cast("string")))))
    known = docs if docs is not None else layouts
    rows = _few(checks)
    text_checks = checks.where(~F.col("type").isin(*LAYOUT_TYPES))
    facts = paragraphs.withColumnRenamed("id", "paragraph_id")
    applies, ok, actual, prop = compared(F.col("type"), F.col("properties"))
    judge = lambda pairs: pairs.withColumns({"applies": applies, "ok": ok, "actual": actual, "property": prop})
    counts = [F.count_if("applies").alias("matched_count"), F.count_if(F.col("applies") & ~F.col("ok")).alias("failed"), F.count_if(~F.col("applies")).alias("skipped")]
    by_text = [r for r in rows or [] if r["type"] not in LAYOUT_TYPES]
    if rows is not None and sum(r["selector"] in CAPTIONS for r in by_text) <= CONSTANT_CAPTIONS:
        hits = _hits(facts, by_text, True)
        judged = judge(hits.join(F.broadcast(_named(text_checks)), "idx", "left"))
        counted = judged.groupBy("doc_id", "idx").agg(*counts)
        mapped = counted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct("matched_count", "failed", "skipped")))).alias("by_check"))
        if known is not None:
            mapped = mapped.join(known.select("doc_id").distinct(), "doc_id", "full")
        met = mapped.join(F.broadcast(text_checks), F.lit(True))  # each check meets each document by definition
        found = F.try_element_at("by_check", F.col("idx"))
        results = _told(met.withColumns({n: found[n] for n in ("matched_count", "failed", "skipped")}), ["doc_id"], text_checks.columns)
        judged = judged.where(F.col("idx") != _EVERY)
    else:
        judged = judge(_joined(text_checks, facts, rows is not None))
        counted = judged.groupBy("doc_id", "idx").agg(*counts)
        every = paragraphs.select("doc_id") if known is None else paragraphs.select("doc_id").unionByName(known.select("doc_id"))
        results = _told(every.distinct().join(bounded(text_checks), F.lit(True)).join(counted, ["doc_id", "idx"], "left"), ["doc_id"], text_checks.columns)
    results = results.withColumn("expected", shown)
    text = F.lit(None).cast("string")
    place = [F.lit(None).cast("int").alias("paragraph_index"), text.alias("paragraph_id"), text.alias("style_name"), text.alias("text_preview")]
    message = lambda name, missing: F.concat(name, F.when(missing, F.lit(" missing")).otherwise(F.lit(" mismatch")))
    issues = judged.where("applies and not ok").select(
        "doc_id", "idx", text.alias("location"), F.col("index").alias("paragraph_index"), "paragraph_id", "style_name", preview("text", PREVIEW).alias("text_preview"),
        F.col("expected_display").alias("expected"), "actual", message(F.col("property"), F.col("actual").isNull() & (F.col("type") != "line_spacing")).alias("message"),
    )
    issues = issues.unionByName(
        results.where("status = 'unresolved'").select("doc_id", "idx", F.col("selector").alias("location"), *place, F.col("expected_display").alias("expected"), text.alias("actual"), F.lit("no matching paragraphs").alias("message"))
    )
    if layouts is not None:
        page, margins, side = F.col("layout.page_size"), F.col("layout.page_margins"), F.col("side")
        margin = F.when(side == "top", margins["top_cm"]).when(side == "bottom", margins["bottom_cm"]).when(side == "left", margins["left_cm"]).when(side == "right", margins["right_cm"])
        fits = F.lit(False)
        for name, (w, h) in PAPER.items():
            fits = fits | ((normalized("expected_str") == name) & close(F.lit(w), page["width_cm"], 0.1) & close(F.lit(h), page["height_cm"], 0.1))
        is_margin, cm = F.col("type") == "margin", F.lit("cm")
        good = F.when(is_margin, close(F.col("expected_num"), margin, 0.05)).otherwise(F.coalesce(fits, F.lit(False)))
        found = F.when(is_margin, F.concat(_given(margin), cm)).otherwise(F.concat(_given(page["width_cm"]), F.lit("cm x "), _given(page["height_cm"]), cm))
        wanted = F.coalesce("expected_display", F.when(is_margin, F.concat(F.col("expected_num").cast("string"), cm)).otherwise(F.col("expected_str")))
        page_checks = checks.where(F.col("type").isin(*LAYOUT_TYPES))
        pages = layouts.select("doc_id", "layout") if docs is None else docs.select("doc_id").distinct().join(layouts.select("doc_id", "layout"), "doc_id", "left")
        whole = pages.join(bounded(page_checks), F.lit(True)).withColumns({"good": good, "found": found})
        results = results.unionByName(
            whole.select("doc_id", *checks.columns, F.lit(None).cast("bigint").alias("matched_count"), F.when(F.col("good"), 0).otherwise(1).cast("bigint").alias("failed"),
                         F.when(F.col("good"), "pass").otherwise("fail").alias("status"), F.col("found").alias("actual"), shown.alias("expected"))
        )
        where = F.when(is_margin, F.concat(F.lit("document.layout:"), side)).otherwise("document.layout:page_size")
        issues = issues.unionByName(
            whole.where("not good").select("doc_id", "idx", where.alias("location"), *place, wanted.alias("expected"), F.col("found").alias("actual"),
                                           F.when(is_margin, F.concat(F.lit("margin "), side, F.lit(" mismatch"))).otherwise("page_size mismatch").alias("message"))
        )
    return results, issues


def summary(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts of the verdicts."""
    group = group or ["doc_id"]
    return results.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pass").alias("pass"),
        F.count_if(F.col("status") == "fail").alias("fail"),
        F.count_if(F.col("status") == "unresolved").alias("unresolved"),
    )
