"""Filters over paragraphs, and distributions of their properties with deterministic top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import normalize_name, normalized, number_text, preview, rounded, starts_with_pattern, strip

METRICS = ("style", "font_size", "line_spacing", "first_line_indent", "east_asia_font", "ascii_font")


@dataclass(frozen=True)
class ParagraphFilter:
    """Conditions that a paragraph must meet, all of them; an empty one always holds."""

    style_hints: tuple[str, ...] = ()
    exclude_texts: tuple[str, ...] = ()
    heading_prefixes: tuple[str, ...] = ()
    heading_keywords: tuple[str, ...] = ()
    instruction_hints: tuple[str, ...] = ()
    min_length: int = 0
    require_body_shape: bool = False

    def condition(self, text: Column, style: Column, alignment: Column, indent: Column) -> Column:
        t = strip(F.coalesce(text, F.lit("")))
        tests = [t != ""]
        if self.min_length:
            tests.append(F.length(t) >= self.min_length)
        tests += [~F.contains(t, F.lit(x)) for x in self.exclude_texts]
        tests += [~starts_with_pattern(t, p) for p in self.heading_prefixes]
        tests += [~F.startswith(t, F.lit(k)) for k in self.heading_keywords]
        if self.instruction_hints:  # template instructions: columns of blanks, labels without a sentence, or a hint
            colons = F.length(t) - F.length(F.replace(t, F.lit("："), F.lit("")))
            tests += [~F.contains(t, F.lit("    ")), ~((colons >= 2) & ~F.contains(t, F.lit("。")))]
            tests += [~F.contains(t, F.lit(h)) for h in self.instruction_hints]
        if self.require_body_shape:
            tests.append(F.coalesce(alignment == "justify", F.lit(False)) | F.coalesce(indent > 0, F.lit(False)))
        if self.style_hints:
            tests.append(normalized(style).isin([normalize_name(h) for h in self.style_hints]))
        out = tests[0]
        for x in tests[1:]:
            out = out & x
        return out


def matching(paragraphs: DataFrame, wanted: ParagraphFilter) -> DataFrame:
    """Paragraphs (text, style_name, properties) that meet the filter."""
    p = F.col("properties")
    return paragraphs.where(wanted.condition(F.col("text"), F.col("style_name"), p["alignment"], p["first_line_indent_pt"]))


def observations(paragraphs: DataFrame, keys: list[str], order: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(keys, metric, value, ord): what each paragraph adds to the wanted distributions, made in one pass."""
    p = F.col("properties")
    spacing = F.when(
        p["line_spacing_mode"].isNotNull() | p["line_spacing_value"].isNotNull(),
        F.concat_ws(":", F.coalesce(p["line_spacing_mode"], F.lit("None")), number_text(p["line_spacing_value"])),
    )
    values = {
        "style": F.coalesce(F.nullif(F.col("style_name"), F.lit("")), F.lit("(none)")),
        "font_size": rounded(p["font_size_pt"]).cast("string"),
        "line_spacing": spacing,
        "first_line_indent": rounded(p["first_line_indent_pt"]).cast("string"),
        "east_asia_font": F.when(F.col("text").rlike("[\\x{4e00}-\\x{9fff}]"), F.nullif(p["font_family_east_asia"], F.lit(""))),
        "ascii_font": F.when(F.col("text").rlike("[A-Za-z]"), F.nullif(p["font_family_ascii"], F.lit(""))),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in metrics])
    return (
        paragraphs.select(*keys, F.col(order).alias("ord"), F.explode(pairs).alias("o"))
        .select(*keys, "o.metric", "o.value", "ord")
        .where("value is not null")
    )


def top_values(seen: DataFrame, keys: list[str], top: int = 5, by: str = "ord") -> DataFrame:
    """The ``top`` values of each group by count; equal counts go by where a value was first seen.

    One pre-aggregated shuffle counts the values, and the ranking runs over distinct values only.
    """
    counted = seen.groupBy(*keys, "value").agg(F.count("*").alias("cnt"), F.min(by).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc("first"), F.asc("value")))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "value", "cnt", "rank")


def paragraph_stats(paragraphs: DataFrame, wanted: ParagraphFilter = ParagraphFilter(), keys: list[str] | None = None, top: int = 5) -> DataFrame:
    """(keys, metric, value, cnt, rank) of the paragraphs that meet the filter; needs the column index."""
    keys = keys or ["doc_id"]
    return top_values(observations(matching(paragraphs, wanted), keys, "index"), [*keys, "metric"], top)


def samples(rows: DataFrame, keys: list[str], order: list[str], text: str = "text", limit: int = 8, length: int = 120) -> DataFrame:
    """The first ``limit`` rows of each group in order, with a preview of the text."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("sample", rank).where(F.col("sample") <= limit).withColumn("preview", preview(text, length))


def distributions(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The long form of ``paragraph_stats`` as one row a group: a map from metric to ordered (value, count)."""
    keys = keys or ["doc_id"]
    lists = stats.groupBy(*keys, "metric").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))).alias("d"))
    return lists.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.transform("d", lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("count")))))).alias("distributions")
    )


def summary(paragraphs: DataFrame, wanted: ParagraphFilter = ParagraphFilter(), keys: list[str] | None = None, docs: DataFrame | None = None, sample_limit: int = 8, top: int = 5) -> DataFrame:
    """(keys, candidate_count, distributions, candidate_examples): one row a group, and for each of ``docs`` if given.

    distributions: a map from metric to ordered (value, count). candidate_examples: the first paragraphs in order.
    """
    keys = keys or ["doc_id"]
    kept = matching(paragraphs, wanted)
    lists = distributions(paragraph_stats(paragraphs, wanted, keys, top), keys)
    p = F.col("properties")
    shown = F.struct(*[p[n].alias(n) for n in ("font_size_pt", "line_spacing_mode", "line_spacing_value", "first_line_indent_pt", "font_family_east_asia", "font_family_ascii")])
    example = F.struct(F.col("index").alias("paragraph_index"), "style_name", preview("text", 120).alias("text_preview"), shown.alias("properties"))
    counts = kept.groupBy(*keys).agg(F.count("*").alias("candidate_count"))
    first = samples(kept.withColumn("example", example), keys, ["index", "id", "text"], limit=sample_limit).groupBy(*keys)
    examples = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "example"))), lambda x: x["example"]).alias("candidate_examples"))
    out = counts.join(lists, keys, "left").join(examples, keys, "left")
    if docs is not None:
        out = docs.select(*keys).distinct().join(out, keys, "left")
    return out.withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("bigint"))
