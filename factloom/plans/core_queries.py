"""The registered queries of the core engine: each applies an operator to whole tables or to rows given in line."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema
from factloom.api import query_style, query_text
from factloom.functions.fonts import CHINESE_FONTS, NAMED_SIZES, SIZE_ORDER, WESTERN_FONTS, size_signals
from factloom.functions.text import bounded_id, heading_level, heading_text, line_count, lines, normalized, page_range, strip
from factloom.operators import checks as engine
from factloom.operators import compare, package, spec, styles
from factloom.operators import stats as stats_ops
from factloom.operators.stats import ParagraphFilter, observations, samples, top_values
from factloom.plans.registry import register
from factloom.plans.samples import broken_packages, conversations_as_packages, pages_as_packages
from factloom.sources import docx, facts, packages
from factloom.staging import new_path

#: The white-space class as RE2 takes it.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _norm(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '{WS}', '', 'g'))"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x) if isinstance(x, int) else f"{x!r}::double"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    """The rows as a DuckDB table expression."""
    return "(select * from (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") as t({columns}))"


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as paragraphs: one row a line, blank ones included."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("index", "text"))
    return docs.withColumn("ord", F.col("doc_id") * 1_000_000 + F.col("index"))


DOC_LINES = """
  select doc_id, lang, source, i - 1 as index, ls[i] as text, doc_id * 1000000 + i - 1 as ord
  from (select doc_id, lang, source, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)"""


def _ranked(inner: str, keys: str, top: int = 5) -> str:
    """The DuckDB form of ``top_values`` over (keys, value, ord)."""
    return f"""
select {keys}, value, cnt, rank from (
  select *, row_number() over (partition by {keys} order by cnt desc, first, value)::int as rank from (
    select {keys}, value, count(*) as cnt, min(ord) as first from ({inner}) group by {keys}, value))
where rank <= {top}"""


# ---- filters and distributions


@register(
    "stats_line_length_topk",
    _ranked(f"select lang, ((length(t) // 50) * 50)::varchar as value, ord from (select lang, ord, {_stripped('text')} as t from ({DOC_LINES})) where length(t) >= 20", "lang"),
)
def stats_line_length_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    kept = _doc_lines(spark, sf_dir).where(ParagraphFilter(min_length=20).condition(F.col("text"), none, none, none))
    return top_values(kept.withColumn("t", strip("text")).withColumn("value", F.expr("(length(t) div 50) * 50").cast("string")), ["lang"])


#: A block's tag and its content up to the next block: text and inline tags.
_BLOCK = r"<(p|h1|li|title|footer)>([^<]*(?:</?(?:a|b|i|em|strong|span|code|small|sub|sup|br)(?:\s[^>]*)?>[^<]*)*)"
_TAG = "<[^>]*>"


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as styled paragraphs: the tag of a block is its style, its text is without inline tags."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(2)).alias("text"))
    bold = F.contains("html", F.lit("<b>"))
    rows = _read(spark, sf_dir, "pages").select("page_id", bold.alias("bold"), F.posexplode(pairs).alias("index", "b"))
    return rows.select("page_id", "bold", "index", F.col("b.tag").alias("tag"), F.regexp_replace("b.text", _TAG, "").alias("text"), (F.col("page_id") * 1_000_000 + F.col("index")).alias("ord"))


PAGE_BLOCKS = f"""
  select page_id, bold, i - 1 as index, tags[i] as tag, regexp_replace(texts[i], '{_TAG}', '', 'g') as text, page_id * 1000000 + i - 1 as ord from (
    select page_id, contains(html, '<b>') as bold, regexp_extract_all(html, '{_BLOCK}', 1) as tags, regexp_extract_all(html, '{_BLOCK}', 2) as texts,
      unnest(range(1, len(regexp_extract_all(html, '{_BLOCK}', 1)) + 1)) as i from pages)"""


@register("stats_style_distribution", _ranked(f"select 'style' as metric, coalesce(nullif(tag, ''), '(none)') as value, ord from ({PAGE_BLOCKS}) where {_stripped('text')} != ''", "metric"))
def stats_style_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _page_blocks(spark, sf_dir).where(strip("text") != "")
    return top_values(kept.withColumns({"metric": F.lit("style"), "value": F.coalesce(F.nullif("tag", F.lit("")), F.lit("(none)"))}), ["metric"])


@register(
    "stats_exclude_and_prefix",
    f"""select source, count(*) as candidate_count from (select source, {_stripped('text')} as t from ({DOC_LINES}))
where t != '' and not contains(t, '|') and not contains(t, '###') and not regexp_matches(t, '^(?:[0-9]+|[A-Z]{{2}})')
  and not starts_with(t, 'The') and not starts_with(t, 'Les') group by source""",
)
def stats_exclude_and_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ParagraphFilter(exclude_texts=("|", "###"), heading_prefixes=("[0-9]+", "[A-Z]{2}"), heading_keywords=("The", "Les"))
    none = F.lit(None)
    return _doc_lines(spark, sf_dir).where(wanted.condition(F.col("text"), none, none, none)).groupBy("source").agg(F.count("*").alias("candidate_count"))


@register(
    "stats_instruction_hints",
    f"""select lang, count(*) as candidate_count from (select lang, {_stripped('text')} as t from ({DOC_LINES}))
where t != '' and not contains(t, '    ') and not (length(t) - length(replace(t, '：', '')) >= 2 and not contains(t, '。')) and not contains(t, 'license') and not contains(t, 'token') group by lang""",
)
def stats_instruction_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    wanted = ParagraphFilter(instruction_hints=("license", "token"))
    return _doc_lines(spark, sf_dir).where(wanted.condition(F.col("text"), none, none, none)).groupBy("lang").agg(F.count("*").alias("candidate_count"))


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as paragraphs: the flag is the style, quantities and rates are properties, the status is the document."""
    given = {
        "alignment": F.when(F.col("l_linestatus") == "F", "justify").otherwise("left"), "line_spacing_mode": F.when(F.col("l_returnflag") == "N", "exact").otherwise("multiple"),
        "line_spacing_value": F.col("l_tax") * 100, "space_before_pt": F.col("l_discount") * 100, "space_after_pt": F.col("l_tax") * 100, "first_line_indent_pt": F.col("l_discount") * 100 - 5,
        "font_family_east_asia": F.lit(None).cast("string"), "font_family_ascii": F.lit(None).cast("string"), "font_family": F.lit(None).cast("string"), "font_size_pt": F.col("l_quantity"),
        "bold": F.col("l_discount") > 0.05, "italic": F.lit(None).cast("boolean"), "underline": F.lit(None).cast("boolean"),
    }
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"),
        F.concat_ws(" ", "l_linestatus", F.col("l_partkey").cast("string")).alias("text"), F.col("l_returnflag").alias("style_name"), F.struct(*[c.alias(n) for n, c in given.items()]).alias("properties"),
    )


LINE_FACTS = """
  select l_linestatus as doc_id, l_orderkey || '-' || l_linenumber as id, l_orderkey * 10 + l_linenumber as index, l_linestatus || ' ' || l_partkey as text, l_returnflag as style_name,
    case when l_linestatus = 'F' then 'justify' else 'left' end as alignment, case when l_returnflag = 'N' then 'exact' else 'multiple' end as line_spacing_mode,
    l_tax * 100 as line_spacing_value, l_discount * 100 as space_before_pt, l_tax * 100 as space_after_pt, l_discount * 100 - 5 as first_line_indent_pt, l_quantity as font_size_pt,
    l_discount > 0.05::double as bold from lineitem"""


@register(
    "stats_body_shape",
    _ranked(
        f"""select doc_id, 'font_size' as metric, round_even(font_size_pt, 2)::varchar as value, index as ord from ({LINE_FACTS})
where (alignment = 'justify' or first_line_indent_pt > 0) and {_norm('style_name')} in ('a', 'n')""",
        "doc_id, metric",
    ),
)
def stats_body_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ParagraphFilter(style_hints=(" A", "n"), require_body_shape=True)
    p = F.col("properties")
    kept = _line_facts(spark, sf_dir).where(wanted.condition(F.col("text"), F.col("style_name"), p["alignment"], p["first_line_indent_pt"]))
    return top_values(observations(kept, ["doc_id"], "index", ("font_size",)), ["doc_id", "metric"])


@register(
    "stats_samples",
    f"""select role, conv_id, turn, sample, preview from (
  select role, conv_id, turn, row_number() over (partition by role order by conv_id, turn)::int as sample, substr(text, 1, 120) as preview
  from conversations where {_stripped('text')} != '') where sample <= 8""",
)
def stats_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").where(strip("text") != "")
    return samples(rows, ["role"], ["conv_id", "turn"]).select("role", "conv_id", "turn", "sample", "preview")


@register("query_text_contains", "select doc_id, source, n_chars from documents where contains(text, 'License')")
def query_text_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_text(_read(spark, sf_dir, "documents"), "License").select("doc_id", "source", "n_chars")


@register("query_style_contains", f"select p_partkey, p_type from part where contains({_norm('p_type')}, 'promo')")
def query_style_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_style(_read(spark, sf_dir, "part").withColumn("name", F.col("p_type")), "PRO mo").select("p_partkey", "p_type")


@register(
    "text_line_count",
    f"select doc_id, case when text = '' then 0 else len(p) - (case when p[-1] = '' then 1 else 0 end) end::int as line_count from (select doc_id, text, regexp_split_to_array(text, '{LINE_END}') as p from documents)",
)
def text_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", line_count("text").alias("line_count"))


@register("text_normalized", f"select c_custkey, {_norm('c_name')} as name, {_norm('c_mktsegment')} as segment from customer")
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", normalized("c_name").alias("name"), normalized("c_mktsegment").alias("segment"))


# ---- the check engine

_NUMERIC = [
    {"type": "font_size", "selector": "style:A", "expected": 25, "id": "size-a"},
    {"type": "spacing_before", "selector": "style:n", "expected": 5.0},
    {"type": "spacing_after", "selector": "style: R ", "expected": 4, "style_aliases": ["r", "A"]},
    {"type": "first_line_indent", "selector": "style:missing", "expected": 1.0},
    {"type": "font_size", "selector": "table:first", "expected": 12},
]


def _check_table(spark: SparkSession, checks: list[dict]) -> DataFrame:
    if errors := engine.validate(checks):
        raise ValueError("; ".join(errors))
    return spark.createDataFrame(engine.to_rows(checks), schema.CHECKS)


def _verdict_sql(checks: str, pairs: str, docs: str, group: str = "doc_id", note: str = "''") -> str:
    """The DuckDB form of the verdicts: checks with column idx, pairs with group, idx, ok; note: what follows the state."""
    return f"""
select d.{group}, c.idx, n as matched_count, f as failed,
  case when n is null then 'unresolved' when f > 0 then 'fail' else 'pass' end as status,
  case when f > 0 then f || '/' || n || ' mismatch' else n || ' ok' end || {note} as actual
from (select distinct {group} from {docs}) d cross join (select idx from {checks}) c
left join (select {group}, idx, count(*) as n, count(*) filter (not ok) as f from ({pairs}) group by all) using ({group}, idx)"""


_NUMERIC_PAIRS = f"""
  select doc_id, 0 as idx, abs(25::double - font_size_pt) <= 0.2::double as ok from ({LINE_FACTS}) where {_norm('style_name')} = 'a'
  union all select doc_id, 1, abs(5::double - space_before_pt) <= 0.5::double from ({LINE_FACTS}) where {_norm('style_name')} = 'n'
  union all select doc_id, 2, abs(4::double - space_after_pt) <= 0.5::double from ({LINE_FACTS}) where {_norm('style_name')} in ('r', 'a')"""
_NUMERIC_SQL = _verdict_sql("(select unnest(range(5))::int as idx)", _NUMERIC_PAIRS, f"({LINE_FACTS})")
_VERDICT = ["doc_id", "idx", "matched_count", "failed", "status", "actual"]


@register("check_numeric_tolerance", _NUMERIC_SQL)
def check_numeric_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.run_checks(_check_table(spark, _NUMERIC), _line_facts(spark, sf_dir))[0].select(*_VERDICT)


@register(
    "check_summary",
    f"""select doc_id, count(*) as total, count(*) filter (status = 'pass') as pass, count(*) filter (status = 'fail') as fail, count(*) filter (status = 'unresolved') as unresolved
from ({_NUMERIC_SQL}) group by doc_id""",
)
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.summary(engine.run_checks(_check_table(spark, _NUMERIC), _line_facts(spark, sf_dir))[0])


@register(
    "check_issues",
    f"""select doc_id, 0 as idx, null::varchar as location, index as paragraph_index, id as paragraph_id, style_name, substr(text, 1, 80) as text_preview, null::varchar as expected, font_size_pt::varchar as actual, 'font_size_pt mismatch' as message
from ({LINE_FACTS}) where {_norm('style_name')} = 'a' and not abs(25::double - font_size_pt) <= 0.2::double
union all select doc_id, idx, location, null, null, null, null, expected, null, 'no matching paragraphs' from (select distinct doc_id from ({LINE_FACTS})) cross join (values (1, 'style:missing', '1pt'), (2, 'table:first', null)) as c(idx, location, expected)
union all select doc_id, 3, null, index, id, style_name, substr(text, 1, 80), 'exact 4', line_spacing_mode || ':' || line_spacing_value::varchar, 'line_spacing mismatch'
from ({LINE_FACTS}) where {_norm('style_name')} = 'r'
union all select doc_id, 4, null, index, id, style_name, substr(text, 1, 80), null, null, 'italic missing' from ({LINE_FACTS}) where {_norm('style_name')} = 'n'""",
)
def check_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = [
        _NUMERIC[0],
        {"type": "first_line_indent", "selector": "style:missing", "expected": 1.0, "expected_display": "1pt"},
        {"type": "bold", "selector": "table:first", "expected": True},
        {"type": "line_spacing", "selector": "style:R", "expected": {"mode": "exact", "value": 4}, "expected_display": "exact 4"},
        {"type": "italic", "selector": "style:N", "expected": False},
    ]
    return engine.run_checks(_check_table(spark, batch), _line_facts(spark, sf_dir))[1]


def _customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as paragraphs: the segment is the style; debtors have no font."""
    base = _line_properties()
    given = base | {"font_family_east_asia": F.when(F.col("c_acctbal") >= 0, F.when(F.col("c_custkey") % 3 == 0, "Song Ti").otherwise("songti")), "alignment": F.when(F.col("c_acctbal") >= 5000, "Center").otherwise("left")}
    return _read(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % 5).alias("doc_id"), F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("index"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("style_name"),
        F.struct(*[c.alias(n) for n, c in given.items()]).alias("properties"),
    )


def _line_properties() -> dict:
    kinds = {"line_spacing_value": "double", "space_before_pt": "double", "space_after_pt": "double", "first_line_indent_pt": "double", "font_size_pt": "double", "bold": "boolean", "italic": "boolean", "underline": "boolean"}
    names = ("alignment", "line_spacing_mode", "line_spacing_value", "space_before_pt", "space_after_pt", "first_line_indent_pt", "font_family_east_asia", "font_family_ascii", "font_family", "font_size_pt", "bold", "italic", "underline")
    return {n: F.lit(None).cast(kinds.get(n, "string")) for n in names}


_STRING = [
    {"type": "font", "selector": "style:building", "expected": "SongTi"},
    {"type": "font", "selector": "style:building", "expected": "SongTi", "scope": "ascii"},
    {"type": "alignment", "selector": "style:x", "style_name": "MACHINERY", "expected": "center"},
]


@register(
    "check_string_prop",
    _verdict_sql(
        "(select unnest(range(3))::int as idx)",
        f"""select c_nationkey % 5 as doc_id, 0 as idx, true as ok from customer where {_norm('c_mktsegment')} = 'building' and c_acctbal >= 0
  union all select c_nationkey % 5, 2, c_acctbal >= 5000 from customer where {_norm('c_mktsegment')} in ('machinery', 'x')""",
        "(select c_nationkey % 5 as doc_id from customer)",
        note=f"""case when idx = 0 and n is not null then (select case when count(*) > 0 then ' (skipped ' || count(*) || ' without east_asia font)' else '' end
  from customer where c_nationkey % 5 = d.doc_id and {_norm('c_mktsegment')} = 'building' and not c_acctbal >= 0) else '' end""",
    ),
)
def check_string_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.run_checks(_check_table(spark, _STRING), _customer_facts(spark, sf_dir))[0].select(*_VERDICT)


@register(
    "check_bool_prop",
    _verdict_sql(
        "(select unnest(range(2))::int as idx)",
        f"""select doc_id, 0 as idx, bold as ok from ({LINE_FACTS}) where {_norm('style_name')} = 'n'
  union all select doc_id, 1, false from ({LINE_FACTS}) where {_norm('style_name')} = 'a'""",
        f"({LINE_FACTS})",
    ),
)
def check_bool_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [{"type": "bold", "selector": "style:N", "expected": True}, {"type": "italic", "selector": "style:A", "expected": False}]
    return engine.run_checks(_check_table(spark, checks), _line_facts(spark, sf_dir))[0].select(*_VERDICT)


@register(
    "check_pair_prop",
    _verdict_sql(
        "(select unnest(range(2))::int as idx)",
        f"""select doc_id, 0 as idx, line_spacing_mode = 'exact' and abs(4::double - line_spacing_value) <= 0.1::double as ok from ({LINE_FACTS}) where {_norm('style_name')} = 'n'
  union all select doc_id, 1, line_spacing_mode = 'Exact' and abs(4::double - line_spacing_value) <= 0.1::double from ({LINE_FACTS}) where {_norm('style_name')} = 'r'""",
        f"({LINE_FACTS})",
    ),
)
def check_pair_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [{"type": "line_spacing", "selector": "style:N", "expected": {"mode": "exact", "value": 4}}, {"type": "line_spacing", "selector": "style:R", "expected": {"mode": "Exact", "value": 4}}]
    return engine.run_checks(_check_table(spark, checks), _line_facts(spark, sf_dir))[0].select(*_VERDICT)


_CAPTIONS = [
    {"type": "font_size", "selector": "caption:figure", "expected": 10, "style_aliases": ["de"], "caption_prefix_patterns": ["The [a-z]+", "Les? "]},
    {"type": "font_size", "selector": "caption:table", "expected": 10, "caption_prefix_patterns": ["[0-9]+"]},
    {"type": "font_size", "selector": "caption:figure", "expected": 10, "style_aliases": ["de"], "caption_prefix_patterns": ["Released"]},
]


@register(
    "check_caption_regex",
    _verdict_sql(
        "(select unnest(range(3))::int as idx)",
        f"""with l as (select source as doc_id, lang, text from ({DOC_LINES}) where {_stripped('text')} != '')
  select doc_id, 0 as idx, false as ok from l where lang = 'de' or regexp_matches(text, '^(?:The [a-z]+)') or regexp_matches(text, '^(?:Les? )')
  union all select doc_id, 1, false from l where regexp_matches(text, '^(?:[0-9]+)')
  union all select doc_id, 2, false from l where lang = 'de' or regexp_matches(text, '^(?:Released)')""",
        "(select source as doc_id from documents)",
    ),
)
def check_caption_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("ord").cast("string").alias("id"), F.col("ord").alias("index"), "text", F.col("lang").alias("style_name"), F.struct(*[c.alias(n) for n, c in _line_properties().items()]).alias("properties"))
    return engine.run_checks(_check_table(spark, _CAPTIONS), rows)[0].select(*_VERDICT)


_LAYOUTS = [("a4", 21.0, 29.7, 2.54, 2.54, 3.0, 3.0), ("near", 21.08, 29.65, 2.5, 2.55, 3.04, None), ("wide", 29.7, 21.0, 2.0, 2.0, 2.0, 2.0), ("none", None, None, None, None, None, None)]
_PAGE_CHECKS = [
    {"type": "page_size", "selector": "document:layout", "expected": "A4"},
    {"type": "margin", "selector": "document:layout", "side": "left", "expected": 3.0},
    {"type": "margin", "selector": "document:layout", "side": "right", "expected": 3, "expected_display": "three"},
    {"type": "page_size", "selector": "document:layout", "expected": "A3"},
]


def _layout_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_LAYOUTS, "doc_id string, w double, h double, t double, b double, l double, r double")
    return rows.select("doc_id", F.expr("named_struct('page_size', named_struct('width_cm', w, 'height_cm', h), 'page_margins', named_struct('top_cm', t, 'bottom_cm', b, 'left_cm', l, 'right_cm', r))").alias("layout"))


_DOC_LEVEL_SQL = f"""with l as {_values(_LAYOUTS, 'doc_id, w, h, t, b, l, r')}, size as (select *, w::varchar || 'cm x ' || h::varchar || 'cm' as shown from l), c as (
  select doc_id, 0 as idx, coalesce(abs(21::double - w) <= 0.1::double and abs(29.7::double - h) <= 0.1::double, false) as ok, shown as actual, 'A4' as expected, 'page_size' as place, 'page_size mismatch' as message from size
  union all select doc_id, 1, coalesce(abs(3::double - l) <= 0.05::double, false), l::varchar || 'cm', '3.0cm', 'left', 'margin left mismatch' from l
  union all select doc_id, 2, coalesce(abs(3::double - r) <= 0.05::double, false), r::varchar || 'cm', 'three', 'right', 'margin right mismatch' from l
  union all select doc_id, 3, false, shown, 'A3', 'page_size', 'page_size mismatch' from size)"""


@register("check_doc_level", _DOC_LEVEL_SQL + " select doc_id, idx, null::bigint as matched_count, (case when ok then 0 else 1 end)::bigint as failed, case when ok then 'pass' else 'fail' end as status, actual from c")
def check_doc_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], schema.PARAGRAPHS)
    return engine.run_checks(_check_table(spark, _PAGE_CHECKS), empty, _layout_table(spark))[0].select(*_VERDICT)


@register("check_doc_level_issues", _DOC_LEVEL_SQL + " select doc_id, idx, 'document.layout:' || place as location, expected, actual, message from c where not ok")
def check_doc_level_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], schema.PARAGRAPHS)
    return engine.run_checks(_check_table(spark, _PAGE_CHECKS), empty, _layout_table(spark))[1].select("doc_id", "idx", "location", "expected", "actual", "message")


@register(
    "check_empty_documents",
    f"""select c_custkey as doc_id, idx, n as matched_count, f as failed, case when n is null then 'unresolved' when f > 0 then 'fail' else 'pass' end as status, case when f > 0 then f || '/' || n || ' mismatch' else n || ' ok' end as actual
from customer cross join (values (0), (1)) as c(idx) left join (
  select o_custkey as c_custkey, case when o_orderstatus = 'F' then 0 else 1 end as idx, count(*) as n, count(*) filter (not abs(o_totalprice - 100000) <= 0.2::double) as f
  from orders where o_orderstatus in ('F', 'O') group by all) using (c_custkey, idx)""",
)
def check_empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paragraphs of their customers, and customers as documents: those without orders are unresolved, not left out."""
    given = _line_properties() | {"font_size_pt": F.col("o_totalprice")}
    facts = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("text"), F.col("o_orderstatus").alias("style_name"),
        F.struct(*[c.alias(n) for n, c in given.items()]).alias("properties"),
    )
    batch = [{"type": "font_size", "selector": f"style:{x}", "expected": 100000} for x in "FO"]
    docs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return engine.run_checks(_check_table(spark, batch), facts, docs=docs)[0].select(*_VERDICT)


@register("check_types", f"select * from {_values([(t, list(need), prop, tol) for t, (need, prop, tol) in engine.TYPES.items()], 'type, required, property, tolerance')}")
def check_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.catalog(spark)


# ---- specifications

_SPEC = [
    ("a", ["# 论文格式", "正文使用小四号（12pt）宋体", "## 正文格式", "行距 20pt", "行距固定值 20 pt", "三号 15pt", "### 标题", "小四 14pt", "## 页眉 header", "小四号或四号", "字号 12pt 或 14PT"]),
    ("b", ["# 标题", "西文：宋体，中文：黑体", "中文字体：宋体 西文字体：Times New Roman", "宋体/黑体 与 楷体／仿宋", "# 页边距 margin", "英文：楷体", "plain", "", "###### six", "  # not a heading", "八号 5pt 五号"]),
    ("c", ["no headings at all", "行距：1.5倍"]),
    ("d", ["# 正文", "# 标题", "# 字体", "# 页眉", "# 页脚", "# 页边距", "小三号 15pt 小三", "三号 16pt", "## x", "三号 15.5pt"]),
]
_SPEC_ROWS = [(s, n, t) for s, ts in _SPEC for n, t in enumerate(ts, 1)]


_SPEC_TEXTS = [t for _, _, t in _SPEC_ROWS] + ["小四号 12pt 12pt", "小四 14pt", "三号 12pt", "小四 14pt 12pt"]


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specifications above, and one for each document: as many lines as it has, dealt from the same texts."""
    own = spark.createDataFrame(_SPEC_ROWS, schema.SPEC_LINES)
    dealt = F.element_at(F.array(*map(F.lit, _SPEC_TEXTS)), ((F.col("doc_id") * 7 + F.col("index") * 5) % len(_SPEC_TEXTS) + 1).cast("int"))
    more = _doc_lines(spark, sf_dir).select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("spec_id"), (F.col("index") + 1).alias("line_number"), dealt.alias("text"))
    return own.unionByName(more)


_SPEC_LINES_SQL = f"""(select spec_id, line_number::int as line_number, text from {_values(_SPEC_ROWS, 'spec_id, line_number, text')}
  union all select 'doc ' || doc_id, (index + 1)::int, ({_literal(_SPEC_TEXTS)})[((doc_id * 7 + index * 5) % {len(_SPEC_TEXTS)} + 1)::int] from ({DOC_LINES}))"""
_HEADING = f"^(#{{1,6}}){WS}+(.+?){WS}*$"
_SPEC_SQL = f"""
  select *, case when regexp_matches(text, '{_HEADING}') then length(regexp_extract(text, '{_HEADING}', 1)) end as level,
    case when regexp_matches(text, '{_HEADING}') then regexp_extract(text, '{_HEADING}', 2) end as heading
  from {_SPEC_LINES_SQL}"""
# the context of a line: headings before it that no later heading of a level as high or higher ends
_CONTEXT_SQL = f"""
  with l as ({_SPEC_SQL}),
  live as (select x.spec_id, x.line_number, h.level, h.heading from l x join l h on x.spec_id = h.spec_id and h.line_number <= x.line_number and h.level is not null
    where not exists (select 1 from l k where k.spec_id = x.spec_id and k.line_number > h.line_number and k.line_number <= x.line_number and k.level <= h.level))
  select l.*, coalesce(c.context, '') as context from l left join
    (select spec_id, line_number, string_agg(heading, ' / ' order by level) as context from live group by all) c using (spec_id, line_number)"""


@register("spec_context", f"select spec_id, line_number, level::int as level, heading, context from ({_CONTEXT_SQL})")
def spec_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec.with_context(_specs(spark, sf_dir)).select("spec_id", "line_number", "level", "heading", "context")


def _named_sql(text: str) -> str:
    """The names of ``named_sizes`` in DuckDB, as a list of points and one of names."""
    compact = f"regexp_replace({text}, '{WS}', '', 'g')"

    def hit(n: str) -> str:
        if n[0] == "小" or "小" + n[0] not in NAMED_SIZES:
            return f"contains({compact}, '{n}')"
        return f"contains(regexp_replace({compact}, '(?s)^(.*?)小{n[0]}号?', '\\1#'), '{n}')"

    names = ", ".join(f"case when {hit(n)} then '{n}' end" for n in SIZE_ORDER)
    return f"list_filter([{names}], lambda x: x is not null)"


_POINTS = "map {" + ", ".join(f"'{n}': {v}::double" for n, v in NAMED_SIZES.items()) + "}"
_EXPLICIT = f"list_transform(regexp_extract_all(text, '(?i)([0-9]+(?:\\.[0-9]+)?){WS}*pt', 1), lambda x: x::double)"
_SIGNALS_SQL = f"""
  select *, list_sort(list_distinct(list_transform(named, lambda n: ({_POINTS})[n]))) as name_pts, list_sort(list_distinct(explicit)) as pts
  from (select *, {_named_sql('text')} as named, {_EXPLICIT} as explicit from ({_CONTEXT_SQL}))"""
_CODES = """list_filter([case when len(name_pts) > 1 then 'several_named_sizes' end, case when len(pts) > 1 then 'several_explicit_sizes' end,
  case when len(name_pts) > 0 and len(pts) > 0 and abs(name_pts[1] - pts[1]) > 0.2::double then 'named_and_explicit_differ' end], lambda x: x is not null)"""


_RESOLVED = f"case when len({_CODES}) = 0 then coalesce(pts[1], name_pts[1]) end"


@register("font_size_signals", f"select spec_id, line_number, array_to_string(named, ',') as named, coalesce(pts, []) as explicit, {_CODES} as conflicts, {_RESOLVED} as resolved from ({_SIGNALS_SQL})")
def font_size_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = size_signals("text")
    return _specs(spark, sf_dir).select("spec_id", "line_number", F.array_join(F.transform(s["named"], lambda x: x["name"]), ",").alias("named"), s["explicit"].alias("explicit"), s["conflicts"].alias("conflicts"), s["resolved"].alias("resolved"))


_STRIPPED = _stripped("text")
_CONFLICTS_SQL = f"""
with s as ({_SIGNALS_SQL}),
one as (select spec_id, line_number, context, {_STRIPPED} as text, named[1] as name, pts[1] as pt from s where level is null and len(named) = 1 and len(pts) = 1),
many as (select spec_id, name, list_sort(list_distinct(list(pt))) as pts, min(line_number) as line_number,
  string_agg(line_number || ' ' || context || ' ' || text || ' ' || pt, '; ' order by line_number) as examples from one group by all having len(list_distinct(list(pt))) > 1)
select spec_id, 1 as pass_no, line_number, context, {_STRIPPED} as text, 'font_size_conflict' as type, {_CODES} as reasons, null::varchar as examples from s where level is null and len({_CODES}) > 0
union all select m.spec_id, 2, m.line_number, o.context, m.name, 'font_size_inconsistent_across_spec', list_concat([m.name], list_transform(m.pts, lambda x: x::varchar)), m.examples
  from many m join one o on m.spec_id = o.spec_id and m.name = o.name and m.line_number = o.line_number
union all select spec_id, 3, line_number, context, {_STRIPPED}, 'line_spacing_mode_missing', ['no_mode'], null from s
  where regexp_matches(text, '(?i)行距[^|]*?([0-9]+\\.?[0-9]*){WS}*pt') and not regexp_matches(lower(text), '{"|".join(spec.SPACING_MODES)}')"""


@register("spec_conflicts", _CONFLICTS_SQL)
def spec_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform("examples", lambda x: F.concat_ws(" ", x["line_number"].cast("string"), x["context"], x["text"], x["pt"].cast("string"))), "; ")
    return spec.conflicts(_specs(spark, sf_dir)).withColumn("examples", told)


@register("spec_status", f"select spec_id, count(type) as conflict_count, coalesce(list_sort(list(distinct type) filter (type is not null)), []) as conflict_types, case when count(type) = 0 then 'pass' else 'needs_revision' end as status from (select distinct spec_id from ({_SPEC_SQL})) left join ({_CONFLICTS_SQL}) using (spec_id) group by spec_id")
def spec_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec.status(spec.conflicts(_specs(spark, sf_dir)), _specs(spark, sf_dir))


@register(
    "spec_structure",
    f"""with h as (select * from ({_SPEC_SQL}) where level is not null), r as {_values([(s, w) for s, ws in spec.SECTIONS.items() for w in ws], 'section, word')},
hit as (select distinct h.spec_id, r.section, h.line_number from h join r on contains(h.heading, r.word))
select d.spec_id, x.section, count(hit.line_number) as matched, min(hit.line_number) as first_line, case when count(hit.line_number) > 0 then 'covered' else 'missing' end as status
from (select distinct spec_id from ({_SPEC_SQL})) d cross join (select distinct section from r) x left join hit on hit.spec_id = d.spec_id and hit.section = x.section group by all""",
)
def spec_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec.structure(spark, _specs(spark, sf_dir))


_CH = "|".join(CHINESE_FONTS)
_ALL = "|".join([*sorted(CHINESE_FONTS, key=len, reverse=True), *WESTERN_FONTS])
_E, _W = "(?:中文字体|中文|east_asia|eastasia)", "(?:西文字体|西文|ascii|英文)"
_SEP, _GAP = f"[：:]{WS}*", f"{WS}*[，,]?{WS}*"
_WORDINGS = {
    "pair": (f"({_CH}){WS}*[/／]{WS}*({_CH})", 1, 2),
    "named": (f"(?i){_E}{_SEP}({_ALL}){_GAP}{_W}{_SEP}({_ALL})", 1, 2),
    "reversed": (f"(?i){_W}{_SEP}({_ALL}){_GAP}{_E}{_SEP}({_ALL})", 2, 1),
    "western": (f"(?i){_W}{_SEP}({_CH})", 0, 1),
}
_SENSE_SQL = " union all ".join(
    f"""select spec_id, line_number, context, {_STRIPPED} as text, 'font_common_sense_conflict' as type, '{n}' as pattern, {f"e[i]" if e else "null::varchar"} as east_asia_font, w[i] as ascii_font from (
  select *, regexp_extract_all(text, '{x}', {e or w}) as e, regexp_extract_all(text, '{x}', {w}) as w, unnest(range(1, len(regexp_extract_all(text, '{x}', {w})) + 1)) as i from ({_CONTEXT_SQL}) where level is null)
  where w[i] in ({', '.join(repr(f) for f in CHINESE_FONTS)})"""
    for n, (x, e, w) in _WORDINGS.items()
)


@register("spec_common_sense", _SENSE_SQL)
def spec_common_sense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec.common_sense(_specs(spark, sf_dir))


_BODY_CHECKS = [
    {"type": "font_size", "selector": "style:x", "expected": 25.1, "section": "正文 body", "rule_text": "size"},
    {"type": "first_line_indent", "selector": "style:x", "expected": 0.5, "section": "body", "rule_text": "indent"},
    {"type": "line_spacing", "selector": "style:x", "expected": {"mode": "multiple", "value": 3}, "section": "body", "rule_text": "spacing"},
    {"type": "font", "selector": "style:x", "expected": "SimSun", "section": "body", "rule_text": "font"},
    {"type": "font_size", "selector": "style:x", "expected": 1, "section": "title", "rule_text": "other section"},
    {"type": "bold", "selector": "style:x", "expected": True, "section": "body", "rule_text": "not compared"},
]
_OBSERVED = f"""
  select doc_id, 'font_size' as metric, round_even(font_size_pt, 2)::varchar as value, index as ord from ({LINE_FACTS})
  union all select doc_id, 'first_line_indent', round_even(first_line_indent_pt, 2)::varchar, index from ({LINE_FACTS})
  union all select doc_id, 'line_spacing', line_spacing_mode || ':' || line_spacing_value::varchar, index from ({LINE_FACTS})"""


@register(
    "body_consistency",
    f"""with top as (select * from ({_ranked(_OBSERVED, 'doc_id, metric', 1)})), d as (select distinct doc_id from top),
r as (select d.doc_id, c.*, t.value from d cross join {_values([(0, 'font_size', 'size', '25.1', 25.1, 0.2), (1, 'first_line_indent', 'indent', '0.5', 0.5, 1.0), (2, 'line_spacing', 'spacing', 'multiple:3.0', 3.0, 0.0)], 'idx, type, rule_text, expected, num, tol')} c
  left join top t on t.doc_id = d.doc_id and t.metric = c.type)
select doc_id, idx, type, rule_text, expected, value as actual,
  case when (case when type = 'line_spacing' then string_split(value, ':')[1] = 'multiple' and string_split(value, ':')[2]::double = num else abs(num - try_cast(value as double)) <= tol end) then 'supported' else 'mismatch' end as verdict
from r""",
)
def body_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = top_values(observations(_line_facts(spark, sf_dir), ["doc_id"], "index"), ["doc_id", "metric"])
    return spec.body_consistency(_check_table(spark, _BODY_CHECKS), evidence, ("正文", "body"))


# ---- comparison, styles, runs

_LEFT = [("width", "21.0"), ("height", "29.7"), ("gutter", None), ("only_left", "1")]
_RIGHT = [("width", "21.0"), ("height", "27.9"), ("gutter", None), ("only_right", "2"), ("sections", "3")]


@register("compare_layout", f"select key, a.value as reference, b.value as target from {_values(_LEFT, 'key, value')} a full join {_values(_RIGHT, 'key, value')} b using (key) where a.value is distinct from b.value")
def compare_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda rows: spark.createDataFrame(rows, "key string, value string")
    return compare.compare_keyed(make(_LEFT), make(_RIGHT), ["key"], "value")


@register(
    "compare_sources",
    """with n as (select source, lang, count(*)::varchar as value from documents group by all)
select lang, a.value as reference, b.value as target from (select * from n where source = 'src1') a full join (select * from n where source = 'src2') b using (lang) where a.value is distinct from b.value""",
)
def compare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").cast("string").alias("value"))
    return compare.compare_keyed(counts.where("source = 'src1'"), counts.where("source = 'src2'"), ["lang"], "value")


@register(
    "style_inheritance",
    """with s as (select *, o_orderkey // 100 as chain, case when o_orderkey % 7 = 0 then o_totalprice end as size, case when o_orderkey % 11 = 0 then o_orderpriority end as font,
    case when o_orderkey % 13 = 0 then o_orderstatus = 'F' end as bold, case when o_orderkey % 17 = 0 then o_orderstatus end as align from orders)
select o_orderkey // 10000 as doc_id, o_orderkey as style_id, last_value(size ignore nulls) over near as font_size_pt, first_value(font ignore nulls) over near as font_family,
  first_value(bold ignore nulls) over near as bold, last_value(align ignore nulls) over near as alignment
from s window near as (partition by chain order by o_orderkey rows between unbounded preceding and current row)""",
)
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as styles in chains of 100: each is based on the one before it, the first of a chain on none."""
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 10000").alias("doc_id"), k.alias("style_id"), F.when(k % 100 != 0, k - 1).alias("base_style_id"), F.when(k % 7 == 0, F.col("o_totalprice")).alias("font_size_pt"),
        F.when(k % 11 == 0, F.col("o_orderpriority")).alias("font_family"), F.when(k % 13 == 0, F.col("o_orderstatus") == "F").alias("bold"), F.when(k % 17 == 0, F.col("o_orderstatus")).alias("alignment"),
    )
    return styles.resolve_styles(spark, rows, ["font_size_pt", "font_family", "bold", "alignment"])


@register(
    "style_chains",
    """select p.p_partkey // 200 as doc_id, p.p_partkey as style_id, p.p_partkey - a.p_partkey as depth, a.p_partkey as ancestor
from part p join part a on a.p_partkey <= p.p_partkey and a.p_partkey // 40 = p.p_partkey // 40""",
)
def style_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as styles in chains of 40; the first of a chain names a base that is not there."""
    k = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").select(F.expr("p_partkey div 200").alias("doc_id"), k.alias("style_id"), F.when(k % 40 != 0, k - 1).otherwise(-1 - k).alias("base_style_id"))
    return styles.style_chains(spark, rows)


@register(
    "paragraph_formats",
    """with r as (select l_orderkey % 500 as doc_id, l_suppkey as para_index, ((((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + l_quantity::bigint) * 10 + ascii(l_returnflag) % 3 + 3 * (ascii(l_linestatus) % 2)) as pos, case when l_returnflag = 'R' then l_linestatus end as east_asia,
    case when l_linenumber % 3 = 0 then l_returnflag end as ascii, case when l_linenumber % 2 = 0 then l_quantity end as size_pt, l_linestatus != 'F' or l_linenumber % 4 != 0 as said,
    case when l_linenumber != 2 then l_discount > 0.05::double end as bold, l_tax > 0.04::double as italic from lineitem)
select doc_id, para_index, arg_min(east_asia, pos) filter (east_asia is not null) as font_family_east_asia, arg_min(ascii, pos) filter (ascii is not null) as font_family_ascii,
  arg_min(size_pt, pos) filter (size_pt is not null) as font_size_pt, case when count(bold) filter (said) > 0 then 2 * count(*) filter (said and bold) > count(bold) filter (said) end as bold,
  case when count(italic) filter (said) > 0 then 2 * count(*) filter (said and italic) > count(italic) filter (said) end as italic, null::boolean as underline from r group by all""",
)
def paragraph_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs: a paragraph for each supplier in each of 500 documents."""
    n = F.col("l_linenumber")
    place = (((F.col("l_orderkey") * 8 + n) * 100_000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("bigint")) * 10 + F.ascii("l_returnflag") % 3 + 3 * (F.ascii("l_linestatus") % 2)
    rows = _read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_suppkey").alias("para_index"), place.alias("pos"),
        F.when((F.col("l_linestatus") == "F") & (n % 4 == 0), "  ").otherwise("x").alias("text"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("east_asia"),
        F.when(n % 3 == 0, F.col("l_returnflag")).alias("ascii"), F.when(n % 2 == 0, F.col("l_quantity")).alias("size_pt"), F.when(n != 2, F.col("l_discount") > 0.05).alias("bold"),
        (F.col("l_tax") > 0.04).alias("italic"), F.lit(None).cast("boolean").alias("underline"),
    )
    return styles.paragraph_formats(rows)


@register(
    "majority_vote",
    "select doc_id % 20 as unit, case when count(v) > 0 then sum(v::int) * 2 > count(v) end as bold from (select doc_id, case when doc_id % 7 != 0 then quality = 1 and doc_id % 3 != 0 end as v from labels) group by all",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("unit"), F.when(F.col("doc_id") % 7 != 0, (F.col("quality") == 1) & (F.col("doc_id") % 3 != 0)).alias("v"))
    return rows.groupBy("unit").agg(styles.majority(F.col("v")).alias("bold"))


@register(
    "first_run_value",
    "select user_id, arg_min(v, event_id) filter (v is not null) as first_value from (select user_id, event_id, case when event_type in ('view', 'click') then event_type end as v from events) group by user_id",
)
def first_run_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    return rows.groupBy("user_id").agg(styles.first_value(F.col("v"), F.col("event_id")).alias("first_value"))


@register(
    "merge_runs",
    """with r as (select *, case when fmt is not distinct from lag(fmt) over w and row_number() over w > 1 then 0 else 1 end as new from (select conv_id, turn, text, case when turn % 3 = 0 then null else role end as fmt from conversations) window w as (partition by conv_id order by turn)),
g as (select *, sum(new) over (partition by conv_id order by turn) as run from r)
select conv_id, run::bigint as run, any_value(fmt) as fmt, string_agg(text, '' order by turn) as text, count(*) as n from g group by conv_id, run""",
)
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("fmt"))
    return styles.merge_runs(rows, ["conv_id"], ["turn"])


# ---- packages


@register(
    "duplicate_ids",
    "select doc_id, source, first_doc_id from (select doc_id, source, min(doc_id) over (partition by source, text) as first_doc_id from documents) where doc_id != first_doc_id",
)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("id"))
    return package.duplicates(rows, ["source", "id"], ["doc_id"], spark).select("doc_id", "source", "first_doc_id")


@register(
    "rel_anti_join",
    """with r as (select l_orderkey % 100 as doc_id, l_orderkey as id, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos from lineitem where l_returnflag = 'R'),
v as (select doc_id, list_sort(list(distinct id::varchar))[1:5] as valid from r group by doc_id)
select 'd' || o.o_orderkey % 100 as doc_id, 'word/document.xml' as part, 'ref r:id ' || o_orderkey || ' valid: ' || array_to_string(v.valid, ',') as detail from orders o join v on v.doc_id = o_orderkey % 100
  where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
union all select 'd' || doc_id, 'word/_rels/document.xml.rels', 'repeated ' || id from (select *, row_number() over (partition by id order by pos) as n from r) where n > 1""",
)
def rel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as references and returned line items as relationships of 100 documents: references that lead nowhere, and repeated ids."""
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    uses = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("n"), F.lit("word/document.xml").alias("part"), F.col("o_orderkey").alias("pos"), F.lit("ref").alias("tag"), F.create_map(F.lit("r:id"), text("o_orderkey")).alias("attrs"))
    given = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 100).alias("n"), F.lit("word/_rels/document.xml.rels").alias("part"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.lit("Relationship").alias("tag"), F.create_map(F.lit("Id"), text("l_orderkey"), F.lit("Target"), F.lit("x")).alias("attrs"))
    rows = uses.unionByName(given).select(F.concat(F.lit("d"), text("n")).alias("doc_id"), "part", F.col("pos").alias("elem_id"), F.lit(0).cast("bigint").alias("parent_id"), "tag", F.lit("").alias("ns"), F.array().cast("array<string>").alias("ancestors"), "attrs", none.alias("text"), "pos")
    return package.relationship_ids(rows).select("doc_id", "part", "detail")


_MARKS = [("document", "commentRangeStart", "1"), ("document", "commentRangeEnd", "1"), ("document", "commentRangeStart", "2"), ("document", "commentRangeEnd", "x"), ("document", "commentReference", "10"), ("document", "commentReference", "1"), ("comments", "comment", "1"), ("comments", "comment", "2")]


def _elements(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (part, tag, ns, ancestors, attrs, text, parent) in order."""
    made = [("d", p, n, None if top else 0, t, ns, a, at, x, n) for n, (p, t, ns, a, at, x, top) in enumerate(rows)]
    return spark.createDataFrame(made, schema.ELEMENTS)


@register(
    "comment_markers",
    f"""with m as {_values(_MARKS, 'file, tag, id')}, s as (select id, count(*) filter (tag = 'commentRangeStart') as a, count(*) filter (tag = 'commentRangeEnd') as e, count(*) filter (tag = 'comment') as c from m group by id)
select 'd' as doc_id, 'comment_markers' as rule, 'word/document.xml' as part, coalesce(try_cast(id as bigint), 0) as pos, what || ' ' || id as detail from (
  select id, 'end without start' as what from s where e > 0 and a = 0 union all select id, 'start without end' from s where a > 0 and e = 0 union all select id, 'no such comment' from s where c = 0)""",
)
def comment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.comment_markers(_elements(spark, [(f"word/{f}.xml", t, "w", [], {"w:id": i}, None, False) for f, t, i in _MARKS]))


_NOW = [("a.xml", "e1"), ("a.xml", "e2"), ("a.xml", "e2"), ("a.xml", "e9"), ("a.xml", "e8"), ("b.xml", "e1"), ("c.xml", "x" * 300)]
_BEFORE = [("a.xml", "e1"), ("b.xml", "e1"), ("b.xml", "e5")]


@register(
    "xsd_baseline_diff",
    f"""with f as (select distinct part, error from {_values(_NOW, 'part, error')} except select part, error from {_values(_BEFORE, 'part, error')})
select part, count(*) as total, list_transform(list_sort(list(error))[1:3], lambda x: substr(x, 1, 250)) as first from f group by part""",
)
def xsd_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda rows: spark.createDataFrame(rows, "part string, error string")
    return package.new_errors(make(_NOW), make(_BEFORE), ["part"])


_RANGES = [(1, "1-5,8", 10), (2, "3-1", 10), (3, "2,2,1", 3), (4, "0-2", 5), (5, "9-20", 10), (6, "12", 10), (7, " 4 , 6-7 ", 8), (8, "x,2", 4)]


@register(
    "page_range",
    f"""with r as {_values(_RANGES, 'id, spec, total')}, p as (select id, total, trim(unnest(string_split(spec, ','))) as p from r),
b as (select id, total, try_cast(trim(string_split(p, '-')[1]) as int) as a, try_cast(trim(string_split(p, '-')[-1]) as int) as z from p),
n as (select id, unnest(range(greatest(1, a), least(total, z) + 1)) as page from b where a is not null and z is not null)
select r.id, coalesce(list_sort(list_distinct(list(n.page - 1) filter (n.page is not null))), [])::int[] as pages from r left join n using (id) group by r.id""",
)
def page_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_RANGES, "id int, spec string, total int").select("id", page_range(F.col("spec"), F.col("total")).alias("pages"))


_IDS = [("7FFFFFFF", 16), ("80000000", 16), ("0", 16), ("zz", 16), ("2147483646", 10), ("2147483648", 10), ("1A", 10), ("FFFFFFFFF", 16), ("00000000000000000000007F", 16), ("123456789ABCDEF01", 16), ("0000000000000000000000000012", 10), ("", 16)]


@register(
    "bounded_ids",
    f"select value, base, case when base = 10 then case when regexp_matches(value, '^[0-9]+$') then value::hugeint < 2147483648 end when regexp_matches(value, '^[0-9A-Fa-f]+$') then length(ltrim(value, '0')) <= 15 and coalesce(('0x' || nullif(ltrim(value, '0'), ''))::hugeint, 0) < 2147483648 end as ok from {_values(_IDS, 'value, base')}",
)
def bounded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.createDataFrame(_IDS, "value string, base int").select("value", "base", F.when(F.col("base") == 10, bounded_id(v, 10, 0x80000000)).otherwise(bounded_id(v, 16, 0x80000000)).alias("ok"))


@register(
    "id_constraints",
    """with i as (select *, p_partkey * 7919000017 % 4294967296 as para, p_partkey * 6700417001 % 4294967296 as durable, case when p_size % 2 = 0 then 'word/numbering.xml' else 'word/document.xml' end as part from part)
select part, p_partkey as pos, 'paraId ' || format('{:X}', para) as detail from i where para >= 2147483648
union all select part, p_partkey, 'durableId ' || case when p_size % 2 = 0 then durable::varchar else format('{:X}', durable) end from i where durable >= 2147483647""",
)
def id_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as elements with identifiers, in hexadecimal or, in numbering.xml, in decimal."""
    k, even = F.col("p_partkey"), F.col("p_size") % 2 == 0
    para, durable = k * 7_919_000_017 % 4_294_967_296, k * 6_700_417_001 % 4_294_967_296
    shown = F.when(even, durable.cast("string")).otherwise(F.hex(durable))
    rows = _read(spark, sf_dir, "part").select(
        F.lit("d").alias("doc_id"), F.when(even, "word/numbering.xml").otherwise("word/document.xml").alias("part"), k.alias("pos"),
        F.create_map(F.lit("w14:paraId"), F.hex(para), F.lit("w16cid:durableId"), shown).alias("attrs"),
    )
    return package.id_constraints(rows).select("part", "pos", "detail")


_FIELDS = [(1, "t", None, "a"), (2, "fldChar", "begin", None), (3, "t", None, "PAGE"), (4, "fldChar", "begin", None), (5, "t", None, "in"), (6, "fldChar", "end", None), (7, "t", None, "still"), (8, "fldChar", "end", None), (9, "t", None, "b")]


@register(
    "field_depth",
    f"""select string_agg(text, '' order by pos) as text from (select *, sum(case kind when 'begin' then 1 when 'end' then -1 else 0 end) over (order by pos) as depth from {_values(_FIELDS, 'pos, tag, kind, text')}) where tag = 't' and depth = 0""",
)
def field_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("word/header1.xml", "p", "w", [], {}, None, True)] + [("word/header1.xml", t, "w", ["p", "r"], {"w:fldCharType": k} if k else {}, x, False) for _, t, k, x in _FIELDS]
    return docx.field_free_text(_elements(spark, rows)).select("text")


@register("headings", f"select spec_id, line_number, level::int as level, heading from ({_SPEC_SQL}) where level is not null")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _specs(spark, sf_dir)
    return rows.select("spec_id", "line_number", heading_level("text").alias("level"), heading_text("text").alias("heading")).where("level is not null")


@register("text_lines", "select doc_id, i as line_number, length(ls[i]) as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, case when p[-1] = '' then p[1:-2] else p end as ls from (select doc_id, regexp_split_to_array(text, '" + LINE_END + "') as p from documents)))")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines("text")).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_number"), F.length("line").cast("bigint").alias("n"))


_UNESCAPED = "replace(replace(replace(replace(text, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@register(
    "docx_roundtrip",
    f"""with b as (select page_id, tag, {_UNESCAPED} as text, row_number() over (partition by page_id order by index) - 1 as n from ({PAGE_BLOCKS}) where tag in ('h1', 'p'))
select page_id::varchar as doc_id, 'p-' || (n + 1) as id, n::int as index, {_stripped('text')} as text, case tag when 'h1' then 'heading 1' else 'Normal' end as style_name,
  case tag when 'h1' then 'center' else 'justify' end as alignment, case tag when 'h1' then 16.0 else 12.0 end::double as font_size_pt, case tag when 'h1' then true end as bold,
  'multiple' as line_spacing_mode, 1.5::double as line_spacing_value, 'SimSun' as font_family from b""",
)
def docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word packages made of the pages' headings and paragraphs, read back as paragraphs with resolved formats."""
    p = docx.paragraphs(spark, _page_elements(spark, sf_dir))
    wanted = ("alignment", "font_size_pt", "bold", "line_spacing_mode", "line_spacing_value", "font_family")
    return p.select("doc_id", "id", "index", "text", "style_name", *[F.col(f"properties.{n}").alias(n) for n in wanted])


def _page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.elements(packages.unpack(pages_as_packages(_read(spark, sf_dir, "pages"))))


@register(
    "docx_layouts",
    """select page_id::varchar as doc_id, 21.0::double as width_cm, 29.7::double as height_cm, 2.54::double as top_cm, 2.54::double as bottom_cm, 3.0::double as left_cm, 3.0::double as right_cm,
  1.5::double as header_distance_cm, 1.75::double as footer_distance_cm, 1 as section_count, 0 as others from pages""",
)
def docx_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("layout")
    return docx.layouts(_page_elements(spark, sf_dir)).select(
        "doc_id", *[at["page_size"][n].alias(n) for n in ("width_cm", "height_cm")], *[at["page_margins"][f"{n}_cm"].alias(f"{n}_cm") for n in ("top", "bottom", "left", "right")],
        at["header_distance_cm"].alias("header_distance_cm"), at["footer_distance_cm"].alias("footer_distance_cm"), at["section_count"].alias("section_count"), F.size(at["other_sections"]).alias("others"),
    )


@register(
    "docx_styles",
    """select page_id::varchar as doc_id, s.* from pages cross join (values
  ('H1', 'heading 1', 'paragraph', 'Normal', 'center', 16.0::double, 'multiple', 1.5::double, 'SimSun', 'SimSun', 'Times New Roman'),
  ('Normal', 'Normal', 'paragraph', null, 'justify', 12.0::double, 'multiple', 1.5::double, 'SimSun', 'SimSun', 'Times New Roman'))
as s(style_id, name, style_type, base_style, alignment, font_size_pt, line_spacing_mode, line_spacing_value, font_family, font_family_east_asia, font_family_ascii)""",
)
def docx_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("alignment", "font_size_pt", "line_spacing_mode", "line_spacing_value", "font_family", "font_family_east_asia", "font_family_ascii")
    return docx.resolved_styles(spark, _page_elements(spark, sf_dir)).select("doc_id", "style_id", "name", "style_type", "base_style", *[F.col(f"properties.{n}").alias(n) for n in wanted])


def _conversation_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return conversations_as_packages(rows)


#: What XML and the readers leave of a text: no control characters, line ends as blanks, no white space at its ends.
_SAID = _stripped("regexp_replace(coalesce(text, ''), '[^\\x{20}-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]', ' ', 'g')")


@register(
    "docx_tables",
    f"""select conv_id::varchar as doc_id, 0 as index, count(*)::int as rows, 2 as columns, string_agg(role || '|' || {_SAID}, '/' order by turn) as data from conversations group by conv_id""",
)
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a table of turns, read back."""
    rows = docx.tables(packages.elements(packages.unpack(_conversation_packages(spark, sf_dir))))
    line = F.transform("data", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "|"))
    return rows.select("doc_id", "index", "rows", "columns", F.array_join(line, "/").alias("data"))


@register(
    "docx_headers_footers",
    """with c as (select conv_id, count(*) as n from conversations group by conv_id), s as (select conv_id::varchar as doc_id, n, k as section_index, kind from c cross join (values ('header'), ('footer')) as t(kind) cross join (values (0), (1)) as x(k))
select doc_id, kind as type, section_index, case when kind = 'header' and section_index = 0 then 'Conversation ' || doc_id || ' page | ' || n || ' turns' else '' end as text,
  case when kind = 'header' and section_index = 0 then 2 else 0 end as paragraphs, section_index > 0 as linked_to_previous from s""",
)
def docx_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents' headers: field codes are left out, a section without a header is linked to the one before."""
    rows = docx.headers_footers(packages.elements(packages.unpack(_conversation_packages(spark, sf_dir))))
    return rows.select("doc_id", "type", "section_index", "text", F.size("paragraphs").alias("paragraphs"), "linked_to_previous")


@register(
    "docx_metadata",
    f"""select conv_id::varchar as doc_id, conv_id::varchar as filename, 'docx' as format, 'Conversation ' || conv_id as title, 2::bigint as paragraph_count, 1::bigint as non_empty_paragraph_count, 1::bigint as table_count
from conversations group by conv_id""",
)
def docx_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _conversation_packages(spark, sf_dir)
    return docx.metadata(spark, files, packages.elements(packages.unpack(files)))


@register(
    "package_listing",
    """select conv_id::varchar as doc_id, part, part like '%.rels' as is_rels from (select distinct conv_id from conversations) cross join (values ('[Content_Types].xml'), ('_rels/.rels'),
  ('docProps/core.xml'), ('word/_rels/document.xml.rels'), ('word/document.xml'), ('word/header1.xml'), ('word/styles.xml')) as p(part)""",
)
def package_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.listing(packages.unpack(_conversation_packages(spark, sf_dir))).select("doc_id", "part", "is_rels")


# ---- facts records


def _facts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts records, one a nation, through JSON files: as a caller's files are read."""
    shown = F.struct(
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("c-"), F.col("c_custkey").cast("string"))).alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("text"), F.col("c_mktsegment").alias("style_name"),
        F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("font_size_pt"), (F.col("c_custkey") % 2 == 0).alias("bold")).alias("properties"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", shown.alias("p")))), lambda x: x["p"])
    kinds = F.array(F.struct(F.lit("n1").alias("name"), F.lit("s1").alias("style_id"), F.lit("paragraph").alias("type")), F.struct(F.lit("n2").alias("name"), F.lit("s2").alias("style_id"), F.lit(None).cast("string").alias("type")))
    records = _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(listed.alias("paragraphs")).withColumns({"format": F.lit("docx"), "styles": kinds})
    path = new_path(spark, "facts")
    records.withColumn("nation", F.col("c_nationkey")).drop("c_nationkey").write.partitionBy("nation").json(path)
    # a file holds one record
    return facts.load_facts(spark, path).withColumn("nation", F.regexp_extract("doc_id", "nation=([0-9]+)", 1).cast("int"))


@register(
    "facts_paragraphs",
    """with c as (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos from customer)
select c_nationkey as nation, case when c_custkey % 3 != 0 then 'c-' || c_custkey else 'p-' || pos end as id, pos::int as index, case when c_custkey % 5 != 0 then c_name else '' end as text, c_mktsegment as style_name,
  case when c_acctbal > 0 then c_acctbal end as font_size_pt, c_custkey % 2 = 0 as bold, null::varchar as alignment from c""",
)
def facts_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _facts_files(spark, sf_dir)
    rows = facts.paragraphs_of(found.withColumn("doc_id", F.col("nation").cast("string")))
    return rows.select(F.col("doc_id").cast("int").alias("nation"), "id", "index", "text", "style_name", "properties.font_size_pt", "properties.bold", "properties.alignment")


@register("facts_styles", "select nation, s.* from (select distinct c_nationkey as nation from customer) cross join (values ('s1', 'n1', 'paragraph'), ('s2', 'n2', null)) as s(style_id, name, style_type)")
def facts_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.styles_of(_facts_files(spark, sf_dir).withColumn("doc_id", F.col("nation").cast("string")))
    return rows.select(F.col("doc_id").cast("int").alias("nation"), "style_id", "name", "style_type")


_PAGES_OF = "select conv_id::varchar as doc_id, (turn + 1)::int as page_number, text, case when turn % 2 = 1 then 1 else 0 end as tables from conversations"


def _pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the pages that a PDF reader gives; every second one has a table."""
    table = F.array(F.array(F.array("role", "text")))
    rows = _read(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), "text",
        F.when(F.col("turn") % 2 == 1, table).otherwise(F.array().cast("array<array<array<string>>>")).alias("tables"),
    )


@register(
    "pdf_text",
    f"with p as ({_PAGES_OF}) select doc_id, max(page_number) as page_count, string_agg(text, chr(10) || chr(10) order by page_number) filter (page_number in (2, 3)) as full_text from p group by doc_id having max(page_number) >= 2",
)
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.pdf_extract(_pdf_pages(spark, sf_dir), "2-3").select("doc_id", "page_count", "full_text")


@register("pdf_tables", f"with p as ({_PAGES_OF}) select doc_id, list(page_number order by page_number) as pages, sum(tables)::bigint as table_count from p where tables > 0 group by doc_id")
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.pdf_extract(_pdf_pages(spark, sf_dir), include_tables=True).select("doc_id", F.transform("pages", lambda p: p["page_number"]).alias("pages"), "table_count")


@register(
    "pdf_all",
    f"with p as ({_PAGES_OF}) select doc_id, count(*) as pages, string_agg(text, chr(10) || chr(10) order by page_number) as full_text, sum(tables)::bigint as table_count from p group by doc_id",
)
def pdf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.pdf_extract(_pdf_pages(spark, sf_dir), everything=True).select("doc_id", F.size("pages").cast("bigint").alias("pages"), "full_text", "table_count")


@register("paragraph_texts", f"select doc_id, string_agg(text, chr(10) order by index) filter ({_stripped('text')} != '') as text from ({DOC_LINES}) group by doc_id having count(*) filter ({_stripped('text')} != '') > 0")
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.text_of_paragraphs(_doc_lines(spark, sf_dir)).where("text != ''").select("doc_id", "text")


@register(
    "stats_summary",
    f"""with k as (select *, row_number() over (partition by doc_id order by index, id, text) as sample from ({LINE_FACTS}) where (alignment = 'justify' or first_line_indent_pt > 0) and {_norm('style_name')} in ('a', 'n'))
select doc_id, count(*) as candidate_count, list(index order by sample) filter (sample <= 3) as examples, list(substr(text, 1, 120) order by sample) filter (sample <= 3) as previews from k group by doc_id""",
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats_ops.summary(_line_facts(spark, sf_dir), ParagraphFilter(style_hints=("a", "N"), require_body_shape=True), sample_limit=3)
    of = lambda n: F.transform("candidate_examples", lambda x: x[n])
    return rows.select("doc_id", "candidate_count", of("paragraph_index").alias("examples"), of("text_preview").alias("previews"))


# ---- all rules over packages that break them: the elements as a plain walk sees them, the rules in SQL


def _walked() -> tuple[str, str]:
    """DuckDB tables of the sample packages: elements (doc_id, part, pos, parent, tag, ns, anc, attrs, text) and parts."""
    elements, parts = [], []
    for doc, content in broken_packages():
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for part in z.namelist():
                if not part.endswith((".xml", ".rels")):
                    parts.append((doc, part, None, None, []))
                    continue
                raw, numbers = z.read(part), {}
                try:
                    root = ET.fromstring(raw)
                except ET.ParseError as e:
                    parts.append((doc, part, str(e), None, []))
                    continue
                above = {c: p for p in root.iter() for c in p}
                named = lambda key: ":".join(x for x in (packages.PREFIXES.get(key[1:].partition("}")[0], "?") if key[0] == "{" else "", key.rpartition("}")[2]) if x)
                for n, x in enumerate(root.iter()):
                    numbers[x] = n
                    around, up = [], above.get(x)
                    while up is not None:
                        around.insert(0, up.tag.rpartition("}")[2])
                        up = above.get(up)
                    ns, _, tag = named(x.tag).rpartition(":")
                    elements.append((doc, part, n, numbers[above[x]] if x in above else None, tag, ns, around, [[named(k), v] for k, v in x.attrib.items()], x.text))
                ignorable = root.attrib.get("{http://schemas.openxmlformats.org/markup-compatibility/2006}Ignorable")
                parts.append((doc, part, None, ignorable, re.findall(r"xmlns:(\w+)=", raw.decode().partition(">")[0 if not raw.startswith(b"<?") else 2])))
    return _values(elements, "doc_id, part, pos, parent, tag, ns, anc, attrs, text"), _values(parts, "doc_id, part, error, ignorable, declared")


def _rules_sql() -> str:
    elements, parts = _walked()
    attr = lambda name: f"list_filter(attrs, lambda a: a[1] = '{name}')[1][2]"
    names = " ".join(f"when '{t}' then '{a}'" for t, (a, _) in package.UNIQUE_IDS.items())
    scopes = " ".join(f"when '{t}' then '{x}'" for t, (_, x) in package.UNIQUE_IDS.items())
    body = "part in ('document.xml') or part like '%/document.xml'"
    roots, media = (", ".join(f"'{x}'" for x in xs) for xs in (package.DECLARED_ROOTS, package.MEDIA))
    served = "regexp_replace(regexp_replace(part, '(^|/)_rels/([^/]*)$', '\\1\\2'), '[.]rels$', '')"
    base = "case when target like '/%' or rels_part = '_rels/.rels' then '' else regexp_replace(rels_part, '(^|/)_rels/[^/]*$', '\\1') end"
    return f"""
with p0 as {parts}, e0 as {elements},
bad as (select distinct doc_id from p0 where error is not null), p as (select * from p0 anti join bad using (doc_id)), e as (select * from e0 anti join bad using (doc_id)),
ids as (select doc_id, part, pos, lower(tag) as tag, case lower(tag) {scopes} end as scope, list_filter(attrs, lambda a: lower(string_split(a[1], ':')[-1]) = case lower(tag) {names} end)[1][2] as id
  from e where not list_has_any(list_transform(anc, lambda a: lower(a)), ['sectionlst', 'alternatecontent'])),
rel as (select doc_id, part as rels_part, pos, {attr('Id')} as id, {attr('Target')} as target, {served} as part from e where tag = 'Relationship' and part like '%.rels'),
loc as (select *, regexp_replace(regexp_replace(ltrim({base} || target, '/'), '[^/]+/[.][.]/', ''), '(^|/)[.]/', '\\1') as named from rel where coalesce(target, '') != '' and target not like 'http%' and target not like 'mailto:%'),
known as (select distinct doc_id, part, id from rel where coalesce(id, '') != ''),
uses as (select doc_id, part, pos, tag, unnest(['id', 'embed', 'link']) as name, unnest([{attr('r:id')}, {attr('r:embed')}, {attr('r:link')}]) as id from e where part not like '%.rels'),
marks as (select doc_id, tag, {attr('w:id')} as id from e where ns = 'w' and ((({body}) and tag in ('commentRangeStart', 'commentRangeEnd', 'commentReference')) or (part like '%/comments.xml' and tag = 'comment'))),
seen as (select doc_id, id, count(*) filter (tag = 'commentRangeStart') as a, count(*) filter (tag = 'commentRangeEnd') as z, count(*) filter (tag = 'comment') as c from marks group by all),
hexed as (select doc_id, part, pos, {attr('w14:paraId')} as para, {attr('w16cid:durableId')} as durable, part like '%numbering.xml' as decimal from e),
found as (
  select doc_id, 'well_formed' as rule, part, null::bigint as pos, error as detail from p0 where error is not null
  union all select doc_id, 'namespaces', part, null, x from (select doc_id, part, declared, unnest(regexp_split_to_array(trim(ignorable), '[ ]+')) as x from p where ignorable is not null) where not list_contains(declared, x)
  union all select doc_id, 'unique_ids', part, pos, tag || ' ' || id || ' first at ' || first from (select *, min(pos) over (partition by doc_id, part, tag, id) as first from ids where scope = 'file' and id is not null) where pos > first
  union all select doc_id, 'unique_ids', part, pos, tag || ' ' || id || ' first at ' || f.part || ' ' || f.pos from (select *, min({{part: part, pos: pos}}) over (partition by doc_id, id) as f from ids where scope = 'global' and id is not null) where {{part: part, pos: pos}} > f
  union all select doc_id, 'file_references', rels_part, pos, 'broken ' || target from loc where not exists (select 1 from p where p.doc_id = loc.doc_id and p.part = loc.named)
  union all select doc_id, 'file_references', part, null, 'unreferenced' from p where part != '[Content_Types].xml' and part not like '%.rels' and exists (select 1 from p r where r.doc_id = p.doc_id and r.part like '%.rels')
    and not exists (select 1 from loc where loc.doc_id = p.doc_id and loc.named = p.part)
  union all select doc_id, 'content_types', part, pos, 'undeclared root ' || tag from e where parent is null and tag in ({roots}) and not regexp_matches(part, '[.]rels|\\[Content_Types\\]|docProps/|_rels/')
    and not exists (select 1 from e t where t.doc_id = e.doc_id and t.part = '[Content_Types].xml' and t.tag = 'Override' and ltrim(list_filter(t.attrs, lambda a: a[1] = 'PartName')[1][2], '/') = e.part)
  union all select doc_id, 'content_types', part, null, 'undeclared extension ' || lower(string_split(part, '.')[-1]) from p where lower(string_split(part, '.')[-1]) in ({media}) and not regexp_matches(part, '(^|/)(_rels|docProps)/')
    and not exists (select 1 from e t where t.doc_id = p.doc_id and t.part = '[Content_Types].xml' and t.tag = 'Default' and lower(list_filter(t.attrs, lambda a: a[1] = 'Extension')[1][2]) = lower(string_split(p.part, '.')[-1]))
  union all select doc_id, 'content_types', '[Content_Types].xml', null, 'no content types' from (select distinct doc_id from p) where doc_id not in (select doc_id from e where part = '[Content_Types].xml')
  union all select doc_id, 'whitespace', part, pos, substr(text, 1, 50) from e where ({body}) and ns = 'w' and tag = 't' and regexp_matches(text, '^[ \\t\\n\\r]|[ \\t\\n\\r]$') and coalesce({attr('xml:space')}, '') != 'preserve'
  union all select doc_id, 'deletions', part, pos, tag || ' ' || substr(coalesce(text, ''), 1, 50) from e where ({body}) and ns = 'w' and list_contains(anc, 'del') and ((tag = 't' and coalesce(text, '') != '') or tag = 'instrText')
  union all select doc_id, 'insertions', part, pos, substr(coalesce(text, ''), 1, 50) from e where ({body}) and ns = 'w' and tag = 'delText' and list_contains(anc, 'ins') and not list_contains(anc, 'del')
  union all select u.doc_id, 'relationship_ids', u.part, u.pos, u.tag || ' r:' || u.name || ' ' || u.id || ' valid: ' || coalesce((select string_agg(id, ',' order by id) from (select distinct k.id from known k where k.doc_id = u.doc_id and k.part = u.part order by 1 limit 5)), '')
    from uses u where coalesce(u.id, '') != '' and exists (select 1 from e r where r.doc_id = u.doc_id and r.part like '%.rels' and {served.replace('part', 'r.part')} = u.part) and not exists (select 1 from known k where k.doc_id = u.doc_id and k.part = u.part and k.id = u.id)
  union all select doc_id, 'relationship_ids', rels_part, pos, 'repeated ' || id from (select *, min(pos) over (partition by doc_id, rels_part, id) as first from rel where coalesce(id, '') != '') where pos > first
  union all select doc_id, 'id_constraints', part, pos, 'paraId ' || para from hexed where para is not null and not coalesce(try_cast('0x' || para as bigint) < 2147483648, false)
  union all select doc_id, 'id_constraints', part, pos, 'durableId ' || durable from hexed where durable is not null and not coalesce(try_cast(case when decimal then durable else '0x' || durable end as bigint) < 2147483647, false)
  union all select doc_id, 'comment_markers', 'word/document.xml', coalesce(try_cast(id as bigint), 0), what || ' ' || id from (
    select doc_id, id, 'end without start' as what from seen where z > 0 and a = 0 union all select doc_id, id, 'start without end' from seen where a > 0 and z = 0
    union all select doc_id, id, 'no such comment' from seen where c = 0 and coalesce(id, '') != '' and doc_id in (select doc_id from e where part like '%/comments.xml')))
select doc_id, rule, part, pos::bigint as pos, detail from found"""


@register("package_rules", _rules_sql())
def package_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All integrity rules over packages that break them."""
    parts = packages.unpack(spark.createDataFrame(broken_packages(), "doc_id string, content binary"))
    outcome = packages.outcomes(parts)
    return package.validate_package(parts, packages.elements(parts), outcome.select("doc_id", "part", "error"), outcome)
