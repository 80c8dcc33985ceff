"""Registered queries of the training-data operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import table
from factloom.llm.bpe import bpe_digests
from factloom.llm.fingerprint import fingerprints_and_edits
from factloom.llm.html_text import extract_main_text
from factloom.llm.licenses import license_scan
from factloom.llm.mixing import mix, mixing_sql
from factloom.llm.quality import BOILERPLATE, SEPARATORS, SYMBOLS, Rules, quality_rules
from factloom.llm.repeats import digests, without_repeats
from factloom.llm.secrets import BASE, RULES, secret_spans
from factloom.llm.simhash import simhash_components
from factloom.llm.wavelet import token_files

#: A public tokenizer; the path is a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def quality_sql(rules: Rules = Rules(), source: str = "documents") -> str:
    """DuckDB SQL for the rows of ``quality_rules``, with the text without failed lines as cleaned."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    quoted = [p.replace("'", "''") for p in BOILERPLATE]
    phrases = " or ".join(f"contains(lower(x), '{p}')" for p in quoted)
    return f"""
with d as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{word}+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) as lines
  from {source}),
w as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d)),
r as (select doc_id, i from w qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
f as (
  select doc_id, text, len(words)::bigint as n_words,
    length(regexp_replace(text, '{space}', '', 'g'))::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
    len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    list_filter(lines, lambda x:
      length(x) - length(translate(x, '{SYMBOLS}', '')) > {rules.max_symbol_share}::double * length(regexp_replace(x, '{space}', '', 'g'))
      or (len(regexp_extract_all(x, '{word}+')) >= {rules.prose_words} and not regexp_matches(x, '[.!?;:,。！？…]'))
      or (length(x) - length(translate(x, '{SEPARATORS}', '')) >= {rules.min_separators}
          and (length(x) - length(translate(x, '{SEPARATORS}', ''))) * {rules.words_per_item} >= len(regexp_extract_all(x, '{word}+')))
      or (len(regexp_extract_all(x, '{word}+')) <= {rules.boilerplate_words} and ({phrases}))) as failed
  from d),
q as (
  select f.*, coalesce(c.n, 0)::bigint as n_repeat_words,
    len(failed)::bigint as n_failed_lines,
    coalesce(list_sum(list_transform(failed, lambda x: length(regexp_replace(x, '{space}', '', 'g')))), 0)::bigint as lost_chars
  from f left join c using (doc_id)),
v as (
  select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost_chars <= {rules.max_lost_share}::double * word_chars as kept, n_lines, n_failed_lines, lost_chars
from v"""


ORACLES["op1_quality_rules"] = quality_sql()


@query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return out.select(F.col("id").alias("doc_id"), *map(number, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def secrets_sql(source: str = "documents") -> str:
    """DuckDB SQL for the spans: matches and the pieces between them alternate, their lengths give the positions."""
    parts = []
    for n, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        parts.append(f"""
  select doc_id, {n} as number, '{r.kind}' as kind, s, s + length(m) as e from (
    select doc_id, ms[i] as m, vs[i] as v,
      (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as s
    from (select *, unnest(range(1, len(ms) + 1)) as i from (
      select doc_id, regexp_extract_all(text, '{regex}') as ms, regexp_extract_all(text, '{regex}', {r.group}) as vs,
        string_split_regex(text, '{regex}') as ps from d)))
  where length(v) >= {r.least}""")
    written = "string_agg(kind || ':' || s || ':' || e, ',' order by s, number)"
    counts = ", ".join(f"count(kind) filter (kind = '{k}') as n_{k}" for k in BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') as text from {source}),
h as ({' union all '.join(parts)})
select doc_id, {counts}, sha256(coalesce({written} filter (number < {len(BASE)}), '')) as base_sha256, coalesce({written} filter (kind is not null), '') as spans
from d left join h using (doc_id) group by doc_id"""


ORACLES["op3_secret_scans"] = secrets_sql()


@query
def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark, table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@query
def op5_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints_and_edits(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op4_source_mixing"] = mixing_sql()


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no paths: a document's is its source, the thousands and hundreds of its id, and its id."""
    number = F.col("doc_id")
    path = F.concat_ws("/", "source", F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"), number.cast("string"))
    return license_scan(spark, table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


@query
def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark, table(spark, sf_dir, "documents"))
    written = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.select(F.col("id").alias("doc_id"), *digests(), F.array_join(written, ",").alias("spans"))
