"""The training-data pipeline: five stages over the documents, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import remove, scratch, staged, table
from factloom.llm.bpe import bpe_digests
from factloom.llm.mixing import mixed_documents
from factloom.llm.near_copies import near_copy_dedup
from factloom.llm.quality import quality_rules
from factloom.llm.queries import tokenizer_path
from factloom.llm.secrets import key_blocks, redacted, secret_spans


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, beside the text that an operator reads: what it keeps comes back whole."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of ``rows`` with their new text and its length."""
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("bigint")}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that fail a rule are taken out of the others. Null and empty texts have no words and go;
    rows are judged alone, so repeated ones and null ids are too; an empty table stays empty."""
    judged = quality_rules(_whole_rows(docs), "row", cleaned=True)
    # behind an explode of one, the verdict is not worked out a second time for the filter
    kept = judged.select(F.explode(F.array(F.struct(F.col("id").alias("row"), F.col("text").alias("new"), "kept"))).alias("x")).where("x.kept")
    return _with_text(kept.select("x.row", "x.new"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more) stays: that of the smallest id.

    Texts without words, null ones among them, are one group. Rows that share an id are one document, rows with a null
    id stay; an empty table stays empty."""
    return near_copy_dedup(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, private keys from BEGIN to END; no document goes. A null text is an empty one;
    repeated rows and null ids are each answered; an empty table stays empty."""
    found = secret_spans(_whole_rows(docs), "row")
    return _with_text(found.select(F.col("id").alias("row"), redacted(F.col("text"), key_blocks(F.col("text"), F.col("spans"))).alias("new")), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix uses it, at least once. Null ids and sources are a document and a source
    of their own, repeated rows are one document and all stay, an empty table stays empty."""
    return mixed_documents(spark, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each use of a document, with digests of the ids and of the decoded text. Null and empty texts give no
    ids; repeated rows and null ids are each answered; an empty table gives no rows."""
    return bpe_digests(spark, docs, tokenizer_path(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("source mixing", mixing),
    ("bpe encoding", encoding),
]

#: near-copy components and BPE are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage and its operators wrote is removed once the next one's result is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        with scratch(spark) as made:
            docs = stage(spark, docs, sf_dir)
            if n + 1 == len(STAGES):
                made.keep(0)  # its result, and what that reads, is still to be read
                return docs
            docs = staged(spark, docs, f"pipeline-{n + 1}")
            (last,) = made.keep()
        if before is not None:
            remove(spark, before)
        before = last
    return docs
