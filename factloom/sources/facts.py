"""Fact tables from JSON, text and PDF, check lists, and the store of parsed facts."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions.text import line_count, strip
from factloom.staging import remove

FACTS = (
    f"struct<format:string, metadata:map<string,string>, layout:{schema.LAYOUT}, paragraphs:array<struct<id:string, index:int, text:string, style_name:string, style_id:string,"
    f" properties:{schema.PROPERTIES}, property_sources:map<string,string>, numbering:{schema.NUMBERING}>>,"
    f" styles:array<struct<name:string, style_id:string, style_type:string, type:string, base_style:string, properties:{schema.PROPERTIES}>>>"
)
TEXT_SUFFIXES = ("txt", "md", "json")


def load_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, facts struct) of JSON files with one facts record each."""
    shape = _schema_of(FACTS)
    frame = spark.read.schema(shape).option("multiLine", "true")
    return frame.json(path).select(F.col("_metadata.file_path").alias("doc_id"), F.struct(*shape.fieldNames()).alias("facts"))


def _schema_of(struct: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"x {struct}")["x"].dataType


def paragraphs_of(facts: DataFrame) -> DataFrame:
    """schema.PARAGRAPHS of a facts table; a missing id is ``p-<position>``, index its position, text empty."""
    rows = facts.select("doc_id", F.posexplode("facts.paragraphs").alias("pos", "p"))
    return rows.select(
        "doc_id", F.coalesce("p.id", F.concat(F.lit("p-"), F.col("pos").cast("string"))).alias("id"), F.coalesce("p.index", "pos").alias("index"), F.coalesce("p.text", F.lit("")).alias("text"),
        "p.style_name", "p.style_id", "p.properties", "p.property_sources", "p.numbering",
    )


def styles_of(facts: DataFrame) -> DataFrame:
    """Styles of a facts table; the type is read under either of its names."""
    return facts.select("doc_id", F.explode("facts.styles").alias("s")).select(
        "doc_id", "s.style_id", "s.name", F.coalesce("s.style_type", "s.type").alias("style_type"), F.col("s.base_style").alias("base_style_id"), "s.properties"
    )


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_id, text, line_count) of text files as UTF-8. A path that names a file of another suffix is an error; in a folder
    or glob such files are left out."""
    for one in [path] if isinstance(path, str) else path:
        ending = os.path.splitext(one)[1].lower().lstrip(".")
        if ending and not any(x in one for x in "*?[{") and ending not in TEXT_SUFFIXES:
            raise ValueError(f"no text source: {one}")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("doc_id", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*TEXT_SUFFIXES)).withColumn("line_count", line_count("text"))


def text_of_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text, line_count): a document's paragraphs that are not empty, in order, one a line."""
    said = F.when(strip("text") != "", F.struct("index", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]), "\n")
    return paragraphs.groupBy("doc_id").agg(text.alias("text")).withColumn("line_count", line_count("text"))


def spec_lines(texts: DataFrame) -> DataFrame:
    """(spec_id, line_number, text) of whole texts (doc_id, text)."""
    from factloom.operators.spec import column_lines

    spec_id, rows = column_lines(F.col("doc_id"), F.col("text"))
    return texts.select(spec_id.alias("spec_id"), F.explode(rows).alias("l")).select("spec_id", "l.line_number", "l.text")


def load_checks(path: str) -> list[dict]:
    """Check instructions of a JSON file: a list, or an object with ``checks``."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return data["checks"] if isinstance(data, dict) else data


def load_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, metric, value, cnt, rank) of the JSON that the stats command writes: one entry a document in ``summary``."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["summary"]
    rows = []
    for one in found if isinstance(found, list) else [found]:
        lists = one.get("distributions") or {k.removesuffix("_distribution"): v for k, v in one.items() if k.endswith("_distribution")}
        for metric, values in lists.items():
            rows += [(one.get("doc_id") or path, metric, str(v["value"]), int(v["count"]), n) for n, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "doc_id string, metric string, value string, cnt bigint, rank int")


PDF_PAGES = "doc_id string, page_number int, width double, height double, text string, tables array<array<array<string>>>"


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDF files, if an optional reader is installed; their schema is PDF_PAGES. Spark reports a path that is not there."""
    ending = os.path.splitext(path)[1].lower()
    if ending and ending != ".pdf" and not any(x in path for x in "*?[{"):
        raise ValueError(f"not a PDF file: {path}")
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pdfplumber") from e
    import io

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for ident, content in zip(*(c.to_pylist() for c in batch.columns)):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    rows = [(ident, n, round(float(p.width), 1), round(float(p.height), 1), p.extract_text() or "", p.extract_tables()) for n, p in enumerate(pdf.pages, 1)]
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.list_(pa.list_(pa.string()))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "page_number", "width", "height", "text", "tables"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.col("path").alias("doc_id"), "content")
    return files.mapInArrow(run, PDF_PAGES)


def pdf_extract(pages: DataFrame, wanted: str | None = None, include_tables: bool = False, everything: bool = False) -> DataFrame:
    """One row a document: its pages in the range, and with text their ``full_text``; with tables their count.

    include_tables: only pages with tables. everything: texts and tables of all pages.
    """
    from factloom.functions.text import page_range

    total = pages.groupBy("doc_id").agg(F.max("page_number").alias("total"))
    picked = pages.join(total, "doc_id").where(F.array_contains(page_range(F.lit(wanted).cast("string"), F.col("total")), F.col("page_number") - 1))
    if include_tables:
        picked = picked.where("size(tables) > 0")
    page = F.array_sort(F.collect_list(F.struct("page_number", "width", "height", "text", "tables")))
    out = picked.groupBy("doc_id").agg(page.alias("pages"), F.first("total").alias("page_count"), F.sum(F.greatest(F.size("tables"), F.lit(0))).alias("table_count"))
    if not include_tables:
        out = out.withColumn("full_text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"))
    return out if include_tables or everything else out.drop("table_count")


class FactsStore:
    """Parsed facts as Parquet by (path, modification time): unchanged files are not parsed again, in any session.

    Parts are added; a file's newest facts count. ``stats`` tells how many of the last request's files were there.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path
        self._stats = {"hits": 0, "misses": 0}

    def _known(self) -> DataFrame | None:
        jvm = self._spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self._path)
        there = where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self._spark.read.parquet(self._path) if there else None

    def paragraphs(self, files: DataFrame, parse) -> DataFrame:
        """Paragraphs of ``files`` (doc_id, modified, content): stored ones, and ``parse(missing files)`` for the rest."""
        known = self._known()
        marks = files.select("doc_id", "modified")
        missing = files if known is None else files.join(known.select("doc_id", "modified").distinct(), ["doc_id", "modified"], "left_anti")
        misses = missing.count()
        hits = marks.count() - misses
        self._stats = {"hits": self._stats["hits"] + hits, "misses": self._stats["misses"] + misses}
        if misses:
            parse(missing).join(marks, "doc_id").write.mode("append").parquet(self._path)
        stored = self._known()
        return (stored if stored is not None else parse(missing).join(marks, "doc_id")).join(marks, ["doc_id", "modified"], "left_semi")

    def stats(self) -> dict:
        known = self._known()
        return self._stats | {"size": 0 if known is None else known.select("doc_id", "modified").distinct().count()}

    def clear(self) -> None:
        remove(self._spark, self._path)
        self._stats = {"hits": 0, "misses": 0}


def suffix_supported(path: str) -> bool:
    from factloom.sources.packages import WORD_SUFFIXES

    return os.path.splitext(path)[1].lower().lstrip(".") in WORD_SUFFIXES
