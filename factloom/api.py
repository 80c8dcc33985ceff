"""Namespaces over the operators: word, analysis, text, pdf, spec, and the facts store.

Paths may be globs and folders; every match is read, and doc_id tells the documents apart.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions.text import normalize_name, normalized
from factloom.operators import checks as check_ops
from factloom.operators import compare as compare_ops
from factloom.operators import package, spec, stats
from factloom.operators.stats import ParagraphFilter
from factloom.sources import docx, facts, packages
from factloom.staging import staged


@dataclass
class Documents:
    """Fact tables of some documents, each built when it is first asked for."""

    spark: SparkSession
    files: DataFrame
    elements: DataFrame

    @property
    def paragraphs(self) -> DataFrame:
        return docx.paragraphs(self.spark, self.elements)

    @property
    def styles(self) -> DataFrame:
        return docx.resolved_styles(self.spark, self.elements)

    @property
    def ids(self) -> DataFrame:
        """Every document, those without paragraphs too."""
        return self.files.select("doc_id")

    def release(self) -> None:
        """Let go of what is kept in memory."""
        self.elements.unpersist()

    def __enter__(self) -> Documents:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    @property
    def layouts(self) -> DataFrame:
        return docx.layouts(self.elements)

    @property
    def headers_footers(self) -> DataFrame:
        return docx.headers_footers(self.elements)

    @property
    def tables(self) -> DataFrame:
        return docx.tables(self.elements)

    @property
    def metadata(self) -> DataFrame:
        return docx.metadata(self.spark, self.files, self.elements)


#: So many parsed inputs are kept, the latest used.
CACHED = 32


class Word:
    def __init__(self, spark: SparkSession, cached: int = CACHED) -> None:
        self._spark, self._most = spark, cached
        self._cache: OrderedDict[tuple, Documents] = OrderedDict()
        self._stats = {"hits": 0, "misses": 0}

    def parse(self, path: str | list[str]) -> Documents:
        """The documents of a path, glob or folder; parsed once as long as its files are the same."""
        files = packages.read_files(self._spark, path)
        names = path if isinstance(path, str) else tuple(path)
        mark = files.agg(F.count("*").alias("n"), F.max("modified").alias("at"), F.sum(F.xxhash64("doc_id", "modified").cast("decimal(38,0)")).alias("h")).first()
        key = (names, mark["n"], mark["at"], mark["h"])
        found = self._cache.get(key)
        if found is not None:
            self._stats["hits"] += 1
            self._cache.move_to_end(key)
            return found
        self._stats["misses"] += 1
        for old in [k for k in self._cache if k[0] == names]:  # changed since
            self._cache.pop(old).release()
        found = self._cache[key] = Documents(self._spark, files, packages.elements(packages.unpack(files)).persist())
        while len(self._cache) > self._most:
            self._cache.popitem(last=False)[1].release()
        return found

    def cache_stats(self) -> dict:
        return self._stats | {"size": len(self._cache), "max_size": self._most}

    def clear_cache(self) -> None:
        for documents in self._cache.values():
            documents.release()
        self._cache.clear()
        self._stats = {"hits": 0, "misses": 0}

    def documents(self, given: Documents | str | list[str]) -> Documents:
        return given if isinstance(given, Documents) else self.parse(given)

    def query_style(self, documents: Documents | str, name: str) -> DataFrame:
        """Styles whose name holds the given one, case and white space aside."""
        return query_style(self.documents(documents).styles, name)

    def query_text(self, documents: Documents | str, keyword: str) -> DataFrame:
        return query_text(self.documents(documents).paragraphs, keyword)

    def compare(self, reference: str, target: str) -> DataFrame:
        both = self.parse([reference, target])
        names = [packages.read_files(self._spark, p).select("doc_id").first()["doc_id"] for p in (reference, target)]
        pairs = self._spark.createDataFrame([tuple(names)], "reference_id string, target_id string")
        return compare_ops.compare_documents(pairs, both.paragraphs, both.layouts)

    def inspect(self, path: str, show: str | None = None, output_dir: str | None = None, merge_runs: bool = False) -> DataFrame:
        """The parts of packages with their sizes, or one part indented; with ``output_dir`` all XML parts, indented, go there as
        Parquet (doc_id, part, xml, merged), runs of equal format merged on request."""
        parts = packages.unpack(packages.read_files(self._spark, path))
        if output_dir is not None:
            packages.pretty(parts, merge_runs).write.mode("overwrite").parquet(output_dir)
            return self._spark.read.parquet(output_dir).groupBy("doc_id").agg(F.count("*").alias("xml_parts"), F.sum("merged").alias("merged_runs"))
        return packages.listing(parts) if show is None else packages.pretty(parts.where(F.col("part") == show), merge_runs).drop("merged")

    def validate(self, path: str, auto_repair: bool = False, output: str | None = None, schemas: str | None = None, original: str | None = None) -> DataFrame:
        """Violations. ``auto_repair`` judges the repaired packages, and writes them below ``output`` as Parquet (doc_id, content).
        With a folder of ``schemas`` parts are validated too; ``original`` is one package whose own errors do not count."""
        parts = packages.unpack(packages.read_files(self._spark, path))
        if auto_repair:
            whole = packages.repacked(parts, packages.repaired(parts))
            if output is not None:
                whole.write.mode("overwrite").parquet(output)
                whole = self._spark.read.parquet(output)
            parts = packages.unpack(whole)
        parts = staged(self._spark, parts, "parts")
        rows = staged(self._spark, packages.elements(parts), "elements")
        outcome = packages.outcomes(parts)
        found = package.validate_package(parts, rows, outcome.select("doc_id", "part", "error"), outcome)
        if schemas is None:
            return found
        before = None
        if original is not None:
            own = packages.unpack(packages.read_files(self._spark, original)).drop("doc_id")
            before = parts.select("doc_id").distinct().join(F.broadcast(own), F.lit(True))  # one package's parts, beside each
        return found.unionByName(package.schema_violations(parts, schemas, before))


def query_style(styles: DataFrame, name: str) -> DataFrame:
    return styles.where(F.contains(normalized("name"), F.lit(normalize_name(name))))


def query_text(paragraphs: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    return paragraphs.where(F.contains(text, F.lit(keyword)))


class Analysis:
    def __init__(self, spark: SparkSession, word: Word | None = None) -> None:
        self._spark, self._word = spark, word or Word(spark)

    def check(self, documents: Documents | DataFrame | str, checks: list[dict], layouts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(results, issues); a batch with an invalid instruction raises ValueError with all that is wrong."""
        if errors := check_ops.validate(checks):
            raise ValueError("; ".join(errors))
        table = self._spark.createDataFrame(check_ops.to_rows(checks), schema.CHECKS)
        if not isinstance(documents, DataFrame):
            documents = self._word.documents(documents)
            return check_ops.run_checks(table, documents.paragraphs, documents.layouts, documents.ids)
        return check_ops.run_checks(table, documents, layouts)

    def stats(self, documents: Documents | DataFrame | str, wanted: ParagraphFilter = ParagraphFilter()) -> DataFrame:
        """(doc_id, metric, value, cnt, rank): the distributions in long form."""
        return stats.paragraph_stats(documents if isinstance(documents, DataFrame) else self._word.documents(documents).paragraphs, wanted)

    def summary(self, documents: Documents | DataFrame | str, wanted: ParagraphFilter = ParagraphFilter(), sample_limit: int = 8) -> DataFrame:
        """One row a document: candidate_count, distributions, candidate_examples."""
        if isinstance(documents, DataFrame):
            return stats.summary(documents, wanted, sample_limit=sample_limit)
        documents = self._word.documents(documents)
        return stats.summary(documents.paragraphs, wanted, docs=documents.ids, sample_limit=sample_limit)


class Text:
    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def read(self, path: str) -> DataFrame:
        if facts.suffix_supported(path):
            return facts.text_of_paragraphs(Word(self._spark).parse(path).paragraphs)
        return facts.read_text(self._spark, path)


class Pdf:
    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def extract(self, path: str, pages: str | None = None, include_tables: bool = False, everything: bool = False) -> DataFrame:
        return facts.pdf_extract(facts.pdf_pages(self._spark, path), pages, include_tables, everything)


class Spec:
    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def _lines(self, path: str) -> DataFrame:
        return facts.spec_lines(facts.read_text(self._spark, path))

    def check_conflicts(self, path: str) -> DataFrame:
        return spec.conflicts(self._lines(path))

    def check_structure(self, path: str, sections: dict | None = None) -> DataFrame:
        return spec.structure(self._spark, self._lines(path), sections)

    def check_body_consistency(self, evidence: DataFrame, checks: list[dict], keywords: tuple[str, ...] = (), docs: DataFrame | None = None) -> DataFrame:
        return spec.body_consistency(self._spark.createDataFrame(check_ops.to_rows(checks), schema.CHECKS), evidence, keywords, docs=docs)

    def check_common_sense(self, path: str) -> DataFrame:
        return spec.common_sense(self._lines(path))


class Api:
    def __init__(self, spark: SparkSession, cached: int = CACHED) -> None:
        self.word = Word(spark, cached)
        self.analysis, self.text, self.pdf, self.spec = Analysis(spark, self.word), Text(spark), Pdf(spark), Spec(spark)
        self._spark = spark

    def cache_stats(self) -> dict:
        return self.word.cache_stats()

    def clear_cache(self) -> None:
        self.word.clear_cache()

    def store(self, path: str) -> facts.FactsStore:
        return facts.FactsStore(self._spark, path)


class DocumentService:
    """One flat facade over the namespaces, for callers of the older names."""

    def __init__(self, spark: SparkSession, cached: int = CACHED) -> None:
        api = Api(spark, cached)
        self.parse, self.query_style, self.query_text = api.word.parse, api.word.query_style, api.word.query_text
        self.validate, self.inspect, self.compare_docs = api.word.validate, api.word.inspect, api.word.compare
        self.batch_check, self.stats = api.analysis.check, api.analysis.summary
        self.read_text, self.read_pdf = api.text.read, api.pdf.extract
        self.spec_check_conflicts, self.spec_check_structure = api.spec.check_conflicts, api.spec.check_structure
        self.spec_check_body_consistency, self.spec_check_common_sense = api.spec.check_body_consistency, api.spec.check_common_sense
        self.cache_stats, self.clear_cache = api.cache_stats, api.clear_cache
