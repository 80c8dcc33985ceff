"""Comparison of two documents, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_keyed(reference: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, reference, target) where the values differ, a missing one being a value of its own (full outer)."""
    a = reference.select(*keys, F.col(value).alias("reference"))
    b = target.select(*keys, F.col(value).alias("target"))
    return a.join(b, keys, "full").where(~F.col("reference").eqNullSafe(F.col("target")))


def layout_entries(layouts: DataFrame) -> DataFrame:
    """(doc_id, key, value as JSON) of each top-level entry of a layout."""
    fields = layouts.schema["layout"].dataType.fieldNames()
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.when(F.col(f"layout.{n}").isNotNull(), F.to_json(F.struct(F.col(f"layout.{n}").alias(n)))).alias("value")) for n in fields])
    return layouts.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.key", "p.value").where("value is not null")


def compare_documents(pairs: DataFrame, paragraphs: DataFrame, layouts: DataFrame) -> DataFrame:
    """(reference_id, target_id, type, key, reference, target) for each pair (reference_id, target_id)."""
    counts = paragraphs.groupBy("doc_id").agg(F.count("*").alias("n"))

    def sides(values: DataFrame, side: str) -> DataFrame:
        return pairs.join(values.withColumnRenamed("doc_id", f"{side}_id"), f"{side}_id")

    keys = ["reference_id", "target_id", "type", "key"]
    size = lambda s: sides(counts, s).select("reference_id", "target_id", F.lit("paragraph_count").alias("type"), F.lit("").alias("key"), F.col("n").cast("string").alias("value"))
    laid = lambda s: sides(layout_entries(layouts), s).select("reference_id", "target_id", F.lit("layout").alias("type"), "key", "value")
    return compare_keyed(size("reference").unionByName(laid("reference")), size("target").unionByName(laid("target")), keys, "value")


def report(differences: DataFrame, title: str = "Differences", stamp: str = "") -> DataFrame:
    """(reference_id, target_id, markdown): numbered differences, a section for each type."""
    shown = F.concat(F.lit(". "), F.when(F.col("key") == "", F.col("type")).otherwise(F.col("key")), F.lit(": "), F.coalesce("reference", F.lit("none")), F.lit(" -> "), F.coalesce("target", F.lit("none")))
    lists = (
        differences.groupBy("reference_id", "target_id", "type")
        .agg(F.array_sort(F.collect_list(F.struct("key", shown.alias("line")))).alias("rows"))
        .withColumn("section", F.concat(F.lit("## "), F.col("type"), F.lit("\n"), F.array_join(F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), r["line"])), "\n")))
    )
    head = f"# {title}\n" + (f"{stamp}\n" if stamp else "")
    return lists.groupBy("reference_id", "target_id").agg(
        F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "section"))), lambda s: s["section"]), "\n"), F.lit("\n")).alias("markdown")
    )
