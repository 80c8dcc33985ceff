"""Streaming ingestion: new files or rows through the same plans as a batch, with watermarks for late rows.

The reference has no streaming; these are thin entries to the operators that already are DataFrame plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.stats import ParagraphFilter, observations
from factloom.sources import packages


def stream_elements(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The element table of Word files as they arrive in a folder."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.{" + ",".join(packages.WORD_SUFFIXES) + "}").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return packages.elements(packages.unpack(files.select(F.col("path").alias("doc_id"), "content")))


def running_distributions(paragraphs: DataFrame, wanted: ParagraphFilter = ParagraphFilter()) -> DataFrame:
    """(metric, value, cnt) over a stream of paragraphs, for the complete or update output mode."""
    p = F.col("properties")
    kept = paragraphs.where(wanted.condition(F.col("text"), F.col("style_name"), p["alignment"], p["first_line_indent_pt"]))
    return observations(kept, [], "index").groupBy("metric", "value").agg(F.count("*").alias("cnt"))


def windowed_counts(rows: DataFrame, time: str, key: str, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts a key in tumbling windows; rows later than the watermark are left out, and state is let go."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), key, "cnt")


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to a folder, exactly once, until the input that is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
