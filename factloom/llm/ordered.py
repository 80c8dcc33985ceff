"""Documents in ascending id order over many partitions, with one shuffle of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import partitions


def cuts(spark: SparkSession, docs: DataFrame, id_col: str) -> list[int]:
    """Ids that part the table into ranges of about equal counts; their number is that of the shuffle partitions."""
    n = partitions(spark)
    row = docs.agg(F.percentile_approx(F.col(id_col), [k / n for k in range(1, n)] or [0.5], 10_000).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket(id_column: Column, at: list[int]) -> Column:
    """The number of the range that an id lies in: the count of cuts up to it; null ids come first."""
    if not at:
        return F.lit(0)
    # a binary search over constants, as nested conditions of logarithmic depth
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(id_column >= F.lit(at[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(at))


def looked_up(id_column: Column, values: dict[int, int]) -> Column:
    """The value of an id among a few (as many as ranges), else NULL: a search tree over constants."""
    keys = sorted(values)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(None).cast("int")
        mid = (low + high) // 2
        here = F.when(id_column == F.lit(keys[mid]), F.lit(values[keys[mid]]))
        if high - low == 1:
            return here
        return here.when(id_column < F.lit(keys[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(keys))


def in_ranges(df: DataFrame, at: list[int], *order: str) -> DataFrame:
    """``df`` with bucket k (its column ``bucket``) as partition k, each sorted by ``order``."""
    return df.repartitionById(len(at) + 1, F.col("bucket")).sortWithinPartitions(*order)
