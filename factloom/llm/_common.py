"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.staging import clean, new_path, remove, run_dir, scratch, shared_dir, staged  # noqa: F401  (for the operators)

#: White space between words: U+0020 and U+0009 to U+000D, as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers that the driver's machine starts import this package.

    On a cluster the package is passed with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def no_null(text: str):
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that holds more than this share of the rows (and more than LEAST_HOT) is hot; at most as many keys as its inverse are.
HOT_SHARE, LEAST_HOT = 1 / 1000, 100


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each of its keys and in ``count`` how many rows of ``left`` hold it.

    Keys with more than HOT_SHARE of all counted rows go by a broadcast: there are 1000 of them at most, whatever the
    input. All other keys are shuffled, and none of them is a large part of a task. Both should be staged tables.
    """
    row = right.agg(F.sum(count).alias("n"), F.max(count).alias("most")).first()
    limit = max(LEAST_HOT, int((row["n"] or 0) * HOT_SHARE))
    if (row["most"] or 0) <= limit:
        return left.join(right, keys, how)
    hot, rest = right.where(F.col(count) > limit), right.where(F.col(count) <= limit)
    return left.join(F.broadcast(hot), keys, how).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how))


#: Slots of a bitmap for each key in it, and its least and greatest size (1 MB, 128 MB).
SLOTS_A_KEY, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 23, 1 << 30


def bitmap_of(hashed: DataFrame) -> np.ndarray:
    """A bitmap of the values of the one column of ``hashed``, hashes of 64 bits: bit ``h & (64 * len - 1)`` is set for each.

    Its size follows their count up to a bound. It may hold other values, never lacks one, so it only spares work.
    """
    size, count = LEAST_SLOTS, hashed.count()
    while size < min(MOST_SLOTS, SLOTS_A_KEY * count):
        size *= 2
    h = F.col(hashed.columns[0])
    words = (
        hashed.select(F.shiftright(h.bitwiseAND(F.lit(size - 1)), 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(`{hashed.columns[0]}` & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        # the words of a piece of the bitmap are one row: few rows reach the driver
        .groupBy(F.shiftright("word", 12).alias("piece"))
        .agg(F.collect_list("word").alias("words"), F.collect_list("bits").alias("bits"))
    )
    out = np.zeros(size // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["words"]] = r["bits"]
    return out


def held_in(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of some hashes the bitmap may hold."""
    return (bitmap[(hashed & (64 * len(bitmap) - 1)) >> 6] >> (hashed & 63)) & 1 == 1
