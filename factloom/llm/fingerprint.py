"""Canonical exact digests: normalised, folded text, a 128-bit xxhash, and byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import no_null, ship, staged
from factloom.llm.ordered import bucket, cuts, in_ranges, looked_up


def canonical(text: str) -> bytes:
    """NFKC, case folding, NFKC again, and every run of white space as one blank, trimmed; in UTF-8."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digests(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the digest of every row's canonical text, before buckets are compared."""
    ship(spark)
    kept = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t.as_py())) for t in batch.column(1)], pa.string())], ["id", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp string")


def fingerprints_and_edits(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as bigint), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is that of the next id (of the first after the last); rows that share an id are in the
    order of their texts, null ids come first. near_*: 1.0 if the canonical bytes are equal, else 0.0.
    A first pass gives the digests; ids in buckets of two rows or more are sent along with the texts when these
    are put in order, so that only such rows carry their canonical bytes to the comparison. Bytes are compared by
    the least and the greatest of a bucket, both pre-aggregated, so a bucket of any size meets in two values.
    If a bucket should hold different bytes, the fingerprints of its rows get a SHA-256 of the bytes added.
    An empty table gives no rows.
    """
    ship(spark)
    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), no_null(text_col).alias("text"))
    first = staged(spark, digests(spark, kept, "id"), "digests")
    # staged, so that both sides of the join are plain shuffles, which adaptive execution splits where a digest is hot
    shared = staged(spark, first.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "shared")
    flags = first.join(shared, "fp").groupBy("id").agg(F.lit(True).alias("flag"))

    at = cuts(spark, first.select("id"), "id")
    placed = kept.withColumn("bucket", bucket(F.col("id"), at))
    firsts = first.select("id", bucket(F.col("id"), at).alias("bucket")).groupBy("bucket").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("nulls"))
    lead = sorted(((r["bucket"], None if r["nulls"] else r["id"]) for r in firsts.collect()), key=lambda x: x[0])  # a row for each partition
    # the first document of a range also closes the range before it; the first of all closes the last
    before = {head: lead[n - 1][0] for n, (_, head) in enumerate(lead)}
    of_null = F.lit(before.pop(None)) if None in before else F.lit(None).cast("int")
    guests = F.when(F.col("id").isNull(), of_null).otherwise(looked_up(F.col("id"), before))
    rows = placed.select("id", "text", F.col("bucket").cast("int").alias("bucket"), guests.cast("int").alias("also"))
    own = rows.select("id", "text", "bucket", F.lit(1).alias("kind"))
    guest = rows.where("also is not null").select("id", "text", F.col("also").alias("bucket"), F.lit(2).alias("kind"))
    flagged = flags.select("id", F.lit("").alias("text"), bucket(F.col("id"), at).cast("int").alias("bucket"), F.lit(0).alias("kind"))
    # in a range: own rows by id and text, each id's flag before them, the guest at the end
    order = [F.expr("kind = 2"), F.expr("id is not null"), "id", "kind", "text"]
    stream = in_ranges(own.unionByName(guest).unionByName(flagged), at, *order).select("id", "text", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        names = ["id", "n_chars", "edited_sha256", "fp", "edited_fingerprint", "near_edited", "near_next", "canon"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]
        out: list[tuple] = []
        held: tuple | None = None  # id, text, canonical bytes, digest, flagged
        flag: list = []

        def closed(following: str, canon: bytes, key: str) -> tuple:
            ident, text, mine, own_key, marked = held
            changed = edited(text, following)
            other = canonical(changed)
            other_key = digest(other)
            return (
                ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), own_key, other_key,
                float(other_key == own_key and other == mine), float(key == own_key and canon == mine), pack(mine) if marked else None,
            )

        for batch in batches:
            for ident, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    flag = [ident]
                    continue
                canon = canonical(text)
                key = digest(canon)
                if held is not None:
                    out.append(closed(text, canon, key))
                held = (ident, text, canon, key, flag == [ident])
                if kind == 2:  # more guests can only share the id of the first
                    held = None
                    break
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out.clear()
            else:
                continue
            break
        for _ in batches:
            pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    shape = "id bigint, n_chars bigint, edited_sha256 string, fp string, edited_fingerprint string, near_edited double, near_next double, canon binary"
    done = staged(spark, stream.mapInArrow(run, shape), "fingerprints")
    clash = done.where("canon is not null").groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a != b").select("fp")
    if clash.isEmpty():
        return done.withColumn("fingerprint", F.col("fp")).drop("canon", "fp")
    marked = done.join(F.broadcast(clash.withColumn("clash", F.lit(True))) if clash.count() < 10_000 else clash.withColumn("clash", F.lit(True)), "fp", "left")
    return marked.withColumn("fingerprint", F.when(F.col("clash"), F.concat_ws("-", "fp", F.sha2("canon", 256))).otherwise(F.col("fp"))).drop("canon", "fp", "clash")
