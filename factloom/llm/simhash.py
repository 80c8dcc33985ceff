"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. Flipping one bit moves one count by
one, so the Manhattan distance of two count vectors is a lower bound of the Hamming distance. Two vectors within
distance 2 share a grid point within distance 1 of both: every distinct fingerprint is put on its own grid cell and on
the cells one step away (65 at most), cells are joined by equality, and the pairs that meet are verified on the
fingerprints themselves. Short segments make cells fine: of random pairs some 4 in 10^11 meet, with 16 segments of
four bits it would be 3 in 10^7, which at 10^9 fingerprints is more than all cells together. Exact copies meet before,
as equal fingerprints, so what is joined grows with distinct texts. All steps but the hashing of words are built-in
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import join_counted, no_null, ship, staged
from factloom.llm.components import connected_components

SEGMENTS = 32
MAX_BITS = 2
SEED = 42


_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(data):
        over = _SPACE.search(data, at + _PIECE) if len(data) - at > _PIECE else None
        end = over.start() if over else len(data)
        yield data[at:end].split()
        at = end


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; zero for a text without words (or null).

    Words are cut and hashed piece by piece: what is held of a very long text, beside the text, is one piece.
    """
    digest = xxhash.xxh64_intdigest
    counts, total, carried = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode().lower()):
        words = carried + words
        n = len(words) - shingle + 1
        if n > 0:
            hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)
            for at in range(0, n, 8192):
                counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += n
        carried = words[max(0, len(words) - shingle + 1) :]
    if not total:
        if not carried:
            return 0
        return digest(b" ".join(carried), SEED)  # fewer words than a shingle: their whole sequence
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprint_of_set(hashes: np.ndarray) -> int:
    """The SimHash of distinct shingle hashes, as a signed long; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the id column and the fingerprint as a signed long, for every row."""
    kept = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))
    kind = kept.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return kept.mapInArrow(run, f"id {kind.simpleString()}, fp bigint")


def grid_links(points: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints with 1 or 2 differing bits, from a column fp of distinct values.

    The counts are packed as they are: two bits a segment hold the values 0 to 2.
    """
    ones = F.lit(0x5555555555555555)
    high, low = F.shiftrightunsigned("fp", 1).bitwiseAND(ones), F.col("fp").bitwiseAND(ones)
    counts = high.bitwiseXOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))  # their sum, without a carry to the sign
    steps = F.array(*[F.struct(F.lit(s).cast("int").alias("seg"), F.lit(d).cast("int").alias("by")) for s, d in [(0, 0), *((s, d) for s in range(SEGMENTS) for d in (-1, 1))]])
    cells = (
        points.select("fp", counts.alias("own"))
        .select("fp", "own", F.explode(steps).alias("step"))
        .select(
            "fp",
            "own",
            F.expr("step.by").alias("by"),
            F.expr("step.seg").alias("seg"),
            F.expr("int(shiftrightunsigned(own, step.seg * 2) & 3) + step.by").alias("count"),
        )
        .where("count between 0 and 2")
        .select("fp", F.expr("(own & ~shiftleft(3L, seg * 2)) | shiftleft(bigint(count), seg * 2)").alias("cell"), F.expr("if(by = 0, 0, by * (seg + 1))").alias("step"))
    )
    a, b = (cells.select("cell", F.col("fp").alias(x), F.col("step").alias(f"s{x}")) for x in "ab")
    meet = "a < b and ((sa = 0) or (sa != 0 and sb != 0 and sa != sb))"
    # up to 65 cells a point, which Spark sizes as the points: without the hint it may broadcast them through the driver
    return a.join(b.hint("merge"), "cell").where(meet).where(f"bit_count(a ^ b) <= {MAX_BITS}").select("a", "b").distinct()


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, fp) for every row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id reachable over links of at most
    two differing bits, itself included. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows stay, rows with a null id get the component of their fingerprint (null when no row of it has an id),
    an empty table gives no rows. Extra columns are not read, whatever their names.
    """
    ship(spark)
    marked = staged(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = marked.groupBy("fp").agg(F.min("id").alias("rep"))
    links = staged(spark, grid_links(reps.select("fp")), "links")
    parts = connected_components(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # fingerprints are the nodes, so that one that only rows without an id have links others too
    placed = staged(spark, reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("part")), "parts")
    least = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    classes = staged(spark, placed.join(least, "part").join(marked.groupBy("fp").agg(F.count("*").alias("n")), "fp").select("fp", "component_id", "n"), "classes")
    return join_counted(marked, classes, ["fp"], "n").select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )


def simhash_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component: one document of each group stays.

    Rows that share an id count as one document. Rows with a null id have no name to be kept by: they stay.
    """
    out = simhash_components(spark, docs, id_col, text_col, shingle)
    gone = out.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
