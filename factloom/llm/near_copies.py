"""Near copies by SimHash, checked by the Jaccard similarity of five-word shingles: pairs that reach 0.8 are linked, and no others.

First the SimHash fingerprints of the texts' shingles meet as in ``simhash.py``: by the popcounts of their segments,
on the cells of the grid. Texts of fingerprints that differ in two bits at most are compared on their whole sets, and
those that reach 0.8 are one part. Fingerprints alone lose pairs (README), so an exact check follows for all that are
then still of different parts.

The set of a text's shingle hashes is a fingerprint of 2^64 bits, of which 256 segments are counted: the Manhattan
distance of two such counts is a lower bound of the number of differing bits, and a pair whose bound already rules a
similarity of 0.8 out goes no further. That is the segment-popcount embedding of ``simhash.py`` with the whole set
instead of 64 voted bits, which cannot tell all such pairs (README). Pairs meet by a prefix filter, which loses none:
two sets of that similarity share a member among their first s - ceil(0.8 s) + 1 of s members, in any order that is
the same for all texts. Members that a sample of the texts holds often go last, so that few texts meet on a common
one; the sample changes the work, never the result. The place of a shared member bounds what two texts share from it on,
which the first that they share must leave possible. Pairs left are compared on their whole sets.

Texts with equal sets are one node before. Groups of many near copies are not compared pair by pair: as long as there
is much to compare, texts that meet on a member are compared with one of them, a hub, and linked texts are one part;
only texts of different parts are compared then, all of those that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import bitmap_of, held_in, join_counted, no_null, scratch, ship, staged
from factloom.llm.components import connected_components
from factloom.llm.simhash import fingerprint_of_set, grid_links

SHINGLE = 5
SEED = 42
#: One text of so many is in the sample; so many of its repeated shingles are ordered by frequency.
SAMPLE, RANKED = 16, 100_000
BINS = 256


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; words are cut and folded as for fingerprints. A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n).view(np.int64))


def _node(members: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64))


def _bins(members: np.ndarray) -> bytes | None:
    """How many members are in each bin, a byte each; None where a byte does not hold them, and nothing is known."""
    counts = np.bincount((members.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _prefix(members: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The members on which a text meets others: those the sample does not repeat, then by frequency, then by hash."""
    n = len(members)
    at = np.searchsorted(common, members)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(at, len(common) - 1)
        rank = np.where(common[at] == members, times[at], 0)
    return members[np.lexsort((members, rank))[: n - (4 * n + 4) // 5 + 1]] if n else members


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Repeated shingles of a sample of the texts, sorted, and how many of its texts hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()))], ["member"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counted = sample.mapInArrow(run, "member bigint").groupBy("member").agg(F.count("*").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "member").limit(RANKED).collect()
    found = np.array(sorted((r["member"], r["n"]) for r in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def _nodes(docs: DataFrame, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """(id, hashed, node, fp, size, bins, prefix) for every row; docs has the columns id and text."""
    kind = docs.schema["id"].dataType.simpleString()
    kept = docs.select("id", F.xxhash64("text").alias("hashed"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            prefixes = pa.array([_prefix(s, common, times) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(_node, sets), pa.int64()), pa.array(map(fingerprint_of_set, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(map(_bins, sets), pa.binary()), prefixes],
                ["id", "hashed", "node", "fp", "size", "bins", "prefix"],
            )

    return kept.mapInArrow(run, f"id {kind}, hashed bigint, node bigint, fp bigint, size int, bins binary, prefix array<bigint>")


#: Up to so many wanted texts are known by a broadcast of their hashes, more by a bitmap.
BROADCAST_ROWS = 100_000


def _sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members) for each distinct set of the texts whose hash is in ``wanted``, and perhaps some more; no text is shuffled."""
    hashed = docs.select(F.xxhash64("text").alias("hashed"), "text")
    few = wanted.count() <= BROADCAST_ROWS
    bitmap = None if few else spark.sparkContext.broadcast(bitmap_of(wanted))
    some = hashed.join(F.broadcast(wanted), "hashed", "left_semi") if few else hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(pa.array(held_in(bitmap.value, batch.column(0).to_numpy(zero_copy_only=False))))
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])

    return some.mapInArrow(run, "node bigint, members array<bigint>").dropDuplicates(["node"])


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs`` (u, v) with the ``value`` that ``table`` has for each end, as ``value``_u and ``value``_v.

    The sides are staged tables, so a hub, which is in many pairs, can be split by adaptive execution.
    """
    u, v = (table.select(F.col("node").alias(x), F.col(value).alias(f"{value}_{x}")) for x in "uv")
    return pairs.join(u, "u").join(v, "v")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v, pu, pv) whose counts in bins leave a similarity of 0.8 possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for n, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if x is not None and y is not None:
                    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    keep[n] = 9 * np.minimum(a, b).sum(dtype=np.int64) >= 4 * (a.sum(dtype=np.int64) + b.sum(dtype=np.int64))
            yield batch.select(_PAIR).filter(pa.array(keep))

    known = _beside(pairs, nodes, "bins")
    return known.select(*_PAIR, "bins_u", "bins_v").mapInArrow(run, ", ".join(f"{c} bigint" for c in _PAIR))


_PAIR = ["u", "v", "pu", "pv"]
#: Hubs are tried while pairs of different parts are more than so many for each row, in so many rounds at most.
PAIRS_A_ROW, HUB_ROUNDS = 8, 4


def _verified(spark: SparkSession, docs: DataFrame, marked: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v, and their parts pu, pv) whose sets have a similarity of 0.8 or more."""
    pairs = staged(spark, _possible(staged(spark, pairs, "met"), nodes), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = staged(spark, marked.select("node", "hashed").distinct().join(ends, "node", "left_semi").select("hashed").distinct(), "wanted")
    sets = staged(spark, _sets(spark, docs, wanted), "sets")
    met = _beside(pairs, sets, "members")
    return staged(spark, met.where("9 * size(array_intersect(members_u, members_v)) >= 4 * (size(members_u) + size(members_v))").select(*_PAIR), "links")


def _repeated(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(member, node, size, pos, part): the prefix members that several nodes hold, and their place; each node is a part of its own."""
    counts = nodes.select(F.explode("prefix").alias("member")).groupBy("member").agg(F.count("*").alias("n"))
    again = staged(spark, counts.where("n > 1"), "repeated-members")
    bitmap = spark.sparkContext.broadcast(bitmap_of(again.select("member")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(lists.value_lengths())
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            pos = (np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            members = np.asarray(lists.flatten(), np.int64)
            kept = held_in(bitmap.value, members)
            take = pa.array(rows[kept])
            yield pa.RecordBatch.from_arrays([pa.array(members[kept]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos[kept])], ["member", "node", "size", "pos"])

    some = staged(spark, nodes.select("node", "size", "prefix").mapInArrow(run, "member bigint, node bigint, size int, pos int"), "members")
    return join_counted(some, again, ["member"], "n").select("member", "node", "size", "pos", F.col("node").alias("part"))


def _parted(spark: SparkSession, held: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``held`` with fewer parts: a part goes by the name of the largest that a link leads to, if that is larger.

    One step only: parts with one name are linked through it, so a part always lies in one component, and that is
    all that is asked of parts.
    """
    counts = staged(spark, held.groupBy("part").agg(F.count("*").alias("n")), "part-sizes")
    both = links.select(F.col("pu").alias("part"), F.col("pv").alias("new")).unionByName(links.select(F.col("pv").alias("part"), F.col("pu").alias("new"))).distinct()
    led = both.join(counts.select(F.col("part").alias("new"), F.col("n").alias("new_n")), "new")
    most = led.groupBy("part").agg(F.max(F.struct(F.col("new_n").alias("n"), F.col("new").alias("to"))).alias("b"))
    own = F.struct("n", F.col("part").alias("to"))
    moves = staged(spark, counts.join(most, "part", "left").select("part", "n", F.greatest("b", own)["to"].alias("new")), "moves")
    return staged(spark, join_counted(held, moves, ["part"], "n").select("member", "node", "size", "pos", F.col("new").alias("part")), "shared")


def _near_fingerprints(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(u, v, pu, pv): pairs of nodes to compare by their fingerprints: the least node of one with its others, and the
    least nodes of two that differ in two bits at most."""
    points = staged(spark, nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "points")
    same = join_counted(nodes.select("node", "fp"), points, ["fp"], "n").where("node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    links = staged(spark, grid_links(points.select("fp")), "near-points")
    a, b = (points.select(F.col("fp").alias(x), F.col("rep").alias(to)) for x, to in (("a", "u"), ("b", "v")))
    near = links.join(a, "a").join(b, "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return same.unionByName(near).select("u", "v", F.col("u").alias("pu"), F.col("v").alias("pv"))


def _links(spark: SparkSession, docs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links of different nodes with a similarity of 0.8 or more: not all, but enough for the same components."""
    with scratch(spark) as made:
        shared = staged(spark, _repeated(spark, nodes), "shared")
        made.keep()
    with scratch(spark) as made:
        found = _verified(spark, docs, marked, nodes, _near_fingerprints(spark, nodes))
        made.keep()
        shared = _parted(spark, shared, found)
        made.keep()
    for n in range(HUB_ROUNDS + 1):
        links, shared, last = _round(spark, docs, marked, nodes, shared, n)
        found = found.unionByName(links)
        if last:
            break
    return found.select("u", "v")


def _round(spark: SparkSession, docs: DataFrame, marked: DataFrame, nodes: DataFrame, shared: DataFrame, n: int) -> tuple[DataFrame, DataFrame, bool]:
    """Links of one round, the members with the parts that they make, and whether no pair is left; what else was staged goes."""
    with scratch(spark) as made:
        # members on which texts of different parts meet; the largest part of a member meets only the others
        parts, n_ = shared.groupBy("member", "part").agg(F.count("*").alias("n")), F.col("n").cast("double")
        cross = parts.groupBy("member").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "part")).alias("most"), (F.sum(n_) * F.sum(n_) - F.sum(n_ * n_)).alias("pairs")).where("pairs > 0")
        cross = staged(spark, cross.select("member", "rows", F.col("most.part").alias("major"), F.col("most.n").alias("major_rows"), "pairs"), "cross")
        row = cross.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
        last = n == HUB_ROUNDS or (row["pairs"] or 0) <= 2 * PAIRS_A_ROW * (row["rows"] or 0)
        held = staged(spark, join_counted(shared, cross, ["member"], "rows").select("member", "node", "size", "pos", "part", (F.col("part") == F.col("major")).alias("in_major"), "major_rows", "rows"), "held")
        if last:
            u, v = (held.select("member", F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("pos").alias(f"i{x}"), F.col("part").alias(f"p{x}"), F.col("in_major").alias(f"m{x}")) for x in "uv")
            met = u.where("not mu").join(v, "member").where("pu != pv and (mv or u < v)")
        else:
            # of a member's largest part, four times as many texts each round: only the texts of other parts are compared with them
            some = F.col("in_major") & (F.pmod(F.xxhash64("node", F.lit(n)), F.greatest(F.lit(1), F.col("major_rows") / 4**n).cast("bigint")) == 0)
            hubs = held.where(some).select("member", F.struct("node", "size", "pos", "part").alias("hub"), "rows")
            met = join_counted(held.where("not in_major").drop("rows"), staged(spark, hubs, "hubs"), ["member"], "rows")
            met = met.select(F.col("node").alias("u"), F.col("hub.node").alias("v"), F.col("size").alias("su"), F.col("hub.size").alias("sv"), F.col("pos").alias("iu"), F.col("hub.pos").alias("iv"), F.col("part").alias("pu"), F.col("hub.part").alias("pv"))
        # the first member that a pair shares has all that it shares at or after it; a pair that reaches 0.8 passes there
        met = met.where("5 * least(su, sv) >= 4 * greatest(su, sv) and 9 * least(su - iu, sv - iv) >= 4 * (su + sv)").withColumn("turn", F.expr("u > v"))
        ends = [F.expr(f"if(turn, {y}, {x})").alias(name) for name, x, y in (("u", "u", "v"), ("v", "v", "u"), ("pu", "pu", "pv"), ("pv", "pv", "pu"))]
        links = _verified(spark, docs, marked, nodes, met.select(*ends).distinct())
        made.keep()
        if not last:
            # parts only grow, so a member on which no different parts meet is done with
            shared = _parted(spark, held, links)
            made.keep()
        return links, shared, last


def near_copy_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row: the smallest id reachable over links of similarity 0.8 or more.

    Texts with equal sets, empty ones among them, are linked. Rows with a null id link others and have a component.
    Repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    ship(spark)
    kept = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))
    with scratch(spark) as made:
        whole = staged(spark, _nodes(kept, *_frequent(kept)), "whole")
        marked = staged(spark, whole.select("id", "hashed", "node"), "marked")
        nodes = staged(spark, whole.select("node", "fp", "size", "bins", "prefix").dropDuplicates(["node"]), "nodes")
        made.keep(1)
    with scratch(spark) as made:
        parts = connected_components(spark, _links(spark, kept, marked, nodes))
        # copies are many rows of one node, and a part may hold most rows: both are known by their counts
        own = marked.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")).join(parts, "node", "left").select("node", "n", "least", F.coalesce("component", "node").alias("part"))
        own = staged(spark, own, "own")
        by_part = staged(spark, own.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "by-part")
        found = staged(spark, join_counted(own, by_part, ["part"], "m").select("node", "n", "component_id"), "components")
        made.keep()
    return join_counted(marked, found, ["node"], "n").select("id", "component_id")


def near_copy_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows that share an id count as one document, rows with a null id stay, an empty table gives no rows.
    """
    out = near_copy_components(spark, docs, id_col, text_col)
    gone = out.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
