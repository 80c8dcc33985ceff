"""Removal of repeated 400-byte strings, exact, over a corpus of any size.

The method dealt for this operator, merging shard Burrows-Wheeler transforms, is in ``bwt.py``; the README says
why whole tables take the way below instead, with figures.

Every 400-byte window holds 201 anchors of 200 bytes. The window is known by its least anchor (by a hash; the
leftmost of equals), which depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets. The windows of a document that share an anchor are one run, about one for each 100 bytes, and only runs
leave the text:

1. Runs whose anchor occurs once hold no repeated window.
2. Runs of one anchor whose whole stretches of bytes are equal repeat each other in all their windows.
3. Where one anchor has several different stretches, one run for each is cut into blocks of 16 windows, and the
   same two tests are made with what all windows of a block hold, and with all their bytes.
4. In blocks that are still open, windows are compared one by one; those found twice or more are repeated.

Groups are counted and joined by hashes of contents, never listed: a passage of any number of documents is one
pre-aggregated row for each stretch inside it, and rows at its two ends. An anchor's and a stretch's (or window's)
64-bit hashes by different functions stand for the bytes, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import bitmap_of, held_in, join_counted, no_null, ship, staged

LENGTH = 400
ANCHOR = 200
BLOCK = 16
_WINDOW = LENGTH - ANCHOR + 1
_BASE = 0x9E3779B97F4A7C15
_INDEX_BITS = 20
_STEP = (1 << _INDEX_BITS) - 4 * LENGTH

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0], _powers[1]


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each position on."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _least_positions(h: np.ndarray) -> np.ndarray:
    """For each window of _WINDOW hashes, the position of the least (high bits; then the leftmost)."""
    mask = np.uint64((1 << _INDEX_BITS) - 1)
    keys = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    padded = np.concatenate([keys, np.full(-len(keys) % _WINDOW, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, _WINDOW)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - _WINDOW + 1
    return (np.minimum(back[:n], ahead[_WINDOW - 1 : _WINDOW - 1 + n]) & mask).astype(np.int64)


def runs_of(data: bytes) -> list[tuple[np.ndarray, ...]]:
    """(anchor hash, stretch hash, anchor position, windows' first start, last start), as arrays, piece by piece."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, _STEP):  # bounded memory for very long texts
        piece = np.frombuffer(data, np.uint8, min(_STEP + LENGTH - 1, len(data) - at), at)
        h = _anchor_hashes(piece)
        least = _least_positions(h)
        low = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        high = np.concatenate([low[1:] - 1, [len(least) - 1]])
        place = least[low]
        whole = memoryview(data)[at : at + len(piece)]
        stretch = np.fromiter((xxhash.xxh3_64_intdigest(whole[a : b + LENGTH]) for a, b in zip(low.tolist(), high.tolist())), np.uint64, len(low))
        out.append((h[place].view(np.int64), stretch.view(np.int64), place + at, low + at, high + at))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): a document goes by the hashes of its id and its text, which are never null."""
    return docs.select(F.xxhash64("id").alias("doc"), F.xxhash64("text").alias("mark"), "text")


def _parted(spark: SparkSession, rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the documents (doc, mark) in ``keys`` and perhaps some more, and all other rows, without a shuffle."""
    one = F.xxhash64("doc", "mark").alias("h")
    bitmap = spark.sparkContext.broadcast(bitmap_of(keys.select(one)))

    def part(held: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                kept = batch.select(range(batch.num_columns - 1)).filter(pa.array(held_in(bitmap.value, h) == held))
                if kept.num_rows:
                    yield kept

        return rows.withColumn("h", one).mapInArrow(run, rows.schema)

    return part(True), part(False)


def _unpacked(batch: pa.RecordBatch, k: int) -> tuple:
    """Text, and arrays of the open pieces of row k: anchor hash, anchor position, start's distance to it, windows - 1, open."""
    data = memoryview(batch.column(2)[k].as_buffer().to_pybytes())
    packed = np.asarray(batch.column(4)[k].values, np.int64)
    return data, np.asarray(batch.column(3)[k].values, np.int64), packed >> 21, packed >> 11 & 1023, packed >> 1 & 1023, (packed & 1).astype(bool)


def _resolved(spark: SparkSession, pieces: DataFrame, core: list[str]) -> tuple[DataFrame, DataFrame]:
    """What equal hulls settle, and what is left: (doc, mark, span) and (doc, mark, pieces).

    A piece is a row of windows; all its windows hold its core (bytes that the columns ``core`` stand for), and its
    hull is all their bytes. Equal windows have equal cores, so a core that occurs once settles its piece: nothing
    is repeated. Equal hulls of equal extent settle theirs: all is. Where a core has different hulls, one piece for
    each goes on; it is open if its own windows are still to be settled, otherwise others are compared with it.
    """
    hull = [*core, "hull", "a", "b"]
    again = staged(spark, pieces.groupBy(*core).agg(F.count("*").alias("n")).where("n > 1"), "repeated-cores")
    dup = staged(spark, join_counted(pieces, again, core, "n").drop("n"), "repeated-pieces")
    groups = staged(
        spark, dup.groupBy(*hull).agg(F.count("*").alias("n"), F.max("open").alias("any_open"), F.min(F.struct("doc", "mark", "at")).alias("first")), "hulls"
    ).withColumn("open", F.expr("n = 1 and any_open"))
    settled = join_counted(dup.where("open"), groups.where("n > 1").select(*hull, "n"), hull, "n").select("doc", "mark", F.expr("shiftleft(bigint(at - a), 12) | (b + %d)" % LENGTH).alias("span"))
    several = staged(spark, groups.groupBy(*core).agg(F.count("*").alias("m"), F.max("open").alias("some")).where("m > 1 and some").select(*core, "m"), "open-cores")
    packed = F.expr("shiftleft(bigint(first.at), 21) | shiftleft(bigint(a), 11) | shiftleft(bigint(b), 1) | int(open)")
    left = join_counted(groups, several, core, "m").select("first.doc", "first.mark", "anchor", packed.alias("piece"))
    return settled, staged(spark, left.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "piece")).alias("pieces")), "open-pieces")


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (an array of start, end: the maximal removed runs in bytes, in order), kept (the other bytes) for every row.

    Bytes covered by a LENGTH-byte string that also starts anywhere else in the table, the same document included,
    are removed, judged on the input. A run may end inside a character, so ``kept`` is bytes. Null texts are empty;
    rows that share an id are documents of their own, equal rows repeat each other; null ids stay; an empty table
    gives no rows; other columns are not read.
    """
    ship(spark)
    kept = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "mark", "anchor", "hull", "at", "a", "b", "open"]
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(2)):
                for part in runs_of(text.as_buffer().to_pybytes()):
                    rows.append(np.full(len(part[0]), k))
                    found.append(part)
            if rows:
                take = pa.array(np.concatenate(rows))
                anchor, stretch, place, low, high = (np.concatenate(c) for c in zip(*found))
                columns = [anchor, stretch, place.astype(np.int32), (place - low).astype(np.int16), (high - low).astype(np.int16), np.ones(len(anchor), bool)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)], names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "mark", "anchor", "core", "hull", "at", "a", "b", "open"]
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for k in range(batch.num_rows):
                data, anchors, place, a, b, solo = _unpacked(batch, k)
                first, last = (a - b) // BLOCK, a // BLOCK
                which = np.repeat(np.arange(len(a)), last - first + 1)
                step = np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
                inner = (first[which] + step) * BLOCK  # the block's least distance to the anchor
                far = np.minimum(a[which], inner + BLOCK - 1)
                near = np.maximum((a - b)[which], inner)
                at = place[which]
                core = [digest(data[p - i : p - i - BLOCK + 1 + LENGTH]) for p, i in zip(at.tolist(), inner.tolist())]
                hull = [digest(data[p - f : p - n + LENGTH]) for p, f, n in zip(at.tolist(), far.tolist(), near.tolist())]
                take = pa.array(np.full(len(which), k))
                hashes = [np.array(x, np.uint64).view(np.int64) for x in (core, hull)]
                columns = [anchors[which], *hashes, at.astype(np.int32), far.astype(np.int16), (far - near).astype(np.int16), solo[which]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "mark", "anchor", "window", "start", "open"]
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for k in range(batch.num_rows):
                data, anchors, place, a, b, solo = _unpacked(batch, k)
                count = b + 1
                which = np.repeat(np.arange(len(a)), count)
                start = np.repeat(place - a, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                window = np.array([digest(data[s : s + LENGTH]) for s in start.tolist()], np.uint64).view(np.int64)
                take = pa.array(np.full(len(start), k))
                columns = [anchors[which], window, start.astype(np.int32), solo[which]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)], names)

    def looked_at(todo: DataFrame, by, shape: str) -> DataFrame:
        """The open pieces, with their documents' texts, by one of the functions above."""
        # equal rows are one here: the join and the aggregation part the texts by the same two columns, in one shuffle
        texts, _ = _parted(spark, _texts(kept), todo)
        ready = texts.join(todo, ["doc", "mark"]).dropDuplicates(["doc", "mark"]).select("doc", "mark", "text", "pieces.anchor", "pieces.piece")
        return staged(spark, ready.mapInArrow(by, f"doc bigint, mark bigint, {shape}"), "pieces")

    long_enough = _texts(kept.where(F.octet_length("text") >= LENGTH))
    runs = staged(spark, long_enough.mapInArrow(find, "doc bigint, mark bigint, anchor bigint, hull bigint, at int, a smallint, b smallint, open boolean"), "runs")
    whole, todo = _resolved(spark, runs, ["anchor"])
    parts = looked_at(todo, blocks, "anchor bigint, core bigint, hull bigint, at int, a smallint, b smallint, open boolean")
    more, todo = _resolved(spark, parts, ["anchor", "core"])
    rows = looked_at(todo, windows, "anchor bigint, window bigint, start int, open boolean")
    twice = staged(spark, rows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1"), "repeated-windows")
    single = join_counted(rows.where("open"), twice, ["anchor", "window"], "n").select("doc", "mark", F.expr("shiftleft(bigint(start), 12) | %d" % LENGTH).alias("span"))
    spans = staged(spark, whole.unionByName(more).unionByName(single).groupBy("doc", "mark").agg(F.collect_list("span").alias("spans")), "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, sizes, left = [], [], [0], []
            for k, found in enumerate(batch.column(2)):
                data = memoryview(batch.column(1)[k].as_buffer().to_pybytes())
                low = high = np.zeros(0, np.int64)
                if found.is_valid:  # else one that only the bitmap took in
                    packed = np.sort(np.asarray(found.values, np.int64))
                    low, high = packed >> 12, np.maximum.accumulate((packed >> 12) + (packed & 4095))
                    heads = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                    low, high = low[heads], high[np.concatenate([heads[1:] - 1, [len(high) - 1]])]
                starts.append(low)
                ends.append(high)
                sizes.append(len(low))
                left.append(b"".join(data[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)])))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (starts, ends)], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(left, pa.binary())], ["id", "spans", "kept"])

    touched, others = _parted(spark, kept.select("id", F.xxhash64("id").alias("doc"), F.xxhash64("text").alias("mark"), "text"), spans)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    whole = others.select("id", none, F.col("text").cast("binary").alias("kept"))
    cut = touched.join(spans, ["doc", "mark"], "left").select("id", "text", "spans")
    return cut.mapInArrow(remove, whole.schema).unionByName(whole)


def digests() -> list[Column]:
    """n_bytes, n_removed, n_spans, kept_sha256 of the rows of ``without_repeats``."""
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    sha = F.sha2("kept", 256).alias("kept_sha256")
    return [(F.octet_length("kept") + gone).alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), sha]


def repeated_strings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``, of what ``without_repeats`` gives."""
    return without_repeats(spark, docs, id_col, text_col).select("id", *digests())
