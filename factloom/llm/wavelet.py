"""Token ids in wavelet-matrix shards: one compressed, indexed file per shard.

Format WVM2, little-endian: magic ``WVM2``; u32 length of a JSON header; header; directories; zstd frames. The header
holds n (tokens), levels (bit planes, most significant bit first), zeros (zero bits of each plane), docs (documents)
and frames (byte lengths of the last two). Directories, for each plane and each of its blocks of 2^16 bits and one
more: the frame's offset (u64) and the one bits before it (u64). Frames: one for each block of each plane (packed
bits, least significant first), one with the documents' end positions (u64), one with their ids (i64, then a byte
each that is 1 where the id is null). Access, rank (counting up to a position), counting and select (occurrence
lookup) read the directories and single blocks; a file is mapped, not read.
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import new_path, no_null, ship
from factloom.llm.bpe import loaded, read_spec
from factloom.llm.ordered import bucket, cuts, in_ranges

MAGIC = b"WVM2"
SHARD_TOKENS = 1 << 21
END_ID = 2
_BLOCK = 1 << 16
#: Blocks that an open shard keeps unpacked.
_KEPT = 64


def build(tokens: np.ndarray, ends: np.ndarray, ids: list[int | None] | None = None) -> bytes:
    """The file image of a shard: ``tokens`` of its documents, the end position and the id of each document."""
    now = np.ascontiguousarray(tokens, np.uint32)
    levels = max(1, int(now.max()).bit_length()) if len(now) else 1
    if levels <= 16:
        now = now.astype(np.uint16)
    pack = zstandard.ZstdCompressor(level=1).compress
    n, blocks = len(now), -(-len(now) // _BLOCK)
    frames, zeros = [], []
    offsets, ranks = np.zeros((levels, blocks + 1), "<u8"), np.zeros((levels, blocks + 1), "<u8")
    at = 0
    for plane, level in enumerate(range(levels - 1, -1, -1)):
        ones = ((now >> level) & 1).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        step = _BLOCK // 8
        ranks[plane, 1:] = np.cumsum(np.bitwise_count(np.pad(packed, (0, -len(packed) % step))).reshape(-1, step).sum(1, dtype=np.uint64)) if n else 0
        for b in range(blocks):
            offsets[plane, b] = at
            frames.append(pack(packed[b * step : (b + 1) * step].tobytes()))
            at += len(frames[-1])
        offsets[plane, blocks] = at
        zeros.append(int(n - np.count_nonzero(ones)))
        if level:
            now = np.concatenate([now[~ones], now[ones]])
    ids = ids if ids is not None else [None] * len(ends)
    names = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + bytes(int(i is None) for i in ids)
    last = [pack(np.asarray(ends, "<u8").tobytes()), pack(names)]
    head = json.dumps({"n": n, "levels": levels, "zeros": zeros, "docs": len(ends), "frames": [len(f) for f in last]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, offsets.tobytes(), ranks.tobytes(), *frames, *last])


class Shard:
    """A shard opened from its file image, or from a file with ``open``."""

    def __init__(self, image: bytes | memoryview | mmap.mmap) -> None:
        self._image = memoryview(image)
        if bytes(self._image[:4]) != MAGIC:
            raise ValueError("not a WVM2 shard")
        size = struct.unpack_from("<I", self._image, 4)[0]
        head = json.loads(bytes(self._image[8 : 8 + size]))
        self.n, self.levels, self.zeros, self.docs = head["n"], head["levels"], head["zeros"], head["docs"]
        shape = (self.levels, -(-self.n // _BLOCK) + 1)
        count = shape[0] * shape[1]
        self._offsets = np.frombuffer(self._image, "<u8", count, 8 + size).reshape(shape)
        self._ranks = np.frombuffer(self._image, "<u8", count, 8 + size + 8 * count).reshape(shape)
        self._base = 8 + size + 16 * count
        self._frames = head["frames"]
        self._blocks: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    @classmethod
    def open(cls, path: str) -> Shard:
        """Map a file; blocks are read when they are asked for."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _unpack(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(bytes(self._image[at : at + size]))

    @property
    def ends(self) -> np.ndarray:
        """End positions of the documents."""
        return np.frombuffer(self._unpack(self._base + int(self._offsets[-1, -1]), self._frames[0]), "<u8").astype(np.int64)

    @property
    def ids(self) -> list[int | None]:
        """Ids of the documents."""
        raw = self._unpack(self._base + int(self._offsets[-1, -1]) + self._frames[0], self._frames[1])
        return [None if gone else i for i, gone in zip(np.frombuffer(raw, "<i8", self.docs).tolist(), raw[8 * self.docs :])]

    def _frame(self, level: int, block: int) -> bytes:
        low, high = int(self._offsets[level, block]), int(self._offsets[level, block + 1])
        return self._unpack(self._base + low, high - low)

    def _block(self, level: int, block: int) -> np.ndarray:
        found = self._blocks.get((level, block))
        if found is None:
            found = self._blocks[level, block] = np.frombuffer(self._frame(level, block), np.uint8)
            if len(self._blocks) > _KEPT:
                self._blocks.popitem(last=False)
        else:
            self._blocks.move_to_end((level, block))
        return found

    def _bits(self, level: int) -> np.ndarray:
        whole = b"".join(self._frame(level, b) for b in range(self._offsets.shape[1] - 1))
        return np.unpackbits(np.frombuffer(whole, np.uint8), count=self.n, bitorder="little").view(bool)

    def _bit(self, level: int, at: int) -> int:
        return int(self._block(level, at // _BLOCK)[at % _BLOCK // 8]) >> at % 8 & 1

    def _rank1(self, level: int, at: int) -> int:
        """One bits of a plane before position ``at``."""
        block, inside = divmod(at, _BLOCK)
        found = int(self._ranks[level, block])
        if not inside:
            return found
        bits = self._block(level, block)
        found += int(np.bitwise_count(bits[: inside // 8]).sum())
        return found + (int(bits[inside // 8] & ((1 << inside % 8) - 1)).bit_count() if inside % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane: the block by the directory, then within it."""
        ranks = self._ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * _BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little")[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        """The token at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for level in range(self.levels):
            bit = self._bit(level, at)
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if token >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in positions low to high (exclusive)."""
        if token >> self.levels:
            return 0
        high = self.n if high is None else min(high, self.n)
        a, b = self._range(token, min(max(low, 0), high), high)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of a token; -1 if there are not so many."""
        if token >> self.levels:
            return -1
        a, b = self._range(token, 0, self.n)
        if k >= b - a:
            return -1
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens: the planes are undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = self._bits(level)
            before = np.empty_like(now)
            before[~ones] = now[: self.zeros[level]]
            before[ones] = now[self.zeros[level] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = before
        return now.astype("<u4")


def write_shards(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text, append ``end_id`` and write shards in ascending id order below ``path``.

    ``path`` gets a table with one row a shard: part and seq (their order), before (tokens of the part that come
    earlier), n_tokens, n_docs, and file. Where the driver's file system holds ``path`` (a folder that all machines
    mount), shards are WVM2 files beside the table, written under another name first; in other stores the file's bytes
    are in the row, in the column image. A part is a range of ids, sorted by id and then text, so that a retried task
    writes the same. Shards end with a document once they hold ``shard_tokens``; memory is that of one shard and the
    longest document. Null ids come first, null texts are empty, repeated rows are documents of their own, an empty
    table gives a table without rows, other columns are not read.
    """
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), no_null(text_col).alias("text"))
    at = cuts(spark, kept.select("id"), "id")
    parted = in_ranges(kept.withColumn("bucket", bucket(F.col("id"), at)), at, "id", "text").select("id", "text")
    end, folder = struct.pack("<I", end_id), _mounted(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(spec.value), TaskContext.get().partitionId()
        ids: list[int | None] = []
        found: list[bytes] = []
        held = before = seq = 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in found])
            image, name = build(np.frombuffer(b"".join(found), "<u4"), ends, ids), f"{part:06d}-{seq:06d}.wvm"
            if folder is not None:
                _put(f"{folder}/{name}", image)
            columns = [[part], [seq], [before], [held], [len(ids)], [name], [image if folder is None else None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        names = ["part", "seq", "before", "n_tokens", "n_docs", "file", "image"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                ids.append(batch.column(0)[k].as_py())
                found.append(bpe.encode_bytes(text.as_py()) + end)
                held += len(found[-1]) // 4
                if held >= shard_tokens:
                    yield shard()
                    before, seq, held = before + held, seq + 1, 0
                    ids.clear()
                    found.clear()
        if ids:
            yield shard()

    shards = parted.mapInArrow(run, "part int, seq bigint, before bigint, n_tokens bigint, n_docs bigint, file string, image binary")
    shards.write.parquet(f"{path}/{TABLE}")


#: The table of a folder of shards.
TABLE = "shards.parquet"


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder's name in the file system of the machines, None for other stores."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toUri().getPath() if system.getScheme() == "file" else None


def _put(path: str, content: bytes) -> None:
    """A file that is there in full or not at all, whoever else writes it at the same time."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(content)
    os.replace(draft, path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every document, from the written shards.

    start: tokens of all documents before it. A part's first token follows from the sums of the parts, of which
    there are as many as partitions; only these sums reach the driver. Null ids and repeated rows come back as they
    were written; a table without rows gives none.
    """
    ship(spark)
    shards, folder = spark.read.parquet(f"{path}/{TABLE}"), _mounted(spark, path)
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    first, total = {}, 0
    for part, n in sums:
        first[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, file, image = (batch.column(c)[k] for c in range(4))
                shard = Shard(image.as_buffer()) if folder is None else Shard.open(f"{folder}/{file.as_py()}")
                data = memoryview(shard.tokens().tobytes())
                ends = shard.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                base = first[part.as_py()] + before.as_py()
                columns = [pa.array(shard.ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "file", "image").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards (to the shared folder unless ``path`` is given) and read every document back from them.

    Null texts are empty, null ids come first, repeated rows are documents of their own, an empty table gives no rows,
    other columns are not read.
    """
    path = path or new_path(spark, "tokens")
    write_shards(spark, docs, path, tokenizer_path, id_col, text_col)
    return read_documents(spark, path)
