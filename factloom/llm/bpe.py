"""BPE by per-prefix dynamic programming, and decoding.

A sequence of tokens is what BPE makes of a word exactly when each token stands for itself and every
neighbouring pair is compatible (BPE of the joined pair gives the pair back). So each prefix of a word has one
last token that is compatible with the last token of the prefix before it. Tokens that end at a prefix come
from an automaton of the vocabulary's suffixes (Aho-Corasick: its failure links lead from each matched string to the
longest suffix that a token begins with, so it yields every token that ends there); the unique last token is stored for every prefix, and the
ids are read off by following the back-pointers from the end. Normalisation and splitting into words are those
of the tokenizer file. The results of words are kept in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm._common import no_null, ship

#: Stands for the end-of-word suffix; no byte-level symbol uses it.
_END = "￿"
_CACHED, _CACHED_CHARS = 1_000_000, 64

#: The steps of a tokenizer file that ``_words`` can do for plain letters.
_USUAL = [
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
]
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]+")
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


class UnsupportedTokenizer(ValueError):
    """A tokenizer file with something that this encoder would answer differently."""


def _refuse(data: dict) -> None:
    """Raise for files other than byte-level BPE whose vocabulary has every byte, and for settings that change results."""
    model = data["model"]
    wrong = []
    if model.get("type", "BPE") != "BPE":
        wrong.append(f"model {model.get('type')}")
    wrong += [f"model setting {k}" for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    suffix = model.get("end_of_word_suffix") or ""
    lacking = [c for c in _BYTE_CHARS for x in dict.fromkeys((c, c + suffix)) if x not in model["vocab"]]
    if lacking:
        wrong.append(f"{len(lacking)} bytes without a symbol")
    steps = data.get("pre_tokenizer") or {}
    if not any(x.get("type") == "ByteLevel" for x in steps.get("pretokenizers", [steps])):
        wrong.append("no byte-level pre-tokenizer")
    wrong += [f"added token {t['content']}" for t in data.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if wrong:
        raise UnsupportedTokenizer("not supported: " + ", ".join(wrong))


class PrefixBPE:
    """Encoder for a ``tokenizers`` file with a byte-level BPE model with (or without) an end-of-word suffix; other files are refused."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        _refuse(data)
        model = data["model"]
        self._tokenizer = Tokenizer.from_str(spec)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._suffix = model.get("end_of_word_suffix") or ""
        vocab = {self._inner(t): i for t, i in model["vocab"].items()}
        self._rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = (self._inner(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self._rank[vocab[left], vocab[right]] = (n, vocab[left + right])
        self._text_of = {i: t for t, i in model["vocab"].items()}
        self._special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self._text_of.update({i: t for t, i in self._special.items()})
        self._special_at = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._automaton = ahocorasick.Automaton()
        self._parts: dict[int, tuple[int, int, int]] = {}
        for t, i in vocab.items():
            symbols = self._split(t)
            if all(s in vocab for s in symbols):
                left, last = self._last_merge([vocab[s] for s in symbols])
                if left == [i]:  # entries that BPE never makes of their own text stand for nothing
                    self._automaton.add_word(t, (len(t), i))
                    if last:
                        self._parts[i] = last
        self._automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._spines: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        self._ids: dict[str, bytes] = {}
        self._texts: dict[bytes, str] = {}
        steps = [(data.get("normalizer") or {}).get("normalizers"), (data.get("pre_tokenizer") or {}).get("pretokenizers")]
        self._usual = steps == _USUAL
        self._plain_decoding = data.get("decoder") is None

    def _inner(self, token: str) -> str:
        return token[: -len(self._suffix)] + _END if self._suffix and token.endswith(self._suffix) else token

    @staticmethod
    def _split(token: str) -> list[str]:
        body = token.removesuffix(_END)
        return [*body[:-1], token[len(body) - 1 :]] if body else [token]

    def _last_merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Plain BPE on a vocabulary entry's symbols: what is left, and the last merge (rank, left, right)."""
        ids, last = list(ids), None
        while len(ids) > 1:
            best = min(((self._rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self._rank), default=None)
            if best is None:
                break
            k = best[1]
            last = (best[0], ids[k], ids[k + 1])
            ids[k : k + 2] = [self._rank[ids[k], ids[k + 1]][1]]
        return ids, last

    def _spine(self, token: int, side: int) -> tuple[list[int], list[float]]:
        """Symbols at a token's left (0) or right (1) edge from its smallest part up, and the rank that ends each."""
        found = self._spines.get((token, side))
        if found is None:
            nodes, ends = [token], [math.inf]
            while nodes[-1] in self._parts:
                rank, *pair = self._parts[nodes[-1]]
                nodes.append(pair[side])
                ends.append(rank)
            found = self._spines[token, side] = nodes[::-1], ends[::-1]
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' symbols gives the two back: no merge takes place across their border.

        Merges run by rank, equal ranks from the left. At any time the border lies between the left token's last
        symbol and the right token's first; a merge across happens if its rank comes before what ends either.
        """
        found = self._pairs.get((left, right))
        if found is None:
            a, a_ends = self._spine(left, 1)
            b, b_ends = self._spine(right, 0)
            i = j = 0
            while True:
                rank = self._rank.get((a[i], b[j]))
                if rank is not None and rank[0] < a_ends[i] and rank[0] <= b_ends[j]:
                    found = False
                    break
                if a_ends[i] == b_ends[j] == math.inf:
                    found = True
                    break
                if a_ends[i] <= b_ends[j]:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) < _CACHED:
                self._pairs[left, right] = found
        return found

    def word(self, piece: str) -> list[int]:
        """Ids of one byte-level word, by the last token of each prefix."""
        marked = piece + _END if self._suffix else piece
        last: list[int] = [-1] * (len(marked) + 1)
        size = [0] * (len(marked) + 1)
        pairs = self._pairs
        for at, (length, token) in self._automaton.iter(marked):
            end = at + 1
            if last[end] < 0:
                start = end - length
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = pairs.get((before, token))
                    if not (self._compatible(before, token) if fits is None else fits):
                        continue
                last[end], size[end] = token, length
        ids, end = [], len(marked)
        while end > 0:
            if not size[end]:
                raise UnsupportedTokenizer(f"no token ends at {end} of {piece!r}")
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def _keep(self, piece: str, ids: list[int]) -> bytes:
        """The ids as bytes; kept while there is room, so that the frequent words stay."""
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self._ids) < _CACHED and len(piece) <= _CACHED_CHARS:
            self._ids[piece] = found
        return found

    def _plain_piece(self, piece: str) -> bytes:
        return self._keep(piece, self.word(piece if piece.isascii() else "".join([_BYTE_CHARS[b] for b in piece.encode()])))

    def _words(self, text: str | None) -> list[bytes]:
        """The ids of each word of a text.

        Letters whose lower case and class never change between Unicode versions are lowered and split here by the
        tokenizer's own pattern, if the file has the usual steps; other texts take the library's steps.
        """
        if not text:
            return []
        if self._usual and "<|" not in text and _PLAIN.fullmatch(text):
            get, make = self._ids.get, self._plain_piece
            return [get(p) or make(p) for p in _PLAIN_PIECES.findall(text.lower())]
        found = []
        for part in self._special_at.split(text) if self._special_at else [text]:
            if part in self._special:
                found.append(struct.pack("<I", self._special[part]))
            else:
                # with the usual steps white space separates words before anything else, so chunks are independent and can be short
                for chunk in [x.decode() for x in part.encode().split()] if self._usual else [part]:
                    plain = self._tokenizer.normalizer.normalize_str(chunk) if self._tokenizer.normalizer else chunk
                    found += [struct.pack(f"<{len(ids)}I", *ids) for piece, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(plain) for ids in [self.word(piece)]]
        return found

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(self._words(text))

    def _text(self, ids: bytes) -> str:
        found = " ".join([self._text_of[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])
        if len(self._texts) < _CACHED and len(ids) <= 4 * _CACHED_CHARS:
            self._texts[ids] = found
        return found

    def both(self, text: str | None) -> tuple[bytes, str]:
        """Ids as bytes, and the decoded text."""
        words = self._words(text)
        if not self._plain_decoding:
            ids = b"".join(words)
            return ids, self.decode(np.frombuffer(ids, "<u4").tolist())
        get, make = self._texts.get, self._text
        return b"".join(words), " ".join([get(w) or make(w) for w in words])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: without a decoder the tokens, joined by blanks."""
        if not self._plain_decoding:
            return self._tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(self._text_of[i] for i in ids if i in self._text_of)


_LOADED: dict[str, PrefixBPE] = {}


def loaded(spec: str) -> PrefixBPE:
    """One encoder for each tokenizer in a worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PrefixBPE(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read once on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_roundtrip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of every whole text as little-endian u32 bytes, and the decoded text.

    Null and empty texts give no ids and an empty text. Every row is answered on its own: repeated rows and
    null ids stay, an empty table gives no rows, other columns are not read.
    """
    return _encoded(spark, docs, tokenizer_path, id_col, text_col, False)


def bpe_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what ``bpe_roundtrip`` returns, made where it is made.

    ``with_ids`` adds the ids themselves, as the column ids.
    """
    return _encoded(spark, docs, tokenizer_path, id_col, text_col, True, with_ids)


def _encoded(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, digest: bool, with_ids: bool = True) -> DataFrame:
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    kept = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # keeps decoded texts small in memory
                batch = whole.slice(at, 512)
                done = (bpe.both(t.as_py()) for t in batch.column(1))
                if digest:
                    rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest(), *[i] * with_ids) for i, d in done]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
                else:
                    ids, texts = zip(*done)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    shape = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids if digest else "ids binary, decoded string"
    return kept.mapInArrow(run, f"id {kind}, {shape}")
