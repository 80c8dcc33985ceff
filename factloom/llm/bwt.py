"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard's transform comes from sorting its suffixes (each text ends with its own end mark). Shards are merged
without sorting again: an interleave vector says which shard each row of the merged transform comes from; one round
deals the vector out by the symbols that precede, a stable counting sort, after which rows are in the order of one
symbol more. Where a row first differs from the one above is its common prefix length, so after ``length`` rounds
the unbroken blocks are the intervals of suffixes that share ``length`` symbols.

Each round passes over all rows and all suffixes of a merge meet in one task, so this serves shards of bounded size;
``measure_bwt`` takes its figures, and the README says how whole tables are done.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """bwt: the symbol before each suffix (0: the text's end mark), suffixes in order; text and start of each suffix."""

    bwt: np.ndarray
    text: np.ndarray
    start: np.ndarray


@dataclass
class Merged:
    """The merged suffixes in the order of their first ``length`` symbols; heads: where that prefix changes."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    heads: np.ndarray
    length: int
    #: Rows in blocks of two or more, after each round: the least that a round has to deal.
    open_rows: list[int]


def shard(texts: list[bytes], first: int = 0) -> Shard:
    """The transform of some texts, numbered from ``first``; bytes are symbols 1 to 256.

    Suffixes are sorted by doubling the prefix that their ranks stand for; end marks differ, in the order of texts.
    """
    marks = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64) - 1
    total = int(marks[-1]) + 1 if len(texts) else 0
    symbol = np.zeros(total, np.int64)
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    symbol[:] = joined.astype(np.int64) + 1
    symbol[marks] = 0
    rank = symbol + len(texts)
    rank[marks] = np.arange(len(texts))
    step, order = 1, np.argsort(rank, kind="stable")
    while True:
        following = np.concatenate([rank[step:], np.zeros(min(step, total), np.int64)])[:total] if total else rank
        order = np.lexsort((following, rank))
        new = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (following[order][1:] != following[order][:-1]))]) if total else rank
        rank = np.empty(total, np.int64)
        rank[order] = new
        if not total or new[-1] == total - 1:
            break
        step *= 2
    text = np.searchsorted(marks, order)
    begin = np.concatenate([[0], marks[:-1] + 1]) if len(texts) else marks
    start = order - begin[text] if total else order
    before = np.where(start > 0, symbol[order - 1], 0) if total else order
    return Shard(before.astype(np.uint16), (first + text).astype(np.int64), start.astype(np.int64))


def merge(shards: list[Shard], length: int) -> Merged:
    """Refine the interleave ``length`` rounds; rows that end within that are blocks of their own."""
    sizes = [len(s.bwt) for s in shards]
    place = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)  # shard by shard: order of no symbol
    total = len(place)
    heads = np.zeros(total, bool)
    heads[:1] = True
    open_rows = []
    for _ in range(length):
        # the k-th row of a shard in the merged order is the k-th of its transform
        symbols = np.empty(total, np.uint16)
        for n, s in enumerate(shards):
            symbols[place == n] = s.bwt
        block = np.cumsum(heads)
        order = np.argsort(symbols, kind="stable")
        place, dealt, source = place[order], symbols[order], block[order]
        heads = np.concatenate([[True], (dealt[1:] != dealt[:-1]) | (source[1:] != source[:-1])])
        # end marks are all different
        heads |= dealt == 0
        open_rows.append(total - int((heads & np.append(heads[1:], True)).sum()))
    text, start, size = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, np.int64)
    for n, s in enumerate(shards):
        text[place == n], start[place == n] = s.text, s.start
    lengths = {int(t): 0 for t in text}
    for s in shards:
        for t in np.unique(s.text).tolist():
            lengths[t] = int(s.start[s.text == t].max())
    size = np.array([lengths[t] for t in text.tolist()], np.int64)
    return Merged(text, start, size, heads, length, open_rows)


def repeated_starts(merged: Merged) -> set[tuple[int, int]]:
    """(text, start) of every suffix whose first ``length`` symbols also begin another suffix."""
    block = np.cumsum(merged.heads) - 1
    whole = merged.size - merged.start >= merged.length
    counts = np.bincount(block[whole], minlength=int(block[-1]) + 1 if len(block) else 0)
    hit = whole & (counts[block] > 1) if len(block) else whole
    return set(zip(merged.text[hit].tolist(), merged.start[hit].tolist()))
