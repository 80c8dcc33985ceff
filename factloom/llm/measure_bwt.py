"""Times the merge of Burrows-Wheeler transforms on some documents: python -m factloom.llm.measure_bwt FILE.parquet [MB] [SHARDS].

Prints the seconds a byte for sorting the shards and for the merge as it is, and what the merge would take at least
if it dealt only rows that are not settled (in blocks of two or more): the same seconds a row, for those rows only.
"""

from __future__ import annotations

import sys
import time

import pyarrow.parquet as pq

from factloom.llm import bwt

LENGTH = 400


def measure(texts: list[bytes], shards: int) -> dict[str, float]:
    size = sum(map(len, texts)) + len(texts)
    began = time.process_time()
    parts = [bwt.shard(texts[k::shards], k) for k in range(shards)]
    sorted_at = time.process_time()
    merged = bwt.merge(parts, LENGTH)
    merged_at = time.process_time()
    whole = merged_at - sorted_at
    open_share = sum(merged.open_rows) / (LENGTH * size)
    return {
        "bytes": size, "sort_us_a_byte": 1e6 * (sorted_at - began) / size, "merge_us_a_byte": 1e6 * whole / size,
        "share_of_open_rows": open_share, "merge_of_open_rows_us_a_byte": 1e6 * whole * open_share / size,
    }


def main(argv: list[str]) -> None:
    limit, shards = float(argv[1]) * 1e6 if len(argv) > 1 else 4e6, int(argv[2]) if len(argv) > 2 else 4
    texts, held = [], 0
    for text in pq.read_table(argv[0], columns=["text"])["text"]:
        texts.append((text.as_py() or "").encode())
        held += len(texts[-1]) + 1
        if held >= limit:
            break
    print({k: round(v, 3) for k, v in measure(texts, shards).items()})


if __name__ == "__main__":
    main(sys.argv[1:])
