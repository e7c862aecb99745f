"""Packing (operator 1): Karmarkar-Karp multiway differencing over document pieces.

Documents longer than a window give full windows first. What is left is cut into
pieces of at most `piece` tokens, so that a window holds several, and a block of
them is dealt to k windows by multiway differencing: the two partial partitions with
the largest imbalance are merged, largest sums against smallest, until one is left.
If a window then exceeds the capacity, k rises and the block is dealt again.

There is no shuffle: blocks are made inside each input partition. Sequence ids are
the partition number in the high bits and a counter in the low 33.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cirro.llm.wordtok import word_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k bins with near-equal sums, by Karmarkar-Karp multiway differencing.

    A partial partition is kept as its non-empty bins, by falling sum; the other k - m bins are empty.
    """
    tie = count()
    heap: list[tuple] = [(-s, next(tie), np.array([s]), np.array([n])) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    halves: list[tuple[int, int]] = []  # of bin number len(sizes) + i, the bins it was merged from
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) < len(b):
            a, b, x, y = b, a, y, x
        alone = min(len(b), k - len(a))  # b's largest meet empty bins of a
        meet = len(b) - alone  # and the rest a's smallest, larger with smaller
        if meet:
            start = len(sizes) + len(halves)
            halves += zip(x[len(a) - meet :][::-1].tolist(), y[alone:].tolist(), strict=True)
            sums = np.concatenate([a[: len(a) - meet], a[len(a) - meet :][::-1] + b[alone:], b[:alone]])
            bins = np.concatenate([x[: len(a) - meet], np.arange(start, start + meet), y[:alone]])
        else:
            sums, bins = np.concatenate([a, b]), np.concatenate([x, y])
        order = (-sums).argsort(kind="stable")
        sums, bins = sums[order], bins[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), next(tie), sums, bins))
    return [_leaves(int(b), len(sizes), halves) for b in heap[0][3]] if heap else []


def _leaves(bin_: int, items: int, halves: list[tuple[int, int]]) -> list[int]:
    out, stack = [], [bin_]
    while stack:
        t = stack.pop()
        if t >= items:
            stack.extend(halves[t - items])
        else:
            out.append(t)
    return sorted(out)


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers; k starts at the least count that can hold all and rises while a window exceeds the capacity, by the share that the fullest exceeds it."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = difference(sizes, k)
        most = max(sum(sizes[i] for i in b) for b in bins)
        if most <= capacity:
            return bins
        k += max(1, k * (most - capacity) // capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, piece: int = 512, block: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids, each in exactly one piece, and every piece's place in a sequence of at most `capacity` tokens.

    A null text counts as empty and gives the end id alone. Null ids of documents stay null.
    Equal and repeated rows are packed each for itself. Other columns are not read. An empty
    table gives no rows. Columns: SCHEMA.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = word_tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId() << 33
        number = count()
        end = end_id.to_bytes(4, "little")
        held: list[tuple] = []
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            whole: list[tuple] = []
            for at in range(0, len(texts), 64):
                for doc, raw in zip(batch["doc_id"].iloc[at : at + 64].tolist(), tok.batch(texts[at : at + 64]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    at_id, full = 0, n - n % capacity
                    while at_id < n:
                        if at_id < full:
                            length = capacity
                        else:
                            parts = -(-(n - full) // piece)
                            length = -(-(n - at_id) // max(1, parts - (at_id - full) * parts // (n - full)))
                        row = (doc, at_id, length, zlib.crc32(raw[4 * at_id : 4 * (at_id + length)]), n)
                        if at_id < full:
                            whole.append((*row, part + next(number), 0))
                        else:
                            held.append(row)
                        at_id += length
            while len(held) >= block:
                whole += placed(held[:block], part, number)
                del held[:block]
            if whole:
                yield frame(whole)
        if held:
            yield frame(placed(held, part, number))

    def placed(rows: list[tuple], part: int, number: Iterator[int]) -> list[tuple]:
        out = []
        for window in pack_block([r[2] for r in rows], capacity):
            seq, offset = part + next(number), 0
            for i in window:
                out.append((*rows[i], seq, offset))
                offset += rows[i][2]
        return out

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, SCHEMA)
