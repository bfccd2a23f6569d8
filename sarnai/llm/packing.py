"""Cost-balanced packing of token ids into sequences of at most 1024.

Each document is its ids and an end id. Every full 1024 ids are a sequence of their own. What is left of a
document joins a block of ``BLOCK`` such remainders, in its own task: no shuffle. The block gets as many full
sequences as its tokens fill, and for the last few tokens sequences of powers of two, so nothing is padded.
In a block, remainders go in descending length to the sequence of the lowest estimated cost that still has
room for them; the cost of n tokens is LINEAR * n + QUADRATIC * n * n, of a sequence the sum over its pieces.
A remainder for which no sequence has room is cut over those of lowest cost.

Sequence ids are the partition's number and a counter, so a task that runs again gives the same ones. Null and
empty texts hold the end id only; repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sarnai.llm.common import as_bytes, to_arrow
from sarnai.llm.tokens import ByteLevel

LENGTH = 1024
END = 0
BLOCK = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OUT_ROWS = 20_000


def capacities(total: int) -> np.ndarray:
    rest = total % LENGTH
    return np.array([LENGTH] * (total // LENGTH) + [1 << b for b in range(9, -1, -1) if rest >> b & 1], np.int64)


def assign(lengths: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of each piece; every sequence is filled."""
    free = capacities(sum(lengths))
    used, cost = np.zeros(len(free), np.int64), np.zeros(len(free))
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            room = free >= left
            if not room.any():
                room = free > 0
            s = int(np.where(room, cost, np.inf).argmin())
            n = min(left, int(free[s]))
            yield item, start, n, s, int(used[s])
            free[s] -= n
            used[s] += n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n


def pack_documents(documents: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids adds the piece's ids."""
    ddl = COLUMNS + ", ids array<int>" * with_ids
    arrow = to_arrow(documents.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, made = ByteLevel(), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def row(doc, start, ids, total, sequence, offset):
            x = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset)
            return (*x, ids.astype(np.int32)) if with_ids else x

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows.clear()

        def pack() -> None:
            nonlocal made
            for item, start, n, s, offset in assign([len(w[2]) for w in waiting]):
                doc, begin, ids, total = waiting[item]
                rows.append(row(doc, begin + start, ids[start : start + n], total, made + s, offset))
            made += len(capacities(sum(len(w[2]) for w in waiting)))
            waiting.clear()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ids = np.append(encoder.ids(text.decode("utf-8", "replace")), np.uint32(END)).astype("<u4")
                total = len(ids)
                whole = total - total % LENGTH
                for start in range(0, whole, LENGTH):
                    rows.append(row(doc, start, ids[start : start + LENGTH], total, made, 0))
                    made += 1
                if whole < total:
                    waiting.append((doc, whole, ids[whole:].copy(), total))
                if len(waiting) >= BLOCK:
                    pack()
                if len(rows) >= OUT_ROWS:
                    yield from flush()
        pack()
        yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, ddl)
