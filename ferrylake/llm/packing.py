"""Best-fit packing of token pieces into fixed-length sequences, planned on the histogram of lengths.

Pieces above one third of the capacity are matched greedily, the longest with the longest that fits beside it, so at
most two share a sequence; the smaller ones then fill the smallest gaps that take them, longest first. As only lengths
matter, the whole plan is made from one count for each length: it has as many steps at any size of the corpus. Each
piece finds its place by its rank among the pieces of its length; ranks come from counts by input partition, so no
group of pieces is ever sorted or gathered in one place.

Null texts are empty and make one piece, the end mark alone. Repeated rows are separate documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrylake.llm.common import exact, staged, text_slices
from ferrylake.llm.tokenize import BATCH_BYTES, WORD_BPE, encoder

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian uint32 bytes), with part and nth.

    `nth` counts the pieces of one length within an input partition `part`. Stage the result before using both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                some = batch.slice(a, b - a)
                ids, offsets = encoder(vocabulary).encode(some.column(1))
                sizes = np.diff(offsets) + 1
                tokens = np.full(len(ids) + len(sizes), end, "<u4")
                begins = np.cumsum(sizes) - sizes
                own = np.ones(len(tokens), bool)
                own[begins + sizes - 1] = False
                tokens[own] = ids
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                at_token = begins[row] + start
                blocks = [tokens[a : a + b].tobytes() for a, b in zip(at_token.tolist(), length.tolist(), strict=True)]
                columns = [some.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blocks], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                columns += [pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
                if with_ids:
                    columns, names = [*columns, pa.array(blocks, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequences, copies in each, first sequence, offset), by length and rank.

    Pieces of one length with ranks from `first rank` fill that many consecutive sequences with so many copies each.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, sequences)
    steps: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(n: int, first: int, many: int, copies: int, offset: int) -> None:
        steps.append((n, used[n], many, copies, first, offset))
        used[n] += many * copies
        left[n] -= many * copies

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for other in [m for m in large if m <= min(n, capacity - n)]:
            many = min(left[n], left[other]) if other != n else left[n] // 2
            if many:
                put(n, sequences, many, 1, 0)
                put(other, sequences, many, 1, n)
                gaps[capacity - n - other].append((sequences, many))
                sequences += many
            if not left[n]:
                break
        if left[n]:
            many = left[n]
            put(n, sequences, many, 1, 0)
            gaps[capacity - n].append((sequences, many))
            sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity):
            while left[n] and gaps.get(gap):
                first, many = gaps[gap].pop()
                copies = gap // n
                full = min(many, left[n] // copies)
                if full:
                    put(n, first, full, copies, capacity - gap)
                    gaps[gap - copies * n].append((first, full))
                if full < many:
                    over = left[n] if left[n] < copies else 0
                    if over:
                        put(n, first + full, 1, over, capacity - gap)
                        gaps[gap - over * n].append((first + full, 1))
                    if rest := many - full - bool(over):
                        gaps[gap].append((first + full + bool(over), rest))
            if not left[n]:
                break
        if left[n]:
            copies = capacity // n
            full, over = divmod(left[n], copies)
            for many, c in ((full, copies), (1, over)):
                if many and c:
                    put(n, sequences, many, c, 0)
                    gaps[capacity - c * n].append((sequences, many))
                    sequences += many
    return np.array(sorted(steps), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to staged pieces that have length (1 to capacity), part and nth; drops the latter two."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    by_part = by_part.select("length", "part", before.alias("before"))
    steps = plan({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)  # one row for each length: `capacity` at most
    shared = pieces.sparkSession.sparkContext.broadcast(steps)
    columns = [c for c in pieces.columns if c not in {"part", "nth"}]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        keys = (s[:, 0] << np.int64(48)) | s[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "_rank"))
            step = s[np.searchsorted(keys, (length << np.int64(48)) | rank, "right") - 1] if len(length) else s[:0]
            row, copy = np.divmod(rank - step[:, 1], np.maximum(step[:, 3], 1))
            out = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(step[:, 4] + row), pa.array(step[:, 5] + copy * length)], names=[*columns, "sequence_id", "offset"])

    ranked = pieces.join(by_part, ["length", "part"]).select(*columns, (F.col("before") + F.col("nth")).alias("_rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_BPE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as best-fit finds."""
    return pack(staged(pieces(docs, capacity, vocabulary, end, with_ids), "pieces"), capacity)
