"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last 16 bytes cuts each text where its high bits are zero, so equal passages of different texts
are cut alike whatever stands before them. Each different chunk is encoded once in a batch and kept in a bounded cache
of its worker. Tokens at a join may differ from those of the whole text: the span between the nearest safe points around
the join is encoded again, and grows by further safe points until its ends agree with token ends of the chunks there. A
safe point is a space between two characters that are not white space; no token of the vocabulary spans one.

Chunks are shared within a task, not between tasks: to encode a chunk once in a whole corpus, each text would have to be
shuffled by its chunks, which costs more than the encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import _BYTES, _power, exact, text_bytes, text_slices
from ferrylake.llm.tokenize import BYTE_BPE, Encoder, encoder, white_edges

WINDOW, CUT_BITS = 16, 9
LEAST_CHUNK = 64
#: Chunks that either of two generations of a worker's cache holds.
CACHE_CHUNKS = 20_000
BATCH_BYTES = 2 << 20

_stores: dict[str, "ChunkStore"] = {}


def cut_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which texts are cut, text starts and ends among them; characters stay whole."""
    n = len(raw)
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[:n], out=total[1:])
        ends = np.arange(WINDOW, n)
        h = (total[ends] - total[ends - WINDOW]) * down[ends - WINDOW] * np.uint64(0x9E3779B97F4A7C15)
    at = ends[(h >> np.uint64(64 - CUT_BITS)) == 0]
    while len(at) and len(inside := np.flatnonzero((raw[np.minimum(at, n - 1)] & 0xC0) == 0x80)):
        at[inside] += 1
    text = np.searchsorted(offsets, at, "right") - 1
    at = at[(at - offsets[text] >= LEAST_CHUNK) & (at < offsets[np.minimum(text + 1, len(offsets) - 1)])]
    kept, last, k = [], -LEAST_CHUNK, 0
    bounds = offsets.tolist()
    for p in at.tolist():
        while k + 1 < len(bounds) and bounds[k + 1] <= p:
            k += 1
        if p - max(last, bounds[k]) >= LEAST_CHUNK:
            kept.append(p)
            last = p
    return np.unique(np.concatenate([offsets, np.array(kept, np.int64)]))


def strings(raw: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
    """The texts between consecutive bounds, without copies."""
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw))


class ChunkStore:
    """A worker's encoder of one byte-level vocabulary, its chunk cache and its decoding table."""

    def __init__(self, vocabulary: str):
        self.words: Encoder = encoder(vocabulary)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        tokenizer = self.words.tokenizer
        table = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def chunk_ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order, and where each chunk's begin, with an end."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = [self.new.get(x) or self.old.get(x) for x in names]
        missing = [i for i, x in enumerate(known) if x is None]
        ids, at = self.words.encode(pa.array([names[i] for i in missing], pa.string()))
        for i, a, b in zip(missing, at[:-1].tolist(), at[1:].tolist(), strict=True):
            known[i] = ids[a:b].tobytes()
        for name, x in zip(names, known, strict=True):
            if len(name) <= 4 << CUT_BITS and x:
                self.new[name] = x
        if len(self.new) > CACHE_CHUNKS:
            self.old, self.new = self.new, {}
        return gather(np.frombuffer(b"".join(known), np.uint32), np.array([len(x) >> 2 for x in known], np.int64), np.asarray(coded.indices))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: empty), and where each text's begin, with an end."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts = cut_points(raw, offsets)
        ids, _ = self.chunk_ids(strings(raw, cuts))
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=at[1:])  # tokens of chunks cover the bytes without gaps
        safe = _safe_points(raw, offsets)
        joins = cuts[~np.isin(cuts, safe)]
        left, right = np.searchsorted(safe, joins, "right") - 1, np.searchsorted(safe, joins)
        while len(joins):  # until both ends agree with token ends
            bad_left, bad_right = ~np.isin(safe[left], at), ~np.isin(safe[right], at)
            if not (bad_left.any() or bad_right.any()):
                break
            left, right = left - bad_left, right + bad_right
        spans = _union(safe[left], safe[right])
        if len(spans):
            flat = np.concatenate([raw[a:b] for a, b in spans.tolist()])
            size = spans[:, 1] - spans[:, 0]
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
            again, n_again = self.words.encode(strings(flat, bounds))
            row = np.repeat(np.arange(len(spans)), np.diff(n_again))
            place = np.cumsum(self.sizes[again]) - self.sizes[again] - bounds[row] + spans[row, 0]
            inside = np.searchsorted(spans[:, 0], at[:-1], "right") - 1
            keep = (inside < 0) | (at[:-1] >= spans[np.maximum(inside, 0), 1])
            kept, at_kept = ids[keep], at[:-1][keep]
            ids, starts = np.empty(len(kept) + len(again), np.uint32), np.empty(len(kept) + len(again), np.int64)
            to = np.arange(len(kept)) + np.searchsorted(place, at_kept)
            other = np.ones(len(ids), bool)
            other[to] = False
            ids[to], starts[to] = kept, at_kept
            ids[other], starts[other] = again, place
        else:
            starts = at[:-1]
        return ids, np.searchsorted(starts, offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the decoded text of each run of ids."""
        sizes = self.sizes[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        flat = self.bytes[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        bounds = ends[offsets].tolist()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            one = flat[a:b]
            try:
                one.decode()
            except UnicodeDecodeError:
                one = one.decode(errors="replace").encode()
            out.append(one)
        return out


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `flat` with these sizes, in the order of `codes`; and where each begins, with an end."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    after = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=after[1:])
    return flat[np.repeat(starts[codes] - after[:-1], n) + np.arange(after[-1])], after


def _union(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Disjoint spans, in order, that cover the given ones."""
    if not len(left):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(left, kind="stable")
    left, right = left[order], np.maximum.accumulate(right[order])
    first = np.ones(len(left), bool)
    first[1:] = left[1:] >= right[:-1]
    last = np.append(first[1:], True)
    return np.stack([left[first], right[last]], 1)


def _safe_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    space, starts, stops = white_edges(raw)
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = space[1:-1] & ~stops[:-2] & ~starts[2:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    inner[edges], inner[edges - 1] = True, False
    return np.union1d(np.flatnonzero(inner), np.array([0, len(raw)]))


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next above 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(0x100)]


def store(vocabulary: str) -> ChunkStore:
    if vocabulary not in _stores:
        _stores[vocabulary] = ChunkStore(vocabulary)
    return _stores[vocabulary]


def encode(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """`docs` (doc_id, text): doc_id, ids as little-endian uint32 bytes, and the decoded text of these ids. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = store(vocabulary)
        for batch in batches:
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                some = batch.slice(a, b - a)
                ids, offsets = chunks.encode(some.column(1))
                cuts = offsets.tolist()
                packed = [ids[x:y].astype("<u4").tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                decoded = [x.decode() for x in chunks.decode(ids, offsets)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encode`'s rows."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
