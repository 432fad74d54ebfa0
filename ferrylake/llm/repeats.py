"""Repeated byte strings across documents, by bucket-pointer refinement of suffixes.

Every byte is removed that a string of `LENGTH` bytes covers which also starts in a document with a smaller doc_id. Two
starts belong together when their first LENGTH bytes agree, so suffixes need only be ordered to that depth. That is done
in buckets: bytes at a start give its first bucket, and a bucket is refined by sorting on the bucket identifiers of later
offsets, which are the refined buckets of the round before: 8 bytes, then 16, 32 and 50.

Suffixes of the whole corpus don't have to meet for that. Each start is sent with the smallest 16-gram (in a hashed order)
of its LENGTH bytes, so equal starts go to the same place together with up to 34 neighbours that share the gram, as one
run of bytes. Grams are the first buckets:

1. Each chunk of documents tells the owners of grams which grams it holds: hash bits only. An owner answers with a grade
   for each: in no other document, in several, or in very many chunks.
2. Chunks send the runs of grams in several documents, equal runs of a chunk once. A run of a gram in very many chunks goes
   to the owners of the 33 bytes that end with its gram and of those that begin with it: LENGTH bytes around a gram hold
   one of these, so no owner gathers a frequent phrase with all its contexts, and no start is sent by itself.
3. Owners find equal runs, refine what is left, and answer with the spans to remove.

Texts are moved once, to where their chunk stays; grades and spans are sent there, and a union under one partitioner brings
them together without moving texts again. That, and rows of whole chunks, is why the core is an RDD.

Null texts are empty. Texts below LENGTH bytes lose nothing. A row without doc_id loses nothing and removes nothing. Rows
with one doc_id don't remove from one another; repeated rows get the same result. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import _power, exact, mix, text_bytes, text_slices

LENGTH, GRAM = 50, 16
#: Starts that a gram is chosen for: those of LENGTH bytes that hold it.
REACH = LENGTH - GRAM + 1
#: A gram in so many chunks is very frequent.
MANY_CHUNKS = 512
#: Bytes beside a gram, on one side or on the other, that any LENGTH bytes around it hold.
BESIDE = (REACH - 1) // 2
#: Bytes of text in a chunk, in the text that one owner of grams answers for, and in a pass over starts. Each chunk sends to
#: each owner, so both are large: small messages take more for themselves than for what they hold.
CHUNK, OWNED, STRETCH = 1 << 22, 24 << 20, 1 << 20
#: Bytes of runs that an owner looks at together; all runs of a gram are among them.
LOOKED_AT = 4 << 20
_CODEC = pa.Codec("zstd", compression_level=3)
_POSITION = np.uint64((1 << 21) - 1)
_BITS = 48


def same(key: int) -> int:
    """The one partitioner."""
    return key


def packed(x: object) -> bytes:
    raw = pickle.dumps(x, 5)
    return struct.pack("<q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpacked(x: bytes) -> object:
    return pickle.loads(_CODEC.decompress(x[8:], struct.unpack("<q", x[:8])[0], asbytes=True))


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal rank side by side: sorted numbers as differences compress well so."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 8).T)


def whole(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def words_at(raw: np.ndarray, at: int = 0) -> np.ndarray:
    """The eight bytes from each place on, the first of them `at`, as numbers."""
    return np.ndarray((max(0, len(raw) - at - 7),), np.uint64, np.ascontiguousarray(raw), at, (1,)) if len(raw) - at > 7 else np.zeros(0, np.uint64)


def gram_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(lo + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) + hi)


class Runs:
    """Runs of a chunk: first start, number of starts, place of the gram after the first start, gram's hash, document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, taking: np.ndarray):
        n = len(raw)
        skip = np.zeros(n + 1, np.int32)
        np.add.at(skip, np.where(taking, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), offsets[:-1]), 1)
        np.add.at(skip, offsets[1:], -1)
        ok = np.cumsum(skip[:n]) == 0
        found = [self.stretch(raw, ok, a) for a in range(0, max(0, n - LENGTH + 1), STRETCH)]
        self.start, self.count, self.place, self.gram = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 4, (np.int64, np.int64, np.int64, np.uint64), strict=True))
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    @staticmethod
    def stretch(raw: np.ndarray, ok: np.ndarray, a: int) -> tuple[np.ndarray, ...]:
        some = raw[a : a + STRETCH + LENGTH - 1]
        m = len(some) - GRAM + 1
        h = gram_hash(words_at(some)[:m], words_at(some, GRAM - 8))
        low = (h & ~_POSITION) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :]) if width < REACH else low
        starts = np.flatnonzero(ok[a : a + len(low)])
        at = (low[starts] & _POSITION).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
        first = starts[begins]
        return first + a, np.diff(np.append(begins, len(at))), at[begins] - first, h[at[begins]]


class Chunk:
    """Documents that travel together."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.ids, self.known, self.raw, self.offsets = ids, known, raw, offsets

    def runs(self) -> Runs:
        return Runs(self.raw, self.offsets, self.known)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, the first one foremost, and where groups begin."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def by_value(values: np.ndarray, begins: np.ndarray, how: np.ufunc) -> np.ndarray:
    """`how` over each group, spread over its members."""
    return np.repeat(how.reduceat(values, begins), np.diff(np.append(begins, len(values)))) if len(values) else values


def gathered(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after another."""
    ends = np.cumsum(length)
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


def texts_alike(raw: np.ndarray, start: np.ndarray, length: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and group begins of equal stretches (with equal keys): by hash, then neighbours byte by byte."""
    up, down = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        h = mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64))
    order, begins = groups(h, length, *keys)
    inside = np.ones(len(order), bool)
    inside[begins] = False
    i = np.flatnonzero(inside)
    if len(i):
        a, b, n = start[order[i - 1]], start[order[i]], length[order[i]]
        differ = np.add.reduceat((gathered(raw, a, n) != gathered(raw, b, n)).astype(np.int64), np.cumsum(n) - n) > 0
        begins = np.union1d(begins, i[differ])
    return order, begins


def owner_of_gram(bits: np.ndarray, owners: int) -> np.ndarray:
    """Owners have ranges of hash bits, so those that go to one are close together."""
    return ((bits >> np.uint64(_BITS - 24)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)


def asked(chunk: Chunk, runs: Runs, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hash bits of the runs' grams, whether several doc_ids have them, their owners; each run's index among them."""
    bits = runs.gram >> np.uint64(64 - _BITS)
    order, begins = groups(bits)
    ids = chunk.ids[runs.doc][order]
    several = np.minimum.reduceat(ids, begins) != np.maximum.reduceat(ids, begins) if len(begins) else np.zeros(0, bool)
    index = np.empty(len(order), np.int64)
    index[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    kinds = bits[order][begins]
    return kinds, several, owner_of_gram(kinds, owners), index


def ask(key: int, name: int, chunk: Chunk, owners: int) -> Iterator[tuple[int, tuple]]:
    kinds, several, to, _ = asked(chunk, chunk.runs(), owners)
    cut = np.flatnonzero(np.diff(to)) + 1
    for at in np.split(np.arange(len(to)), cut) if len(to) else []:
        yield int(to[at[0]]), (key, name, packed((planes(kinds[at]), np.packbits(several[at]))))


def grade(owner: int, blobs: list[tuple]) -> Iterator[tuple[int, tuple]]:
    """0: one document only, 1: several, 2: in very many chunks. In the order asked."""
    some = [unpacked(b) for _, _, b in blobs]
    bits = [whole(x) for x, _ in some]
    several = np.concatenate([np.unpackbits(f, count=len(x)) for (_, f), x in zip(some, bits, strict=True)])
    order, begins = groups(np.concatenate(bits))
    times = np.diff(np.append(begins, len(order)))
    live = (times > 1) | (np.maximum.reduceat(several[order], begins) > 0)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(live.astype(np.uint8) + (times >= MANY_CHUNKS), times)
    at = 0
    for (key, name, _), x in zip(blobs, bits, strict=True):
        yield key, ("grade", name, owner, packed(out[at : at + len(x)]))
        at += len(x)


def offer(key: int, name: int, chunk: Chunk, grades: dict[int, np.ndarray], owners: int) -> Iterator[tuple[int, tuple]]:
    """Runs of grams in several documents, to their owners. Spans that the chunk itself decides pass through an owner, unread."""
    runs = chunk.runs()
    _, _, to, index = asked(chunk, runs, owners)
    graded = np.concatenate([grades[o] for o in np.unique(to).tolist()]) if len(to) else np.zeros(0, np.uint8)
    g = graded[index]
    keep = np.flatnonzero(g)
    start, place, gram, doc, hot = runs.start[keep], runs.place[keep], runs.gram[keep], runs.doc[keep], g[keep] == 2
    length = runs.count[keep] + LENGTH - 1
    if not len(start):
        return
    order, begins = texts_alike(chunk.raw, start, length, place)
    ids = chunk.ids[doc]
    least = np.empty(len(order), np.int64)
    least[order] = by_value(ids[order], begins, np.minimum)
    gone = ids > least
    if gone.any():
        yield key % owners, (key, name, None, packed((planes(start[gone]), length[gone].astype(np.uint8))))
    left = np.flatnonzero(~gone)
    start, length, place, gram, ids, hot = (x[left] for x in (start, length, place, gram, ids, hot))
    ways = [(np.flatnonzero(~hot), gram[~hot])]
    if hot.any():
        eight = words_at(chunk.raw)
        for back, there in ((BESIDE, place >= BESIDE), (0, place + GRAM + BESIDE <= length)):
            i = np.flatnonzero(hot & there)
            h = gram[i]
            with np.errstate(over="ignore"):
                for k in (*range(0, GRAM + BESIDE - 7, 8), GRAM + BESIDE - 8):
                    h = mix(h * np.uint64(0xD1342543DE82EF95) + eight[start[i] + place[i] - back + k])
            ways.append((i, h))
    which, where = (np.concatenate(x) for x in zip(*ways, strict=True))
    to, which = np.divmod(np.unique((mix(where) % np.uint64(owners)).astype(np.int64) * len(start) + which), len(start))
    for at, owner in ((which[x], int(to[x[0]])) for x in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1)):
        own = (planes(ids[at]), planes(start[at]), length[at].astype(np.uint8), place[at].astype(np.uint8), gathered(chunk.raw, start[at], length[at]))
        yield owner, (key, name, owner, packed(own))


def dense(*keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers, 0 and up, of equal keys."""
    order, begins = groups(*keys)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    return out


def refined(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each start's LENGTH bytes, and which stretch it is of. Each round sorts on the buckets of the last."""
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(ends[-1])  # bytes from here to the end of the stretch
    body = gathered(body, start, length)
    depth = 8
    at = np.flatnonzero(left >= depth)
    bucket = np.full(len(body), -1, np.int64)
    bucket[at] = dense(np.ndarray((len(body) - depth + 1,), np.uint64, body, 0, (1,))[at])
    while depth < LENGTH:
        later = min(depth, LENGTH - depth)
        at = np.flatnonzero(left >= depth + later)
        span = int(bucket.max()) + 1
        pair = bucket[at] * span + bucket[at + later]
        bucket = np.full(len(body), -1, np.int64)
        bucket[at] = dense(pair)
        depth += later
    return bucket[at], np.repeat(np.arange(len(length)), length)[at]


def answer(blobs: list[tuple]) -> Iterator[tuple[int, tuple]]:
    """Spans to remove of the runs that came to one owner."""
    some = [unpacked(b[-1]) for b in blobs]
    length, place, body = (np.concatenate([x[i] for x in some]) for i in (2, 3, 4))
    ids, start = (np.concatenate([whole(x[i]) for x in some]).view(np.int64) for i in (0, 1))
    source = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(x[2]) for x in some])
    del some
    begin = np.cumsum(length, dtype=np.int64) - length
    eight = words_at(body)
    gram = gram_hash(eight[begin + place], eight[begin + place + GRAM - 8])
    # Grams of one doc_id have nothing to lose.
    order, begins = groups(gram)
    alone = np.empty(len(order), bool)
    alone[order] = by_value(ids[order], begins, np.minimum) == by_value(ids[order], begins, np.maximum)
    at = order[~alone[order]]
    if not len(at):
        return
    # Runs of a gram side by side; parts begin with a gram.
    size = np.cumsum(length[at], dtype=np.int64)
    part = by_value(size // LOOKED_AT, np.flatnonzero(np.concatenate([[True], gram[at[1:]] != gram[at[:-1]]])), np.minimum)
    out = []
    for some in np.split(at, np.flatnonzero(np.diff(part)) + 1):
        n = length[some].astype(np.int64)
        out.append((source[some], *spans_of(gram[some], ids[some], start[some], n, place[some], gathered(body, begin[some], n))))
    # A run's own numbers are those of its part.
    source, start, size = (np.concatenate(x) for x in zip(*((s[run], begins, sizes) for s, run, begins, sizes in out), strict=True))
    order = np.lexsort((start, source))
    source, start, size = source[order], start[order], size[order]
    for at in np.split(np.arange(len(source)), np.flatnonzero(np.diff(source)) + 1) if len(source) else []:
        key, name, *_ = blobs[source[at[0]]]
        yield key, ("span", name, packed((planes(start[at]), size[at].astype(np.uint8))))


def spans_of(gram: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs with their bytes one after another: which lose something, and where that begins and how long it is."""
    begin = np.cumsum(length) - length
    # Equal runs: all but those of the smallest doc_id go.
    order, begins = texts_alike(body, begin, length, place)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    first = order[begins]
    least = np.minimum.reduceat(ids[order], begins)
    gone = np.flatnonzero(ids > least[kind])
    out = [(gone, np.zeros(len(gone), np.int64), length[gone])]
    # Kinds that share a gram with another kind are refined.
    g_order, g_begins = groups(gram[first])
    several = np.empty(len(first), bool)
    several[g_order] = np.repeat(np.diff(np.append(g_begins, len(first))) > 1, np.diff(np.append(g_begins, len(first))))
    some = np.flatnonzero(several)
    if len(some):
        bucket, stretch = refined(body, begin[first[some]], length[first[some]])
        low = least[some][stretch]
        order, begins = groups(bucket)
        lowest = np.empty(len(low), np.int64)
        lowest[order] = by_value(low[order], begins, np.minimum)
        hit = lowest < low
        step = np.arange(len(hit)) - np.searchsorted(stretch, stretch)
        edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (stretch[1:] != stretch[:-1])]))
        stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (stretch[1:] != stretch[:-1]), [True]]))
        # Each run of the kind that the smallest doc_id has loses these spans.
        of = some[stretch[edge]]
        members = np.flatnonzero(ids == least[kind])
        m_order = members[np.argsort(kind[members], kind="stable")]
        lo, hi = np.searchsorted(kind[m_order], of, "left"), np.searchsorted(kind[m_order], of, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(of)), n)
        run = m_order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]]
        out.append((run, step[edge][which], (step[stop] - step[edge])[which] + LENGTH))
    run, skip, size = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return run, start[run] + skip, size


def cut(chunk: Chunk, spans: list[bytes]) -> pa.RecordBatch:
    """doc_id, n_bytes, kept bytes and removed spans of a chunk's documents."""
    n = len(chunk.raw)
    cover = np.zeros(n + 1, np.int32)
    for blob in spans:
        start, length = unpacked(blob)
        at = whole(start).view(np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
    gone = np.cumsum(cover[:n]) > 0
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    edges = chunk.offsets[:-1][chunk.offsets[:-1] < n]
    before[edges] = False
    after[chunk.offsets[1:][chunk.offsets[1:] > 0] - 1] = False
    lo, hi = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    doc = np.searchsorted(chunk.offsets, lo, "right") - 1
    per = np.searchsorted(lo, chunk.offsets)
    left = np.concatenate([[0], np.cumsum(~gone)])[chunk.offsets]
    base = chunk.offsets[doc]
    pair = pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - lo, pa.int64())], ["start", "length"])
    spans_column = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pair)
    kept = pa.Array.from_buffers(pa.binary(), len(chunk.ids), [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(chunk.raw[~gone].tobytes())])
    ids = pa.array(chunk.ids, pa.int64(), mask=~chunk.known)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(chunk.offsets), pa.int64()), kept, spans_column], ["doc_id", "n_bytes", "kept", "spans"])


RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>"


def chunks(docs: DataFrame) -> RDD:
    """(key, (name, packed chunk)) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = 0
        for b in batches:
            for at, end in text_slices(b.column(1), CHUNK):
                raw, offsets = text_bytes(b.column(1).slice(at, end - at))
                ids = b.column(0).slice(at, end - at)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                name = TaskContext.get().partitionId() << 24 | n
                n += 1
                body = packed((ids.fill_null(0).to_numpy(), known, raw, offsets))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.large_binary())], ["name", "body"])

    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = lambda name: int(mix(np.array([name], np.uint64))[0] >> np.uint64(33))
    return rows.mapInArrow(run, "name long, body binary").rdd.map(lambda r: (key(r.name), ("chunk", r.name, bytes(r.body))))


def with_chunks(texts: RDD, more: RDD, partitions: int) -> RDD:
    """What was sent to the chunks' partitions, then the chunks themselves. Texts don't move."""
    return more.partitionBy(partitions, same).union(texts)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (what is left of the bytes) and spans (removed, in order) of each document."""
    spark = docs.sparkSession
    size = exact(docs, "text").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners, places = max(least, -(-size // OWNED)), max(least, -(-size // (16 << 20)))
    texts = chunks(docs).partitionBy(places, same)

    def asks(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, (_, name, body) in rows:
            yield from ask(key, name, Chunk(*unpacked(body)), owners)

    def grades(rows: Iterator[tuple]) -> Iterator[tuple]:
        by: dict[int, list] = defaultdict(list)
        for owner, blob in rows:
            by[owner].append(blob)
        for owner, blobs in by.items():
            yield from grade(owner, blobs)

    def offers(rows: Iterator[tuple]) -> Iterator[tuple]:
        known: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for key, (what, name, *rest) in rows:
            if what == "grade":
                known[name][rest[0]] = unpacked(rest[1])
            else:
                yield from offer(key, name, Chunk(*unpacked(rest[0])), known.pop(name, {}), owners)

    def answers(rows: Iterator[tuple]) -> Iterator[tuple]:
        by: dict[int, list] = defaultdict(list)
        for _, blob in rows:
            if blob[2] is None:
                yield blob[0], ("span", blob[1], blob[3])
            else:
                by[blob[2]].append(blob)
        for blobs in by.values():
            yield from answer(blobs)

    def cuts(rows: Iterator[tuple]) -> Iterator[tuple]:
        spans: dict[int, list] = defaultdict(list)
        for _, (what, name, body) in rows:
            if what == "span":
                spans[name].append(body)
            else:
                batch = cut(Chunk(*unpacked(body)), spans.pop(name, []))
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(batch)
                yield (out.getvalue().to_pybytes(),)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from pa.ipc.open_stream(x.as_py())

    graded = texts.mapPartitions(asks).partitionBy(owners, same).mapPartitions(grades)
    offered = with_chunks(texts, graded, places).mapPartitions(offers)
    found = offered.partitionBy(owners, same).mapPartitions(answers)
    done = with_chunks(texts, found, places).mapPartitions(cuts)
    return spark.createDataFrame(done, "block binary").mapInArrow(read, RESULT)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["length"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
