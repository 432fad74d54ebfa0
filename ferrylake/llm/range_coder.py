"""Token files: ids coded by an adaptive context-mixing range coder in independently reset, checksummed blocks.

Within a block, ids are numbered in the order in which they appear. Each next number is predicted three ways: by its counts
so far (order 0), by what followed the number before it (order 1), and by what followed the two before it (order 2). The
three predictions are mixed: order 2 puts its share of the range on one number, order 1 its share on another, and order 0
spreads the rest over all numbers seen and over one to come. How much each order gets depends on how often its prediction
held before in the same state (confidence of both, whether they agree, recent hits) and is learned on the way. One step of
the range coder takes the widest of the intervals that stand for the number: the shares come one after another, so order 0 is
looked up once, and an order gets none where order 0 gives what it predicts as much. The ids of the numbers follow in a stream of their own, in order, under a fixed prior that favours
small ids, as vocabularies are sorted by frequency. Models and intervals are whole numbers, so every machine decodes alike;
the counts of order 0 are taken up in steps that get longer with the block.

Blocks of BLOCK ids start from an empty model and carry their size, the CRC-32 of the ids and of the coded bytes, and a
checksum of their own header. The blocks of a segment are coded in step, one lane each, by vector operations; a segment holds
whole documents in order. A file is the rows (segments) that one task wrote, in Parquet, with the file's number, the segment's
number, and a checksum of all its fields but the blocks' contents; files are numbered in ascending doc_id order.

Documents with the same doc_id follow each other; a null doc_id comes first. Null texts are empty and hold the end id alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrylake.llm.common import exact, shared_dir, text_slices
from ferrylake.llm.tokenize import BYTE_BPE, encoder

MAGIC = b"FLT3"
#: Magic, bits of an id, ids, CRC-32 of the ids, bytes of the numbers and of the new ids, CRC-32 of both, CRC-32 of all these.
HEADER = struct.Struct("<4sBIIIIII")
BLOCK = 8192
#: Bytes of text whose documents make a file, about, and that a segment has at most; a longer document makes one of its own.
FILE_BYTES, SEGMENT_BYTES = 36 << 20, 28 << 20
#: Bytes of text that the tokenizer gets at a time, and strings that its tables hold: here a worker encodes much text in a row.
BATCH_BYTES, TABLE_ROOM = 8 << 20, 1_000_000
END = 2

#: Order-0 counts add up to 2**SLOT_BITS; a mixture adds up to 2**MIX_BITS, of which orders 1 and 2 take 256ths.
SLOT_BITS, MIX_BITS = 14, 22
SLOTS = 1 << SLOT_BITS
#: At most so many 256ths go to orders 1 and 2 together.
POINTS = 250
#: Entries of a block's order-2 table.
PAIRS_BITS = 12
#: Counts are taken up after at most so many ids.
LONGEST_STEP = 512
#: The first shares of a state count as much as so many ids.
FIRST_IDS = 4
#: Lanes whose predictions are looked up together when ids are encoded.
GROUP = 64
_LOCAL = 0xFFFF
#: Lanes that are encoded at a time, and that are decoded at a time: more take less time for each, and more memory.
LANES, MOST_LANES = 704, 2304
#: A prediction is a number (below BLOCK) and above it the confidence: 0 (none) to 3.
NUMBER_BITS = 13
_NUMBER, _SURE, _ONCE, _TWICE = (np.uint16(x << NUMBER_BITS - 13) for x in (0x1FFF, 0x6000, 0x2000, 0x4000))
#: The two numbers before are hashed, the last first, into PAIRS_BITS.
_HASH = np.array([40503, 25717], np.uint16)
#: An interval narrower than this takes another 16 bits.
_NARROW = float(1 << 32)
_PER_MIX, _TOP = 2.0**-MIX_BITS, float((1 << MIX_BITS) - 1)


def _first_shares() -> np.ndarray:
    """For each state the 256ths of orders 2 and 1 before anything is counted."""
    out = np.zeros((2, 128), np.int64)
    for state in range(128):
        k2, k1, same, hits = state >> 5, state >> 3 & 3, state >> 2 & 1, state & 3
        two = (0, 90, 160, 220)[k2] and min(240, (0, 90, 160, 220)[k2] + 32 * hits.bit_count())
        out[:, state] = two, 0 if same else (POINTS - two) * (0, 2, 6, 12)[k1] // 16
    return out


_FIRST = _first_shares()


@lru_cache(maxsize=4)
def _prior(bits: int) -> np.ndarray:
    """Cumulative weights, 2**MIX_BITS in all, of the ids below 2**bits."""
    ids = np.arange(1 << bits, dtype=np.int64)
    weight = 1 + ((1 << MIX_BITS - 2) >> 4) // (ids + 256)
    spare = (1 << MIX_BITS) - int(weight.sum())
    weight += spare // len(ids)
    weight[0] += (1 << MIX_BITS) - int(weight.sum())
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(weight)])


@lru_cache(maxsize=4)
def _guesses(bits: int) -> tuple[int, np.ndarray]:
    """A shift, and the id at the begin of each run of so many weights; no id weighs less, so a run has at most one more."""
    prior = _prior(bits)
    shift = int(np.diff(prior).min()).bit_length() - 1
    return shift, (np.searchsorted(prior, np.arange(0, 1 << MIX_BITS, 1 << shift), "right") - 1).astype(np.int32)


def _steps(n: int) -> Iterator[tuple[int, int]]:
    """First id and number of ids between two updates of the order-0 counts."""
    at = 0
    while at < n:
        size = min(max(16, min(LONGEST_STEP, at // 2)), n - at)
        yield at, max(16, min(LONGEST_STEP, at // 2))
        at += size


class _Model:
    """What all lanes have counted. `count` takes up what came since its last call; between two calls nothing changes."""

    def __init__(self, lanes: int, slots: bool):
        self.lanes, self.with_slots = lanes, slots
        self.lane = np.arange(lanes)
        self.room = 0
        self.listed = np.zeros(lanes, np.int64)  # numbers that `count` has taken up
        # ids in each state, hits of orders 2 and 1, and the slots that order 0 gave to what these predicted
        self.states = np.zeros((5, lanes * 128), np.int64)
        self.counts = self.spread = np.zeros(0, np.int32)
        self.slots = np.zeros((lanes if slots else 0, SLOTS), np.uint16)  # the number of each slot

    def _grow(self, room: int) -> None:
        """Makes place for `room` numbers in each lane."""
        counts = np.zeros((self.lanes, room), np.int32)
        counts[:, : self.room] = self.counts.reshape(self.lanes, self.room)
        self.counts, self.spread = counts.reshape(-1), np.zeros(self.lanes * room, np.int32)
        self.room, self.base = room, self.lane * room

    def take_up(self, x: np.ndarray, states: np.ndarray, two: np.ndarray, one: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Counts numbers and what held in which state; all arrays have a row for each lane."""
        for i in range(0, self.lanes, GROUP):  # what a few lanes need stays small
            some = slice(i, i + GROUP)
            lane = self.lane[: len(x[some]), None]
            own = slice(i * self.room, (i + len(lane)) * self.room)
            self.counts[own] += np.bincount((lane * self.room + x[some]).ravel(), minlength=len(lane) * self.room).astype(np.int32)
            kinds = lane * 512 + states[some] * np.uint16(4) + hit2[some] * np.uint16(2) + hit1[some]
            found = np.bincount(kinds.ravel(), minlength=len(lane) * 512).reshape(-1, 4)
            slots = [self.spread[own].take(lane * self.room + k[some]) & 0x7FFF for k in (two, one)]
            # both sums at once: below 2**24 each in a step, so floats are exact
            sums = np.bincount((kinds >> 2).ravel(), (slots[0] * float(1 << 24) + slots[1]).ravel(), len(lane) * 128).astype(np.int64)
            self.states[:, i * 128 : (i + len(lane)) * 128] += np.stack([found.sum(1), found[:, 2] + found[:, 3], found[:, 1] + found[:, 3], sums >> 24, sums & 0xFFFFFF])

    def count(self, known: np.ndarray, seen: int, next_: int, last: int) -> None:
        """Makes the predictions for the next `next_` ids from `seen` ids, of which `last` came since the last call."""
        most = int(known.max())
        if most + next_ + 1 > self.room:
            self._grow(most + next_ + 1 + (most + next_) // 2)
        n, hits2, hits1, given2, given1 = (x.reshape(self.lanes, 128) for x in self.states)
        v2, v1 = (self._share(n + FIRST_IDS, POINTS * hits + FIRST_IDS * first, given) for hits, first, given in ((hits2, _FIRST[0], given2), (hits1, _FIRST[1], given1)))
        v1 = np.minimum(v1, POINTS - v2)
        self.shares = (v2 << 8 | v2 + v1).astype(np.int32).reshape(-1)
        fresh = known - self.listed
        self.listed = known.copy()
        for i in range(0, self.lanes, GROUP):
            self._spread(slice(i, i + GROUP), known[i : i + GROUP], fresh[i : i + GROUP], seen, next_, last)

    def _share(self, n: np.ndarray, hits: np.ndarray, given: np.ndarray) -> np.ndarray:
        """The 256ths of an order, from its hits (in 256ths): none where order 0 does as well, as it still gives slots to what is predicted.

        An order that hits with a rate h where order 0 gives p on average gains h log(h / p) + (1 - h) log(1 - h), which is
        above 0 about where h > p (2.8 - 1.7 h).
        """
        return np.where(10 * SLOTS * hits * n > given * (28 * 256 * n - 17 * hits), hits // n, 0)

    def _spread(self, lanes: slice, known: np.ndarray, fresh: np.ndarray, seen: int, next_: int, last: int) -> None:
        """Spreads the slots of some lanes over their numbers."""
        most = int(known.max())
        counts, spread = (x.reshape(self.lanes, self.room)[lanes] for x in (self.counts, self.spread))
        unseen = np.minimum(np.clip(SLOTS * (fresh + 1) // (last + 2), next_ + 64, SLOTS // 2), SLOTS - known)
        share = np.zeros((len(known), most), np.int32)
        first = np.zeros(len(known), np.int32)
        if most:
            room = (SLOTS - unseen - known).astype(np.int32)[:, None]
            share = counts[:, :most] * room // np.int32(seen) + (np.arange(most) < known[:, None])
            ends = np.cumsum(share, axis=1, dtype=np.int32)
            spread[:, :most] = (ends - share) << 15 | share
            first = ends[:, -1]
        # The first of the numbers to come get `wide` slots each, others one; what is left is for the one that comes next.
        left = SLOTS - first
        some = np.minimum(2 * fresh * next_ // max(last, 1) + 4, next_)
        wide = np.maximum(1, np.minimum((left - next_ - 1) // (2 * some), SLOTS // max(seen, 1) + 1)).astype(np.int32)
        nth = np.arange(next_ + 1)
        width = np.where(nth < some[:, None], wide[:, None], np.int32(1))
        place = known[:, None] + nth
        np.put_along_axis(spread, place, (first[:, None] + np.cumsum(width, axis=1, dtype=np.int32) - width) << 15 | width, 1)
        if self.with_slots:
            reps = np.concatenate([share, width, (left - width.sum(1, dtype=np.int32))[:, None]], 1)
            names = np.empty(reps.shape, np.uint16)
            names[:, :most], names[:, most:-1], names[:, -1] = np.arange(most), place, _LOCAL
            self.slots[lanes] = np.repeat(names.reshape(-1), reps.reshape(-1)).reshape(-1, SLOTS)


def _numbered(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids of a block, numbered as they appear. `first` is scratch, one place for each possible id."""
    n = np.arange(len(ids), dtype=np.int32)
    first[ids[::-1]] = n[::-1]
    place = first[ids]
    return (np.cumsum(place == n) - 1)[place]


def _chain(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What the last row with the same key had as `x`, with the confidence above its bits; by lane. 0 where there is none."""
    order = np.argsort(key, axis=1, kind="stable")
    order += np.arange(len(x))[:, None] * x.shape[1]
    key, xs = key.take(order), x.take(order)
    ok = key[:, 1:] == key[:, :-1]
    n = np.arange(key.shape[1], dtype=np.int16)
    begin = np.zeros(key.shape, np.int16)  # where the run of the same predictions begins
    np.multiply(~(ok & (xs[:, 1:] == xs[:, :-1])), n[1:], out=begin[:, 1:])
    run = (n - np.maximum.accumulate(begin, axis=1)).astype(np.uint16)
    out = np.zeros(key.shape, np.uint16)
    np.multiply(xs[:, :-1] | (np.minimum(run[:, :-1], 2) + np.uint16(1)) << np.uint16(NUMBER_BITS), ok, out=out[:, 1:])
    found = np.empty_like(out)
    found.reshape(-1)[order] = out
    return found


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The coded blocks of a run of ids (below 2**20), each with its header."""
    ids = np.asarray(ids)
    if len(ids) and int(ids.max()) >= 1 << 20:
        raise ValueError("ids must be below 2**20")
    if block > BLOCK:
        raise ValueError(f"a block has {BLOCK} ids at most")
    parts = max(1, -(-len(ids) // (LANES * block)))  # of about the same number of lanes
    some = -(-len(ids) // (parts * block)) * block
    return [b for i in range(0, len(ids), some or 1) for b in _encoded(ids[i : i + some].astype(np.int32), block)]


def _encoded(ids: np.ndarray, block: int) -> list[bytes]:
    bits = max(8, int(ids.max()).bit_length())
    lanes = -(-len(ids) // block)
    sizes = np.minimum(block, len(ids) - np.arange(lanes) * block)
    longest = int(sizes[0])
    numbers, one, two = (np.zeros((lanes, longest), np.uint16) for _ in range(3))
    states, known = np.zeros((lanes, longest), np.uint8), np.zeros((lanes, longest), np.uint16)
    new, hit2, hit1 = (np.zeros((lanes, longest), bool) for _ in range(3))
    scratch = np.zeros(1 << bits, np.int32)
    for i in range(lanes):
        numbers[i, : sizes[i]] = _numbered(ids[i * block : i * block + sizes[i]], scratch)
    for i in range(0, lanes, GROUP):  # the sorts of a few lanes at a time stay small
        some = slice(i, i + GROUP)
        x = numbers[some]
        last, before = np.zeros(x.shape, np.uint16), np.zeros(x.shape, np.uint16)
        last[:, 1:], before[:, 2:] = x[:, :-1], x[:, :-2]
        a, b = _chain(x, last), _chain(x, (last * _HASH[0] + before * _HASH[1]) >> np.uint16(16 - PAIRS_BITS))
        own1, own2 = a & _NUMBER, b & _NUMBER
        one[some], two[some] = own1, own2
        same = own1 == own2
        hit2[some] = own2 == x
        hit1[some] = (own1 == x) & ~same
        states[some] = (b >> np.uint16(8)) & np.uint16(0x60) | (a >> np.uint16(10)) & np.uint16(0x18) | same * np.uint16(4)
        states[some][:, 1:] |= hit2[some][:, :-1]
        states[some][:, 2:] |= hit2[some][:, :-2] * np.uint8(2)
        known[some] = np.maximum.accumulate(x, axis=1) + 1  # numbers given after each id
        new[some, 0] = True
        new[some, 1:] = known[some][:, 1:] > known[some][:, :-1]
    start, wide = (np.empty((longest, lanes), np.float32) for _ in range(2))  # each id's interval
    m = _Model(lanes, False)
    lane, since = m.lane[:, None], 0
    for begin, size in _steps(longest):
        m.count(known[:, begin - 1].astype(np.int64) if begin else np.zeros(lanes, np.int64), begin, size, since)
        since = size
        now = slice(begin, begin + size)
        x, state = numbers[:, now], states[:, now]
        v = m.shares.take(lane * 128 + state)
        v2, points = v >> 8, v & 0xFF
        s = m.spread.take(m.base[:, None] + x)
        first, own = s >> 15, s & 0x7FFF
        np.copyto(own, SLOTS - first, where=new[:, now])
        a, b = (points << SLOT_BITS) + (256 - points) * first, (256 - points) * own
        v2 <<= SLOT_BITS
        v1 = (points << SLOT_BITS) - v2
        by1, by2 = hit1[:, now] & (v1 > b), hit2[:, now] & (v2 > b)  # of two intervals the wider one
        np.copyto(a, v2, where=by1)
        np.copyto(b, v1, where=by1)
        np.copyto(a, 0, where=by2)
        np.copyto(b, v2, where=by2)
        start[now], wide[now] = a.T, b.T
        m.take_up(x, state, two[:, now], one[:, now], hit2[:, now], hit1[:, now])
    bodies = _written(start, wide, sizes)
    # The new ids in their order, each with the interval of its prior; most lanes first.
    n_new = known[np.arange(lanes), sizes - 1].astype(np.int64)
    order = np.argsort(-n_new, kind="stable")
    row, column = np.nonzero(new & (np.arange(longest) < sizes[:, None]))
    name, place = ids[row * block + column], (numbers[row, column], np.argsort(order)[row])
    prior = _prior(bits)
    start, wide = (np.zeros((int(n_new.max()), lanes), np.float32) for _ in range(2))
    start[place], wide[place] = prior[name], prior[name + 1] - prior[name]
    names = _written(start, wide, n_new[order])
    raw, blocks = ids.astype("<u4"), [b""] * lanes
    for at, i in enumerate(order.tolist()):
        crc, body = zlib.crc32(raw[i * block : i * block + int(sizes[i])].tobytes()), bodies[i] + names[at]
        head = HEADER.pack(MAGIC, bits, int(sizes[i]), crc, len(bodies[i]), len(names[at]), zlib.crc32(body), 0)[:-4]
        blocks[i] = head + struct.pack("<I", zlib.crc32(head)) + body
    return blocks


def _written(start: np.ndarray, wide: np.ndarray, n_steps: np.ndarray) -> list[bytes]:
    """The range coder: what lanes write that take `n_steps` steps (none more than the lane before) with these intervals.

    All numbers are below 2**53, so floats are exact; they are faster than integers of 64 bits.
    """
    lanes = len(n_steps)
    both = np.zeros((2, lanes))  # low and width
    both[1] = 1 << 48
    digits, written = np.zeros((len(start) + 64, lanes), np.int32), np.zeros((len(start) + 64, lanes), bool)
    live = np.searchsorted(-n_steps, -np.arange(len(start)), "left").tolist()
    at = 0
    n = -1
    for t, now in enumerate(live):
        if now != n:
            n = now
            live_both = both[:, :n]
            lo, wi = live_both
        r = np.floor(wi * _PER_MIX)
        lo += r * start[t, :n]
        np.multiply(r, wide[t, :n], out=wi)
        while True:  # digits may have a 17th bit; it is carried to the left in the end
            if at == len(digits):
                digits, written = (np.concatenate([x, np.zeros_like(x[: 1 + at // 2])]) for x in (digits, written))
            narrow = np.less(wi, _NARROW, out=written[at, :n])
            digit = np.floor(lo * (1 / _NARROW))
            digits[at, :n] = digit
            digit *= 65536 * _NARROW
            more = live_both * 65536
            more[0] -= digit
            np.copyto(live_both, more, where=narrow)
            at += 1
            if wi.min() >= _NARROW:
                break
    low, rest = both[0], np.empty((3, lanes), np.int32)
    for i in range(3):
        rest[i] = low / _NARROW
        low = (low % _NARROW) * 65536
    out = []
    for i in range(0, lanes, GROUP):
        some, own = digits[:at, i : i + GROUP].T.copy(), written[:at, i : i + GROUP].T.copy()
        for k in range(len(some)):
            body = np.concatenate([some[k][own[k]], rest[:, i + k]])
            over = np.flatnonzero(body >> 16)
            while len(over):
                body[over] &= 0xFFFF
                body[over - 1] += 1
                over = over[body[over - 1] > 0xFFFF] - 1
            out.append(body.astype(">u2").tobytes())
    return out


class DamagedBlock(ValueError):
    """A block or segment whose content is not what its header or checksum says."""


def _heads(blocks: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Bits, size, checksum and bytes of the numbers of each block; all are checked before anything is decoded."""
    heads = []
    for b in blocks:
        if len(b) < HEADER.size or b[:4] != MAGIC:
            raise DamagedBlock("no block begins here")
        _, bits, size, crc, length, more, body, own = HEADER.unpack(b[: HEADER.size])
        if zlib.crc32(b[: HEADER.size - 4]) != own:
            raise DamagedBlock("the checksum of a header does not hold")
        if len(b) != HEADER.size + length + more or length % 2 or more % 2 or min(length, more) < 6 or not 8 <= bits <= 20 or not 0 < size <= BLOCK:
            raise DamagedBlock("a block has another length than its header says")
        if zlib.crc32(memoryview(b)[HEADER.size :]) != body:
            raise DamagedBlock("the checksum of a block's content does not hold")
        heads.append((bits, size, crc, length))
    return heads


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of coded blocks, one after another. All headers are checked first."""
    heads = _heads(blocks)
    parts = [_decoded(blocks[i : i + MOST_LANES], heads[i : i + MOST_LANES]) for i in range(0, len(blocks), MOST_LANES)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


class _Reader:
    """The range decoder of lanes that read digits of their own. Floats are exact here, as in `_written`."""

    def __init__(self, bodies: list[memoryview]):
        n = max(len(b) for b in bodies) // 2 + 4
        digits = np.zeros((len(bodies), n), np.uint16)
        for own, body in zip(digits, bodies, strict=True):
            own[: len(body) // 2] = np.frombuffer(body, ">u2")
        self.both = np.full((2, len(bodies)), float(1 << 48))  # code and width
        self.both[0] = digits[:, 0] * float(1 << 32) + digits[:, 1] * 65536.0 + digits[:, 2]
        self.pos, self.digits = np.arange(len(bodies)) * n + 3, digits.reshape(-1)
        self.live(len(bodies))

    def live(self, n: int) -> None:
        """Only the first `n` lanes go on."""
        self.both, self.pos = self.both[:, :n], self.pos[:n]
        self.code, self.width = self.both

    def weight(self) -> np.ndarray:
        """The place of each lane's code in the mixture."""
        self.r = np.floor(self.width * _PER_MIX)
        return np.minimum(self.code / self.r, _TOP).astype(np.int32)  # bounded before the cast: a damaged block may lead anywhere

    def take(self, interval: np.ndarray) -> None:
        """Takes the interval (start, width) in which that place lies."""
        code, width, pos = self.code, self.width, self.pos
        start, width[:] = self.r * interval
        code -= start
        while True:
            narrow = width < _NARROW
            more = self.both * 65536
            more[0] += self.digits.take(pos, mode="clip")  # a damaged block may read on in others
            np.copyto(self.both, more, where=narrow)
            pos += narrow
            if width.min() >= _NARROW:
                return


def _decoded(blocks: list[bytes], heads: list[tuple[int, int, int, int]]) -> np.ndarray:
    with np.errstate(over="ignore"):  # a damaged block may lead anywhere; its checksum is looked at in the end
        order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])  # lanes end one after another, the last first
        sizes = np.array([heads[i][1] for i in order])
        by_step, known = _numbers([memoryview(blocks[i])[HEADER.size : HEADER.size + heads[i][3]] for i in order], sizes)
        names = _names([memoryview(blocks[i])[HEADER.size + heads[i][3] :] for i in order], known, np.array([heads[i][0] for i in order]))
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for first in range(0, len(order), GROUP):
        numbers = by_step[:, first : first + GROUP].T.copy()
        for k, i in enumerate(order[first : first + GROUP]):
            one = names[first + k].take(numbers[k, : sizes[first + k]])
            if zlib.crc32(one.astype("<u4").tobytes()) != heads[i][2]:
                raise DamagedBlock(f"the checksum of block {i} does not hold")
            out[i] = one
    return np.concatenate(out)


def _names(bodies: list[memoryview], known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ids of the `known` numbers of each lane."""
    order = np.argsort(-known, kind="stable")
    known, bits = known[order], bits[order]
    reader, out = _Reader([bodies[i] for i in order]), np.zeros((int(known[0]), len(bodies)), np.uint32)
    priors = {b: (_prior(b), *_guesses(b)) for b in set(bits.tolist())}
    live = np.searchsorted(-known, -np.arange(len(out)), "left").tolist()
    for t, n in enumerate(live):
        if n != len(reader.code):
            reader.live(n)
        at = reader.weight()
        interval = np.empty((2, n), np.int64)
        for b, (prior, by, guesses) in priors.items():
            own = slice(None) if len(priors) == 1 else bits[:n] == b
            guess = guesses.take(at[own] >> by)
            guess = guess + (at[own] >= prior.take(guess + 1))
            start = prior.take(guess)
            out[t, :n][own], interval[0, own], interval[1, own] = guess, start, prior.take(guess + 1) - start
        reader.take(interval)
    return out.T[np.argsort(order)]


def _numbers(bodies: list[memoryview], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lanes, step by step, and how many different ones each has."""
    lanes, longest = len(bodies), int(sizes[0])
    reader, m = _Reader(bodies), _Model(len(bodies), True)
    room = longest + 32
    # The predictions of order 1 for each number, then those of order 2 for each hash; a row each where both are looked up.
    predicted = np.zeros(lanes * (room + (1 << PAIRS_BITS)), np.uint16)
    at_both = np.stack([m.lane * room, lanes * room + (m.lane << PAIRS_BITS)])
    at_slots, at_shares = m.lane << SLOT_BITS, m.lane * 128
    known, hits = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
    before, key = np.zeros(lanes, np.uint16), np.zeros((2, lanes), np.uint16)
    by_step = np.zeros((longest, lanes), np.uint16)
    live = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()
    slots, eight, ten, both, one_bit = m.slots.reshape(-1), *(np.uint16(k) for k in (8, 10, 3, 1))
    unhashed, same_bit, (by_last, by_before) = np.uint16(16 - PAIRS_BITS), np.uint8(2), _HASH
    since, n = 0, lanes
    for begin, size in _steps(longest):
        m.count(known.astype(np.int64), begin, size, since)
        since = size
        end = min(begin + size, longest)
        states, numbers = np.zeros((end - begin, lanes), np.uint16), np.zeros((end - begin, 2, lanes), np.uint16)
        held = np.zeros(numbers.shape, bool)
        base = m.base[:n]
        for t in range(begin, end):
            if live[t] != n:
                n = live[t]
                reader.live(n)
                base, at_both, at_slots, at_shares = m.base[:n], at_both[:, :n], at_slots[:n], at_shares[:n]
                key, before, hits = key[:, :n], before[:n], hits[:n]
            # what orders 1 and 2 predict, and the shares of all orders
            places = at_both + key
            found = predicted.take(places)
            one, two = guess = np.bitwise_and(found, _NUMBER, out=numbers[t - begin, :, :n])
            found &= _SURE
            same = one == two
            state = states[t - begin, :n]
            np.right_shift(found[1], eight, out=state)
            state |= found[0] >> ten
            state |= same.view(np.uint8) << same_bit
            state |= hits
            v = m.shares.take(at_shares + state)
            points = v & 0xFF
            v0 = np.int32(256) - points
            edges = np.empty((3, n), np.int32)  # 0, and where the shares of order 2 and of both end; then of order 1 the width
            edges[0] = 0
            a2, a1 = np.left_shift(v >> 8, SLOT_BITS, out=edges[1]), points << SLOT_BITS
            np.subtract(a1, a2, out=edges[2])
            # the number whose interval holds the code, first by order 0
            at = reader.weight()
            by2, by = at < a2, at < a1
            slot = (np.maximum(at - a1, 0).astype(np.float32) / v0.astype(np.float32)).astype(np.int64)  # exact: quotients differ by 1/256 at least
            slot += at_slots
            x = by_step[t, :n]
            np.minimum(slots.take(slot), known[:n], out=x)
            np.copyto(x, one, where=by)
            np.copyto(x, two, where=by2)
            # its interval
            s = m.spread.take(base + x)
            interval = np.empty((2, n), np.int32)
            first, wide = np.right_shift(s, 15, out=interval[0]), np.bitwise_and(s, 0x7FFF, out=interval[1])
            new = x == known[:n]
            np.copyto(wide, SLOTS - first, where=new)
            interval *= v0
            first += a1
            np.copyto(interval, edges[1:], where=by)
            np.copyto(interval, edges[:2], where=by2)
            reader.take(interval)
            # what the next ids are told; a confidence is 1 where the prediction failed, else one more, 3 at most
            hit = np.equal(guess, x, out=held[t - begin, :, :n])
            np.minimum(found, _TWICE, out=found)
            found *= hit
            found += x | _ONCE
            predicted[places] = found
            hits = (hits << one_bit | hit[1]) & both
            known[:n] += new
            key[0] = x
            key[1] = (x * by_last + before) >> unhashed
            before = x * by_before
        one, two = numbers[:, 0], numbers[:, 1]
        m.take_up(by_step[begin:end].T, states.T, two.T, one.T, held[:, 1].T, (held[:, 0] & (one != two)).T)
    return by_step, known.astype(np.int64)


FILES = "file int, segment int, n_ids long, doc_ids binary, n_nulls int, sizes binary, blocks array<binary>, crc32 long"


def _checksum(file: int, segment: int, n_ids: int, doc_ids: bytes, n_nulls: int, sizes: bytes, blocks: list[bytes]) -> int:
    """CRC-32 of all fields of a segment, of its blocks the headers: these hold the checksums of the ids."""
    crc = zlib.crc32(struct.pack("<iiqiqqq", file, segment, n_ids, n_nulls, len(doc_ids), len(sizes), len(blocks)))
    for x in (doc_ids, sizes, *(b[: HEADER.size] for b in blocks)):
        crc = zlib.crc32(x, crc)
    return crc


def write(docs: DataFrame, path: str, vocabulary: str = BYTE_BPE, end: int = END) -> None:
    """Encodes `docs` (doc_id, text) and writes token files under `path`, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, segment = TaskContext.get().partitionId(), 0

        def coded(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(tables)
            tables.clear()
            doc_ids, texts = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            ids, offsets = encoder(vocabulary, TABLE_ROOM).encode(texts, BATCH_BYTES)
            sizes = np.diff(offsets) + 1
            tokens = np.full(len(ids) + len(sizes), end, np.uint32)
            own = np.ones(len(tokens), bool)
            own[np.cumsum(sizes) - 1] = False
            tokens[own] = ids
            del table, texts, ids, own  # what is next needs the place
            values = np.asarray(doc_ids.fill_null(0)).astype("<i8")
            row = [file, segment, len(tokens), values.tobytes(), doc_ids.null_count, sizes.astype("<i8").tobytes(), encode_blocks(tokens)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*row, _checksum(*row)), kinds, strict=True)], names=["file", "segment", "n_ids", "doc_ids", "n_nulls", "sizes", "blocks", "crc32"])

        held, size = [], 0
        for batch in batches:
            for a, b in text_slices(batch.column(1), SEGMENT_BYTES // 8):
                some = batch.slice(a, b - a)
                n = sum(len(t.as_buffer()) if t.is_valid else 0 for t in some.column(1).cast(pa.binary()))
                if held and size + n > SEGMENT_BYTES:
                    yield coded(held)
                    held, size, segment = [], 0, segment + 1
                held.append(some)
                size += n
        if held:
            yield coded(held)

    docs = exact(docs, "doc_id", "text")
    tie = F.xxhash64("text")
    n_files = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n_files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(run, FILES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids as little-endian uint32 bytes, decoded from the files."""
    files = spark.read.schema(FILES).parquet(path)
    # One row a segment, without the blocks: the ids before each file, then before each segment in it.
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before_file"))
    inside = F.sum("n_ids").over(Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    starts = files.select("file", "segment", "n_ids").withColumn("inside", inside).join(before, "file").select("file", "segment", (F.col("before_file") + F.col("inside")).alias("before"))

    def decoded(segments: list[dict]) -> Iterator[pa.RecordBatch]:
        tokens, at = decode_blocks([b for s in segments for b in s["blocks"]]).astype("<u4", copy=False), 0
        for s in segments:
            n = np.frombuffer(s["sizes"], "<i8")
            ends = np.cumsum(n)
            if (ends[-1] if len(n) else 0) != s["n_ids"] or len(s["doc_ids"]) != len(s["sizes"]):
                raise DamagedBlock("a segment has other sizes than its fields say")
            texts = [tokens[at + b - a : at + b].tobytes() for a, b in zip(n.tolist(), ends.tolist(), strict=True)]
            at += s["n_ids"]
            ids = pa.array(np.frombuffer(s["doc_ids"], "<i8"), mask=np.arange(len(n)) < s["n_nulls"])
            columns = [pa.array(np.full(len(n), s[k], np.int32)) for k in ("file", "segment")]
            texts = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(ends - n), pa.array(n), texts], names=["file", "segment", "doc_id", "inside", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                s = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                crc = s.pop("crc32")
                if _checksum(**s) != crc:
                    raise DamagedBlock("the checksum of a segment does not hold")
                if held and sum(len(h["blocks"]) for h in held) + len(s["blocks"]) > MOST_LANES:
                    yield from decoded(held)
                    held = []
                held.append(s)
        if held:
            yield from decoded(held)

    rows = files.mapInArrow(run, "file int, segment int, doc_id long, inside long, n_tokens long, ids binary")
    return rows.join(F.broadcast(starts) if starts.count() <= 100_000 else starts, ["file", "segment"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")


def written_and_read(docs: DataFrame, vocabulary: str = BYTE_BPE, end: int = END) -> DataFrame:
    """Writes token files to a new folder under the shared one and reads them back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocabulary, end)
    return read(docs.sparkSession, path)
