"""Exact token ids of whole texts by the tokenizers library, with repeated chunks of a batch encoded once.

A text is cut before single spaces. For the two public vocabularies used here no token spans such a cut: byte-level BPE
starts a new word at a space between two other characters, and the word vocabulary drops white space. Texts with spaces
next to other white space go to the library whole, where cuts would not be safe. `vocabulary` names the file; each
Python worker loads it once and keeps a bounded cache of chunks.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ferrylake.llm.common import text_bytes, text_slices, tokenizer_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Chunks, words or parts that a worker's table may hold before those that few batches used go, and the longest that stays.
CACHE_CHUNKS, CACHE_BYTES = 300_000, 64
#: Bytes of text that are cut and encoded at a time.
BATCH_BYTES = 2 << 20

#: A plain word (letters below U+0250 but for the one whose lower case is two characters), and punctuation after it; and the
#: same on the next line.
_LETTERS, _MARKS = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+", "[.,;:!?*$%&#|]*"
_PLAIN = rf"^(?P<word>{_LETTERS})(?P<end>{_MARKS})(?:(?P<line>\n)(?P<word2>{_LETTERS})(?P<end2>{_MARKS}))?$"

#: The characters that stand for bytes in a byte-level vocabulary: themselves where they can be seen.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip(_SEEN + [b for b in range(256) if b not in _SEEN], map(chr, _SEEN + list(range(256, 512 - len(_SEEN)))), strict=True))

_workers: dict[tuple[str, int], "Encoder"] = {}


def encoder(vocabulary: str, room: int = CACHE_CHUNKS) -> "Encoder":
    """The worker's encoder of a vocabulary, with tables of `room` strings."""
    if (vocabulary, room) not in _workers:
        _workers[vocabulary, room] = Encoder(vocabulary, room)
    return _workers[vocabulary, room]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of `flat`, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])] if len(ends) else flat[:0]


class _Table:
    """Strings and their ids. Strings are found by Arrow, all at once, and compared whole."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], room: int = CACHE_CHUNKS):
        self.make, self.room = make, room  # make: different strings to their ids, one after another, and how many each has
        self.keys, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int32)  # calls that looked a string up; of calls before a shrinking, half

    def _shrink(self) -> None:
        short, least = np.asarray(pc.binary_length(self.keys)) <= CACHE_BYTES, 2
        while 2 * ((stay := short & (self.used >= least)).sum()) > self.room:
            least *= 2
        self.keys, self.flat = self.keys.filter(pa.array(stay)), _gathered(self.flat, self.starts[stay], self.sizes[stay])
        self.sizes, self.used = self.sizes[stay], self.used[stay] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def find(self, values: pa.Array) -> np.ndarray:
        """The place of each value in the table; `starts`, `sizes` and `flat` hold its ids until the next call."""
        if len(self.keys) > self.room:
            self._shrink()
        values = values.fill_null("") if values.null_count else values
        coded = values.dictionary_encode()
        # The table's strings are looked up among those of the texts: these are fewer, so what Arrow hashes is smaller.
        found = pc.index_in(self.keys, value_set=coded.dictionary)
        held = np.flatnonzero(np.asarray(found.is_valid()))
        place = np.full(len(coded.dictionary), -1, np.int64)
        place[np.asarray(found.drop_null())] = held
        new = place < 0
        if new.any():
            missing = coded.dictionary.filter(pa.array(new))
            flat, sizes = self.make(missing)
            place[new] = np.arange(len(missing)) + len(self.keys)
            self.keys = pa.concat_arrays([self.keys, missing.cast(pa.string())])
            self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            self.used = np.concatenate([self.used, np.zeros(len(missing), np.int32)])
        self.used[place] += 1
        return place[np.asarray(coded.indices)]


class Encoder:
    def __init__(self, vocabulary: str, room: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.spaced = vocabulary != WORD_BPE  # chunks keep the space before them
        self.after_space, self.first = _Table(lambda x: self._chunks(x, self.spaced), room), _Table(lambda x: self._chunks(x, False), room)
        self.words = {s: _Table(lambda x, s=s: self._words(x, " " if s else ""), room) for s in (True, False)}
        self.parts = _Table(lambda x: self._wholes(x.to_pylist()))
        # A token that ends a word: it tells words apart in a longer text.
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith("</w>")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, encoded whole."""
        few = (texts[i : i + 256] for i in range(0, len(texts), 256))  # the library's own results are much larger than the ids
        return [np.array(e.ids, np.uint32) for some in few for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = self.whole(texts)
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

    def _chunks(self, names: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks; `spaced`: a space stands before each. Plain words are encoded once, whatever follows them."""
        split = pc.extract_regex(names, _PLAIN)
        is_plain = pc.is_valid(split)
        plain = np.asarray(is_plain)
        word, end, line, word2, end2 = (pc.struct_field(split, x).filter(is_plain) for x in ("word", "end", "line", "word2", "end2"))
        lower = pc.utf8_lower if not self.spaced else lambda x: x
        starts, sizes, flats, total = [], [], [], 0
        for table, column in ((self.words[spaced], lower(word)), (self.parts, end), (self.parts, line), (self.words[False], lower(word2)), (self.parts, end2)):
            at = table.find(column)  # what a table holds may be another thing after its next call
            starts.append(table.starts[at] + total)
            sizes.append(table.sizes[at])
            flats.append(table.flat)
            total += len(table.flat)
        sizes = np.column_stack(sizes)
        flat = _gathered(np.concatenate(flats), np.column_stack(starts).ravel(), sizes.ravel())
        n = np.zeros(len(names), np.int64)
        n[plain] = sizes.sum(1)
        if plain.all():
            return flat, n
        others = [self._parts(" " + t if spaced else t) for t in names.filter(pc.invert(is_plain)).to_pylist()]
        at = self.parts.find(pa.array([x for p in others for x in p], pa.string()))
        owner = np.repeat(np.arange(len(others)), [len(p) for p in others])
        n[~plain] = np.bincount(owner, self.parts.sizes[at], len(others)).astype(np.int64)
        flat = np.concatenate([flat, _gathered(self.parts.flat, self.parts.starts[at], self.parts.sizes[at])])
        # plain chunks come first in `flat`; the caller wants them in the order of `names`
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.zeros(len(names), np.int64)
        starts[order] = np.cumsum(n[order]) - n[order]
        return _gathered(flat, starts, n), n

    def _words(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words. Many short calls cost more than a few longer ones, so words are encoded side by side; but a
        byte-level model takes a word at a time, as what the library would cut out of a text, without the search for it."""
        if self.spaced:
            tokens, ids, n = self.tokenizer.model.tokenize, [], []
            for w in words.to_pylist():
                w = w if w.isascii() else "".join([_BYTES[b] for b in w.encode()])
                own = [t.id for t in tokens("\u0120" + w if before else w)]
                ids += own
                n.append(len(own))
            return np.array(ids, np.uint32), np.array(n, np.int64)
        bounds = [*range(0, len(words), 64), len(words)]
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ").to_pylist()
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, ids in enumerate(self.whole(groups)):
            at = np.flatnonzero(self.edge[ids])
            if len(at) == bounds[i + 1] - bounds[i]:
                n = np.diff(np.append(-1, at))
            else:  # a word that isn't one after all
                ids, n = self._wholes(words.slice(bounds[i], bounds[i + 1] - bounds[i]).to_pylist())
            flat.append(ids)
            sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)

    def _parts(self, chunk: str) -> list[str]:
        """Parts of a chunk that never share a token: plain words, the punctuation after them, line ends between words."""
        if "\n" not in chunk:
            return self._word(chunk)
        pieces = chunk.split("\n")
        bare = [pieces[0][1:] if pieces[0][:1] == " " else pieces[0], *pieces[1:]]
        if not all(bare) or any(x != x.strip() for x in bare):
            return [chunk]
        out = self._word(pieces[0])
        for x in pieces[1:]:
            out += ["\n", *self._word(x)]
        return out

    def _word(self, chunk: str) -> list[str]:
        word = chunk.rstrip(".,;:!?*$%&#|")
        letters = word[1:] if word[:1] == " " else word
        if len(word) < len(chunk) and letters.isalpha() and (letters.isascii() or (max(letters) < "\u0250" and "\u0130" not in letters)):
            return [word, chunk[len(word) :]]
        return [chunk]

    def encode(self, column: pa.Array, batch_bytes: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: empty), one after another, and where each text's begin, with an end."""
        column = column.cast(pa.string()).fill_null("") if column.null_count or not pa.types.is_string(column.type) else column
        ids, ends = [], [np.zeros(1, np.int64)]
        total = 0
        for a, b in text_slices(column, batch_bytes):
            some, offsets = self._encode(column.slice(a, b - a))
            pa.default_memory_pool().release_unused()  # workers stay, with what Arrow keeps for them
            ids.append(some)
            ends.append(offsets[1:] + total)
            total += len(some)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(ends)

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsafe = _unsafe(column) if self.spaced else np.zeros(len(column), bool)
        if unsafe.any():
            wholes = dict(zip(np.flatnonzero(unsafe).tolist(), self.whole(column.filter(pa.array(unsafe)).to_pylist()), strict=True))
            column = pc.if_else(pa.array(unsafe), "", column)
        parts = pc.split_pattern(column, " ")
        values = parts.flatten()
        bounds = np.asarray(parts.offsets).astype(np.int64)
        bounds -= bounds[0]
        is_first = np.zeros(len(values), bool)
        if self.spaced:
            is_first[bounds[:-1]] = True
        sizes = np.zeros(len(values), np.int64)
        starts = np.zeros(len(values), np.int64)
        flats, total = [], 0
        for table, own in ((self.after_space, ~is_first), (self.first, is_first)):
            if own.any():
                codes = table.find(values if own.all() else values.filter(pa.array(own)))
                sizes[own], starts[own] = table.sizes[codes], table.starts[codes] + total
                flats.append(table.flat)
                total += len(table.flat)
        ids = _gathered(np.concatenate(flats) if len(flats) > 1 else flats[0], starts, sizes) if flats else np.zeros(0, np.uint32)
        after = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=after[1:])
        offsets = after[bounds]
        if unsafe.any():
            pieces = [wholes.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(column))]
            ids, offsets = np.concatenate(pieces), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in pieces])])
        return ids, offsets


def white_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that are a space; that begin a character which some table counts as white space; that end one."""
    space = raw == 0x20
    starts = space | ((raw >= 0x09) & (raw <= 0x0D)) | ((raw >= 0x1C) & (raw <= 0x1F))
    stops = starts.copy()
    if (raw >= 0xC2).any():
        two = np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0)))
        starts[two] = stops[two + 1] = True
        a, b, c = raw[:-2], raw[1:-1], raw[2:]
        wide = (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
        three = np.flatnonzero(wide)
        starts[three] = stops[three + 2] = True
    return space, starts, stops


def _unsafe(column: pa.Array) -> np.ndarray:
    """Texts in which a space stands next to other white space."""
    raw, offsets = text_bytes(column)
    out = np.zeros(len(column), bool)
    if len(raw) < 2:
        return out
    space, starts, stops = white_edges(raw)
    bad = np.flatnonzero((space[:-1] & starts[1:]) | (stops[:-1] & space[1:]))
    if len(bad):
        rows = np.searchsorted(offsets, bad, "right") - 1
        same = bad + 1 < offsets[rows + 1]
        out[rows[same]] = True
    return out
