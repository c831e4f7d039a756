"""Exact tokenizer ids at batch speed: texts are cut where no token or normalisation can cross, each distinct
piece is encoded once by the tokenizers library, and the batch is put together from the pieces by array look-ups.

Cuts, all between two characters that are plainly not white space in any reading (printable ASCII or a two-byte
character other than U+0080 to U+00BF):
- before a single space;
- on both sides of a single line feed;
- between an ASCII letter or digit, or a Latin-1 letter, and ASCII punctuation.
Both public vocabularies start a new pre-token at each of these places, whatever stands around.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from driftwood.llm.shared import buffers, held, mix64, ranges

#: Distinct pieces that a worker remembers; beyond it starts anew.
CACHE_PIECES = 800_000
#: Longer pieces are encoded each time.
CACHE_BYTES = 200
#: Bytes of pieces beyond which the memory starts anew.
CACHE_TEXT = 16 << 20

#: One pre-token in both vocabularies, unchanged by NFC: these go to the merges directly.
_WORD = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)")
#: Byte-level alphabets write the bytes that don't print as the characters from U+0100.
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: b for b in _PRINT} | {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in set(_PRINT))}

_SOLID, _LETTER, _PUNCT, _LEAD = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SOLID | _PUNCT
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _KIND[_lo : _hi + 1] = _SOLID | _LETTER
_KIND[0xC3:0xE0] = _LEAD


def cut_places(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte positions at which pieces start; each non-empty text starts one."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[raw]
    cut = np.zeros(n, bool)
    solid = (kind & _SOLID) != 0
    ends = solid.copy()  # this byte ends a character that is no white space
    lead = (kind & _LEAD) != 0
    ends[1:] |= lead[:-1]
    begins = solid | lead
    if n > 2:
        around = ends[:-2] & begins[2:]
        cut[1:-1] |= around & (raw[1:-1] == 0x20)
        feed = around & (raw[1:-1] == 0x0A)
        cut[1:-1] |= feed
        cut[2:] |= feed
    letter = (kind & _LETTER) != 0
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut[1:] |= letter[:-1] & ((kind[1:] & _PUNCT) != 0)
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[starts] = True
    return np.flatnonzero(cut)


_FIXED = np.random.default_rng(20240229)
_BYTE_KEY = _FIXED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_KEY = _FIXED.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def piece_keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each piece's bytes and length, never 0. Every place has a factor of its own."""
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
    factor = _PLACE_KEY[place & 4095]
    far = np.flatnonzero(place > 4095)
    if len(far):
        factor[far] = mix64(place[far].astype(np.uint64) + np.uint64(0x71A5)) | np.uint64(1)
    return mix64(np.add.reduceat(_BYTE_KEY[raw] * factor, starts) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class KeyTable:
    """Open addressing from non-zero 64-bit keys to row numbers, for whole arrays at a time."""

    def __init__(self, rows: int):
        self.mask = (1 << (2 * rows - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.rows = np.zeros(self.mask + 1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            there = self.keys[slot]
            same = there == keys[todo]
            out[todo[same]] = self.rows[slot[same]]
            on = ~same & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])  # of several for one slot the last has it
            self.rows[slot[won]] = rows[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists one after another, and their lengths."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


class PieceCache:
    """What a worker has learned about pieces: the ids of each, under its key, with its bytes.

    A piece counts as known only if its bytes are those remembered; of pieces that share a key by chance the later ones
    are learned each time.
    """

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.known = KeyTable(2 * CACHE_PIECES)
        self.ids = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 16, np.int64)  # of piece i: bounds[i] to bounds[i + 1]
        self.text = np.zeros(1 << 18, np.uint8)
        self.spots = np.zeros(1 << 16, np.int64)  # of its bytes, likewise
        self.count = 0

    def _append(self, ids: np.ndarray, lengths: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of new pieces."""
        first = self.count
        self.ids, self.bounds = grown(self.ids, self.bounds, first, ids, lengths)
        self.text, self.spots = grown(self.text, self.spots, first, text, sizes)
        self.count += len(lengths)
        return np.arange(first, self.count)

    def _same(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes remembered under its row."""
        out = self.spots[row + 1] - self.spots[row] == lengths
        if not out.all():  # only those of equal length are compared
            out[out] = self._same(raw, starts[out], lengths[out], row[out])
            return out
        wrong = np.flatnonzero(raw[ranges(starts, lengths)] != self.text[ranges(self.spots[row], lengths)])
        if len(wrong):
            out[np.searchsorted(np.cumsum(lengths), wrong, side="right")] = False
        return out

    def _learned(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, learn: Callable) -> np.ndarray:
        ids, counts = learn([raw[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], keys)
        sizes = np.where(lengths <= CACHE_BYTES, lengths, 0)  # the bytes of those that are learned each time aren't kept
        return self._append(ids, counts, raw[ranges(starts, sizes)], sizes)

    def ids_of(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, learn: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and the n + 1 offsets of the pieces in them.

        `learn` gives the ids of new pieces one after another and how many each has, from their bytes and keys.
        """
        place = self.rows_of(raw, starts, lengths, keys, learn)
        begin = self.bounds[place]
        lengths = self.bounds[place + 1] - begin
        return self.ids[ranges(begin, lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def rows_of(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, learn: Callable) -> np.ndarray:
        """The number of each piece."""
        if self.count > CACHE_PIECES or len(self.text) > CACHE_TEXT:
            self._clear()
        place = np.full(len(keys), -1)
        long = np.flatnonzero(lengths > CACHE_BYTES)
        if len(long):
            place[long] = self._learned(raw, starts[long], lengths[long], keys[long], learn)
        short = np.flatnonzero(lengths <= CACHE_BYTES)
        starts, lengths, keys = starts[short], lengths[short], keys[short]
        row = self.known.find(keys)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new, first, where = np.unique(keys[missing], return_index=True, return_inverse=True)
            which = missing[first]
            mine = self._learned(raw, starts[which], lengths[which], new, learn)
            row[missing] = mine[where]
            keep = mine < 3 * CACHE_PIECES
            self.known.add(new[keep], mine[keep])
        other = np.flatnonzero(~self._same(raw, starts, lengths, row)) if len(row) else row
        if len(other):  # another piece has the same key
            row[other] = self._learned(raw, starts[other], lengths[other], keys[other], learn)
        place[short] = row
        return place


def grown(values: np.ndarray, bounds: np.ndarray, rows: int, more: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and their bounds with further rows; the arrays are doubled when they are full."""
    begin = int(bounds[rows])
    while begin + len(more) > len(values):
        values = np.concatenate([values, np.zeros_like(values)])
    while rows + len(lengths) + 1 > len(bounds):
        bounds = np.concatenate([bounds, np.zeros_like(bounds)])
    values[begin : begin + len(more)] = more
    bounds[rows + 1 : rows + len(lengths) + 1] = begin + np.cumsum(lengths)
    return values, bounds


class PieceEncoder(PieceCache):
    """Encodes string arrays; keeps what it has learned about pieces for the life of the worker."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.folds = json.loads(self.tokenizer.to_str())["normalizer"] is not None  # lower case, white space dropped

    def _learn(self, pieces: list[bytes], _keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        merge, folds, word_of = self.tokenizer.model.tokenize, self.folds, _WORD.fullmatch
        lists: list[list[int]] = []
        rest: list[int] = []
        texts = [p.decode("utf-8") for p in pieces]
        for k, text in enumerate(texts):
            if m := word_of(text):
                word = m[2].lower() if folds else text
                if not folds or not word.isascii():
                    word = word.encode("utf-8").decode("latin-1").translate(_BYTE_LEVEL)
                lists.append([t.id for t in merge(word)])
            else:
                lists.append([])
                rest.append(k)
        for k, x in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            lists[k] = x.ids
        return flat(lists)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (int32), and the n + 1 offsets of the texts in them; null counts as empty."""
        raw, offsets = buffers(texts)
        starts = cut_places(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(starts, append=len(raw))
        ids, bounds = self.ids_of(raw, starts, lengths, piece_keys(raw, starts, lengths), self._learn)
        return ids, bounds[np.searchsorted(starts, offsets)]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary."""
    return held(("pieces", path), lambda: PieceEncoder(path))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(bounds) - 1
    new = bounds + np.arange(n + 1)
    out = np.empty(len(ids) + n, np.int32)
    mask = np.ones(len(out), bool)
    mask[new[1:] - 1] = False
    out[mask] = ids
    out[new[1:] - 1] = end_id
    return out, new
