"""Language identification by a linear-chain conditional random field over words.

Each word has a language label. A word's features are its character n-grams of 1 to 4 bytes with marked ends (so the
outer ones are its affixes) and the whole word (the lexicon); all are hashed into one weight table. Label-to-label weights
are learned, so code-switched text keeps its runs. Forward-backward gives each word's label probabilities, and a
document's language is the one with the largest sum over its words.

Forward-backward runs over all documents of a slice at once: a word is a matrix (moves times emissions), a document's
first word one that forgets what stood before, and the running products are taken in blocks, so that very long
documents cost no more steps than short ones.

Fitting reads at most MAX_TRAINING_DOCS labelled documents (whole texts; the ones of smallest hash), cut into stretches
of words that are shuffled into one chain, so that label changes occur in it.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftwood.llm import shared
from driftwood.llm.encoder import KeyTable, piece_keys

#: Bound on the labelled documents that the model is fitted on.
MAX_TRAINING_DOCS = 600
#: Bound on the bytes of their texts; a text that would exceed it is left out whole.
MAX_TRAINING_BYTES = 8 << 20
#: Bound on the words of them that enter the chain; a hash of place decides, over whole texts.
MAX_TRAINING_WORDS = 200_000
TABLE_BITS = 15
STEPS = 12
#: Distinct words whose emissions a worker remembers.
CACHE_WORDS = 600_000
#: Bytes of text that a task labels at a time: the messages of its words take some tens of times as much.
LABEL_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and other characters' bytes that hold a letter, in lower case: their bytes one after
    another, where each starts, how long it is, and the text that it is in."""
    keep = _LETTER[raw]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[begins] = keep[begins]
    low = _LOWER[raw]
    if len(low) > 1:  # Latin-1 capitals: C3 80 to C3 9E but C3 97
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][capital] += 32
    letters = low[keep]
    at = np.flatnonzero(first)
    place = np.cumsum(keep) - 1
    starts = place[at] if len(at) else np.zeros(0, np.int64)
    lengths, doc = np.diff(starts, append=len(letters)), np.searchsorted(offsets, at, side="right") - 1
    real = _with_letter(letters, starts, lengths)
    if not real.all():
        letters, doc, lengths = letters[np.repeat(real, lengths)], doc[real], lengths[real]
        starts = np.cumsum(lengths) - lengths
    return letters, starts, lengths, doc


@functools.cache
def _alphabet() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _with_letter(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which runs hold a letter; those without an ASCII letter are decoded."""
    if not len(starts):
        return np.zeros(0, bool)
    out = np.logical_or.reduceat(letters < 0x80, starts)
    other = np.flatnonzero(~out)
    if len(other):
        raw = letters[shared.ranges(starts[other], lengths[other])].astype(np.int64)
        owner = np.repeat(other, lengths[other])
        lead = np.flatnonzero(raw >= 0xC0)
        first = raw[lead]
        one, two, three = (raw[np.minimum(lead + k, len(raw) - 1)] & 0x3F for k in (1, 2, 3))
        code = np.where(first < 0xE0, (first & 0x1F) << 6 | one, np.where(first < 0xF0, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three))
        out[owner[lead[_alphabet()[np.minimum(code, 0x10FFFF)]]]] = True
    return out


def features_of(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words' features one after another, and how many each word has."""
    # with an end mark (byte 1) before and behind each word
    size = lengths + 2
    begin = np.cumsum(size) - size
    text = np.ones(int(size.sum()), np.uint64)
    text[shared.ranges(begin + 1, lengths)] = letters[shared.ranges(starts, lengths)]
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(begin + size, size) - np.arange(len(text))  # bytes from here to the word's end
    rows, owners = [], []
    for n in range(1, 5):
        value = np.zeros(len(text), np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + np.roll(text, -k)
        ok = left >= n
        if n == 1:
            ok &= text != 1
        rows.append(shared.mix64(value[ok] + _MIX[n]) >> np.uint64(64 - TABLE_BITS))
        owners.append(owner[ok])
    rows.append(shared.mix64(piece_keys(text.astype(np.uint8), begin, size) + _MIX[0]) >> np.uint64(64 - TABLE_BITS))
    owners.append(np.arange(len(size)))
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    return np.concatenate(rows)[order].astype(np.int64), np.bincount(owners_all, minlength=len(size))


class Model(NamedTuple):
    langs: tuple[str, ...]
    emit: np.ndarray  # of each table row and language
    move: np.ndarray  # from language to language


def emissions(model: Model, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The emission scores of distinct words, the sums of their features' weights."""
    rows, counts = features_of(letters, starts, lengths)
    return np.add.reduceat(model.emit[rows], np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, len(model.langs)))


def posteriors(scores: np.ndarray, move: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of a chain of documents; fresh: words that begin one."""
    if not len(scores):
        return scores
    before, _, behind = messages(scores, move, fresh)
    p = before * behind
    return p / p.sum(axis=1, keepdims=True)


def pair_posteriors(before: np.ndarray, weight: np.ndarray, behind: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The probabilities of each two labels in a row, of all neighbours of one chain, from its messages."""
    pairs = before[:-1, :, None] * np.exp(move - move.max()) * (weight * behind)[1:, None, :]
    return pairs / pairs.sum(axis=(1, 2), keepdims=True)


def messages(scores: np.ndarray, move: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward vectors (with each word's own weight), the weights, and backward vectors, each up to a factor a word."""
    n, k = scores.shape
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    weight = np.ones((rows * width, k))
    weight[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    new = np.ones(rows * width, bool)  # what fills the last block tells nothing about the chain
    new[:n] = fresh
    hop = np.exp(move - move.max())
    weight, new = weight.reshape(rows, width, k), new.reshape(rows, width)
    even = np.full((k, k), 1.0 / k)

    def passes(order: range, forward: bool) -> np.ndarray:
        """Vectors at each place: of what stands before and at it, or of what stands behind it."""
        through = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
        for j in order:
            if forward:
                step = np.where(new[:, j, None, None], even, hop) * weight[:, j, None, :]
                through = through @ step
            else:
                step = np.where(new[:, j, None, None], even, hop) * weight[:, j, None, :]
                through = step @ through
            through /= through.sum(axis=(1, 2), keepdims=True)
        carry = np.empty((rows, k))
        v = np.full(k, 1.0 / k)
        for r in range(rows) if forward else range(rows - 1, -1, -1):
            carry[r] = v
            v = v @ through[r] if forward else through[r] @ v
            v /= v.sum()
        out = np.empty((rows, width, k))
        v = carry
        for j in order:
            if forward:
                v = np.where(new[:, j, None], v.sum(axis=1, keepdims=True) / k, v @ hop) * weight[:, j]
                v /= v.sum(axis=1, keepdims=True)
                out[:, j] = v
            else:
                out[:, j] = v
                u = weight[:, j] * v
                v = np.where(new[:, j, None], u.sum(axis=1, keepdims=True) / k, u @ hop.T)
                v /= v.sum(axis=1, keepdims=True)
        return out

    return tuple(x.reshape(-1, k)[:n] for x in (passes(range(width), True), weight, passes(range(width - 1, -1, -1), False)))


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7, max_words: int = MAX_TRAINING_WORDS) -> Model:
    """Maximum conditional likelihood by AdaGrad over the whole chain."""
    names = tuple(sorted(set(langs)))
    k = len(names)
    raw, offsets = shared.buffers(pa.array(texts, pa.large_string()))
    letters, starts, lengths, doc = words_of(raw, offsets)
    if not len(starts) or k < 2:
        return Model(names, np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k)))
    label = np.array([names.index(x) for x in langs])[doc]
    if len(starts) > max_words:  # stretches of 32 words by the hash of their place
        chosen = shared.mix64(np.arange(len(starts), dtype=np.uint64) >> np.uint64(5)) < np.uint64(int(2**64 * (max_words / len(starts))) - 1)
        starts, lengths, label, doc = starts[chosen], lengths[chosen], label[chosen], doc[chosen]
    _, first, word = np.unique(piece_keys(letters, starts, lengths) if len(starts) == len(letters) else _keys(letters, starts, lengths), return_index=True, return_inverse=True)
    rng = np.random.default_rng(seed)
    stretch = np.cumsum(np.diff(doc, prepend=-1) != 0) * 1_000_003 + np.arange(len(doc)) // 24
    order = np.lexsort((np.arange(len(doc)), rng.permutation(int(stretch.max()) + 1 if stretch.max() < 10_000_000 else 10_000_000)[stretch % 10_000_000]))
    word, label = word[order], label[order]
    rows, counts = features_of(letters, starts[first], lengths[first])
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    emit, move = np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k))
    seen, moves = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    truth = np.zeros((len(word), k))
    truth[np.arange(len(word)), label] = 1
    pairs = np.zeros((k, k))
    np.add.at(pairs, (label[:-1], label[1:]), 1)
    fresh = np.zeros(len(word), bool)
    fresh[0] = True
    for _ in range(steps):
        before, weight, behind = messages(np.add.reduceat(emit[rows], begin, axis=0)[word], move, fresh)
        p = before * behind
        p /= p.sum(axis=1, keepdims=True)
        joint = pair_posteriors(before, weight, behind, move)
        off = np.stack([np.bincount(word, (truth - p)[:, j], len(counts)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(rows, off[owner, j], len(emit)) for j in range(k)], axis=1) / len(word) - 1e-7 * emit
        seen += grad * grad
        emit += 0.3 * grad / np.sqrt(seen)
        grad = (pairs - joint.sum(axis=0)) / len(word)
        moves += grad * grad
        move += 0.3 * grad / np.sqrt(moves)
    return Model(names, emit, move)


def _keys(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of some of the words."""
    begin = np.cumsum(lengths) - lengths
    return piece_keys(letters[shared.ranges(starts, lengths)], begin, lengths)


class Labeller:
    """Labels slices of texts; remembers the emissions of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known, self.scores, self.count = KeyTable(2 * CACHE_WORDS), np.zeros((1 << 14, len(self.model.langs)), np.float32), 0

    def _scores(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.count > CACHE_WORDS:
            self._clear()
        keys = piece_keys(letters, starts, lengths)
        place = self.known.find(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first, where = np.unique(keys[missing], return_index=True, return_inverse=True)
            which = missing[first]
            while self.count + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            row = np.arange(self.count, self.count + len(new))
            for part in np.array_split(np.arange(len(new)), len(new) // 50_000 + 1):
                self.scores[row[part]] = emissions(self.model, letters, starts[which[part]], lengths[which[part]])
            place[missing] = row[where]
            keep = row < 3 * CACHE_WORDS
            self.known.add(new[keep], row[keep])
            self.count += len(new)
        return self.scores[place].astype(np.float64)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words, and the text that each is in."""
        raw, offsets = shared.buffers(texts)
        letters, starts, lengths, doc = words_of(raw, offsets)
        if not len(starts):
            return np.zeros((0, len(self.model.langs))), doc
        return posteriors(self._scores(letters, starts, lengths), self.model.move, np.diff(doc, prepend=-1) != 0), doc

    def documents(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the words; und and 0 without a letter."""
        n, k = len(texts), len(self.model.langs)
        if not k:
            return ["und"] * n, np.zeros(n)
        p, doc = self.words(texts)
        total = np.stack([np.bincount(doc, p[:, j], n) for j in range(k)], axis=1)
        count = np.bincount(doc, minlength=n)
        best = total.argmax(axis=1)
        some = count > 0
        score = np.where(some, total[np.arange(n), best] / np.maximum(count, 1), 0.0)
        return [self.model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.clip(score, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; null ids are not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_TRAINING_DOCS, max_bytes: int = MAX_TRAINING_BYTES) -> Model:
    """Fitted on a bounded sample of the labelled documents: whole texts, in the order of the hash of their ids, as far as
    both bounds allow.

    Without labelled documents the model knows no language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    some = shared.hashed_sample(labelled, "doc_id", max_docs, labelled.count()).where("text is not null")
    some = some.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    order, room, chosen = ["h", "doc_id", "t", "lang"], max_bytes, []
    for r in some.select(*order, F.octet_length("text").alias("n")).distinct().orderBy(*order).limit(max_docs).collect():  # sizes, not texts
        if r.n <= room:
            room -= r.n
            chosen.append((r.h, r.t, r.lang))
    if not chosen:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(chosen, "h long, t long, lang string")
    rows = some.join(F.broadcast(wanted), ["h", "t", "lang"]).dropDuplicates(order).orderBy(*order).collect()
    return fit([r.text for r in rows], [r.lang for r in rows])


def _labeller(model: Model) -> Labeller:
    return shared.held(("labels", zlib.crc32(model.emit.tobytes()), model.langs), lambda: Labeller(model))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred and score. Only texts are looked at.

    Null texts and texts without a letter are und with score 0; repeated rows are labelled alike; all rows and columns
    stay, but columns that already bear these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Model(model.langs, model.emit.astype(np.float32), model.move))  # a table of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(sent.value)
        for part in shared.slices(batches, limit=LABEL_BYTES):
            langs, scores = labeller.documents(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])
        shared.give_back()

    schema = type(docs.schema)(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(task, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    told = identify(docs.select("doc_id", "text"), train(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
