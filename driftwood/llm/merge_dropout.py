"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Words are built up from characters by an agenda of merges, best score first, then leftmost. Each candidate merge is
skipped when a keyed hash of the document, the word's number in it, the place in the word and the piece falls under the
dropout rate. So every occurrence of a word is cut on its own, a seed gives the same segmentation on any machine and
partitioning, and another seed or epoch another.

A worker remembers each word's segmentation without dropout, with the candidates that its agenda meets. An occurrence
whose hash drops none of them has just that segmentation; the others are merged one by one, many at a time.

Words begin at a space, which no piece of the vocabulary has inside; so words don't affect each other. Without dropout
the ids are those of the sentencepiece library, but for texts that hold the mark U+2581 itself, which is written in
byte pieces here so that decoding gives it back.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from driftwood.llm import encoder, shared

DROPOUT = 0.1
MARK = "▁"
#: Words of more characters, or with some that are no pieces, are merged by a heap, the others many at a time.
SCAN = 32
_NONE = 1 << 30
_PLACE, _PIECE = 0x9E3779B1, 0x85EBCA77


def _mixed(places: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return places.astype(np.uint32) * np.uint32(_PLACE) + pieces.astype(np.uint32) * np.uint32(_PIECE)


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return shared.mix64((left.astype(np.uint64) << np.uint64(20)) + right.astype(np.uint64) + np.uint64(1))


class MergeDropout(encoder.PieceCache):
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = 0):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.table = pa.array(self.bytes_of, pa.large_binary())
        self.byte_ids = {self.bytes_of[i][0]: i for i in range(n) if model.is_byte(i)}
        plain = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        chars = dict(plain)
        for p in plain:  # a character that only occurs inside pieces can be merged, not written
            for c in p:
                chars.setdefault(c, len(names) + len(chars))
        self.chars = {c: i for c, i in chars.items() if len(c) == 1 and c != MARK} | {" ": chars[MARK]}
        self.text_of = {i: c for c, i in chars.items()}
        self.last = n
        # of each pair of symbols whose joint text is a piece: its rank (0 is best) and id
        rank = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-model.get_score(i), i)))}
        self.pairs = {(chars[p[:k]], chars[p[k:]]): (rank[i], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in chars and p[k:] in chars}
        left, right = np.array(list(self.pairs), np.int64).T
        self.pair_rank, self.pair_piece = np.array(list(self.pairs.values()), np.int64).T
        self.pair_table = encoder.KeyTable(2 * len(left))
        self.pair_table.add(_pair_keys(left, right), np.arange(len(left)))
        self.symbol_of = np.full(1 << 16, -1, np.int64)  # of characters that are pieces; the others go the slow way
        for c, i in self.chars.items():
            if ord(c) < len(self.symbol_of) and i < n:
                self.symbol_of[ord(c)] = i
        self.limit, self.seed = round(dropout * (1 << 32)), seed

    def _clear(self) -> None:
        super()._clear()
        self.met = np.zeros(1 << 18, np.uint32)  # the candidates of the words without dropout, place and piece in one
        self.met_at = np.zeros(1 << 16, np.int64)

    def occurrence_keys(self, ids: list[int | None], doc: np.ndarray) -> np.ndarray:
        """A 32-bit key for each word from its document's id and its number there; `doc` is ascending."""
        known = np.array([0 if i is None else i & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64)
        base = shared.mix64(shared.mix64(known + np.uint64(0x51ED27)) ^ np.uint64(self.seed & 0xFFFFFFFFFFFFFFFF))
        count = np.bincount(doc, minlength=len(ids))
        number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        return (shared.mix64(base[doc] + number.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)

    def _dropped(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Whether the keyed hash drops each candidate (uint32: key, and place and piece in one)."""
        x = keys ^ mixed
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        return x < self.limit

    def _skips(self, key: int, place: int, piece: int) -> bool:
        """The same of one candidate."""
        low, x = 0xFFFFFFFF, key ^ (place * _PLACE + piece * _PIECE & 0xFFFFFFFF)
        x = (x ^ (x >> 16)) * 0x7FEB352D & low
        x = (x ^ (x >> 15)) * 0x846CA68B & low
        return (x ^ (x >> 16)) < self.limit

    def _candidates(self, left: np.ndarray, right: np.ndarray, keys: np.ndarray | None, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; _NONE where it is no piece or is skipped (with keys)."""
        found = self.pair_table.find(_pair_keys(left.ravel(), right.ravel())).reshape(left.shape)
        piece = self.pair_piece[found].astype(np.int64)
        rank = np.where(found >= 0, self.pair_rank[found], _NONE)
        if keys is not None and self.limit:
            rank[self._dropped(np.broadcast_to(keys, piece.shape), _mixed(places, piece))] = _NONE
        return rank, piece

    def _merge_all(self, symbols: np.ndarray, keys: np.ndarray | None, met: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges in all words of one length at a time; gives the rows that are done with their symbols.

        A step makes the best merge of each word, so the words still at work are always of one length. Without keys no
        candidate is skipped, and `met` gets them: rows, and place and piece in one.
        """
        rows = np.arange(len(symbols))
        places = np.broadcast_to(np.arange(symbols.shape[1]), symbols.shape)
        if symbols.shape[1] < 2:
            yield rows, symbols
            return
        rank, piece = self._candidates(symbols[:, :-1], symbols[:, 1:], None if keys is None else keys[:, None], places[:, :-1])
        if met is not None:
            i, j = np.nonzero(rank < _NONE)
            met.append((i, _mixed(j, piece[i, j])))
        while symbols.shape[1] > 1:
            best = rank.argmin(axis=1)  # the leftmost
            line = np.arange(len(rows))
            going = rank[line, best] < _NONE
            if not going.all():
                yield rows[~going], symbols[~going]
                rows, symbols, places, rank, piece, best = (x[going] for x in (rows, symbols, places, rank, piece, best))
                line = np.arange(len(rows))
            if not len(rows):
                return
            width = symbols.shape[1]
            symbols[line, best] = piece[line, best]
            keep = np.ones(symbols.shape, bool)
            keep[line, best + 1] = False
            symbols, places = symbols[keep].reshape(len(rows), width - 1), places[keep].reshape(len(rows), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[line, best] = False
            rank, piece = rank[keep].reshape(len(rows), width - 2), piece[keep].reshape(len(rows), width - 2)
            for at in (best - 1, best):
                inside = (at >= 0) & (at < width - 2)
                i, j = line[inside], at[inside]
                r, p = self._candidates(symbols[i, j], symbols[i, j + 1], None if keys is None else keys[rows[i]], places[i, j])
                rank[i, j], piece[i, j] = r, p
                if met is not None:
                    new = r < _NONE
                    met.append((rows[i[new]], _mixed(places[i, j][new], p[new])))
        yield rows, symbols

    def _merged(self, words: list[bytes], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many words one after another and how many each has; without keys nothing is skipped, and the
        candidates follow, likewise."""
        points = np.frombuffer(b"".join(words).decode("utf-8").encode("utf-32-le"), "<u4")
        lead = np.frombuffer(b"".join(words), np.uint8) & 0xC0 != 0x80
        size = np.fromiter(map(len, words), np.int64, len(words))
        length = np.add.reduceat(lead.astype(np.int64), np.cumsum(size) - size)
        starts = np.cumsum(length) - length
        symbol = np.where(points < len(self.symbol_of), self.symbol_of[np.minimum(points, len(self.symbol_of) - 1)], -1)
        plain = (np.minimum.reduceat(symbol, starts) >= 0) & (length <= SCAN)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        owners, mixed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for n in np.unique(length[plain]).tolist():
            for mine in np.array_split(which := np.flatnonzero(plain & (length == n)), -(-len(which) * n // 1_000_000)):
                met: list | None = [] if keys is None else None
                done += [(mine[rows], out) for rows, out in self._merge_all(symbol[starts[mine][:, None] + np.arange(n)], None if keys is None else keys[mine], met)]
                owners += [mine[i] for i, _ in met or ()]
                mixed += [m for _, m in met or ()]
        slow = np.flatnonzero(~plain)
        lists = []
        for k in slow.tolist():
            met = [] if keys is None else None
            lists.append(self.segment(words[k], None if keys is None else int(keys[k]), met))
            owners.append(np.full(len(met or ()), k))
            mixed.append(np.array(met or (), np.uint32))
        sizes = np.zeros(len(words), np.int64)
        for rows, out in done:
            sizes[rows] = out.shape[1]
        sizes[slow] = [len(x) for x in lists]
        begin = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int32)
        for rows, out in done:
            ids[begin[rows][:, None] + np.arange(out.shape[1])] = out
        for k, x in zip(slow.tolist(), lists, strict=True):
            ids[begin[k] : begin[k] + len(x)] = x
        owner = np.concatenate(owners)
        return ids, sizes, np.concatenate(mixed)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def learn(self, words: list[bytes], _keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words without dropout one after another, and how many each has."""
        ids, sizes, mixed, counts = self._merged(words, None)
        self.met, self.met_at = encoder.grown(self.met, self.met_at, self.count, mixed, counts)
        return ids, sizes

    def segment(self, word: bytes, key: int | None, met: list | None = None) -> list[int]:
        """The ids of one word of any length, by an agenda; without a key nothing is skipped."""
        out: list[int] = []
        for s in self._heap([self.chars.get(c, -1 - ord(c)) for c in word.decode("utf-8")], key, met):
            if 0 <= s < self.last:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in (chr(-1 - s) if s < 0 else self.text_of[s]).encode()]
        return out

    def _heap(self, symbols: list[int], key: int | None, met: list | None) -> list[int]:
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := pairs.get((symbols[i], symbols[j]))) and not (key is not None and self.limit and self._skips(key, i, found[1])):
                if met is not None:
                    met.append(i * _PLACE + found[1] * _PIECE & 0xFFFFFFFF)
                heapq.heappush(agenda, (found[0], i, found[1], symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while agenda:
            _, i, piece, left, right = heapq.heappop(agenda)
            if gone[i] or symbols[i] != left or (j := after[i]) >= n or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = piece, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def encode(self, texts: pa.Array, names: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the n + 1 offsets of the texts in them, and the bytes with the space before each text, with offsets."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        raw, offsets = shared.buffers(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))))
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), raw, offsets
        cut = raw == 0x20
        cut[1:] &= raw[:-1] != 0x20
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(raw))
        keys = self.occurrence_keys(names, np.searchsorted(offsets, starts, side="right") - 1)
        sizes = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(lengths <= encoder.CACHE_BYTES)
        row = self.rows_of(raw, starts[short], lengths[short], encoder.piece_keys(raw, starts, lengths)[short], self.learn)
        count = self.met_at[row + 1] - self.met_at[row] if self.limit else np.zeros(len(row), np.int64)
        other = np.zeros(len(short), bool)
        if count.any():
            gone = self._dropped(np.repeat(keys[short], count), self.met[shared.ranges(self.met_at[row], count)])
            some = count > 0
            other[some] = np.logical_or.reduceat(gone, (np.cumsum(count) - count)[some])
        usual, row = short[~other], row[~other]
        begin = self.bounds[row]
        sizes[usual] = self.bounds[row + 1] - begin
        cut_anew = np.sort(np.concatenate([short[other], np.flatnonzero(lengths > encoder.CACHE_BYTES)]))
        new = np.zeros(0, np.int32)
        if len(cut_anew):
            data = raw.tobytes()
            new, sizes[cut_anew], _, _ = self._merged([data[a : a + n] for a, n in zip(starts[cut_anew].tolist(), lengths[cut_anew].tolist(), strict=True)], keys[cut_anew])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(int(bounds[-1]), np.int32)
        ids[shared.ranges(bounds[usual], sizes[usual])] = self.ids[shared.ranges(begin, sizes[usual])]
        ids[shared.ranges(bounds[cut_anew], sizes[cut_anew])] = new
        return ids, bounds[np.searchsorted(starts, offsets)], raw, offsets

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts with the space before each, and the n + 1 offsets of the texts in them."""
        pieces = self.table.take(pa.array(ids, pa.int64()))
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        raw = np.frombuffer(pieces.buffers()[2], np.uint8)[: ends[-1]] if len(ids) else np.zeros(0, np.uint8)
        return raw, ends[bounds]


def merges(path: str, dropout: float, seed: int) -> MergeDropout:
    """The worker's segmenter of a vocabulary, rate and seed."""
    return shared.held(("merges", path, dropout, seed), lambda: MergeDropout(path, dropout, seed))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = 0, vocabulary: str = "piece_bpe_32k.model", digest: bool = False) -> DataFrame:
    """doc_id, ids; or with digest: doc_id, n_ids, ids_crc32, n_bytes, decoded_crc32, lossless.

    A null text counts as empty and has no ids. A null id counts as id 0. Repeated rows are encoded alike.
    An empty table gives no rows. Further columns are not read. decoded_crc32 is of the text that decode() gives.
    """
    path = encoder.vocabulary(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path, dropout, seed)
        for part in shared.slices(batches):
            names = part.column("doc_id")
            ids, bounds, raw, offsets = model.encode(part.column("text"), names.to_pylist())
            if not digest:
                yield pa.record_batch([names, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])
                continue
            back, at = model.decode(ids, bounds)
            same = np.diff(at) == np.diff(offsets)
            ids = ids.astype("<u4")
            crcs, texts, lossless = [], [], []
            for k in range(part.num_rows):
                crcs.append(zlib.crc32(ids[bounds[k] : bounds[k + 1]]))
                text = back[at[k] + (at[k + 1] > at[k]) : at[k + 1]]
                texts.append(zlib.crc32(text))
                lossless.append(bool(same[k]) and np.array_equal(text, raw[offsets[k] + (offsets[k + 1] > offsets[k]) : offsets[k + 1]]))
            n_bytes = np.diff(offsets) - (np.diff(offsets) > 0)
            yield pa.record_batch([names, pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()), pa.array(n_bytes), pa.array(texts, pa.int64()), pa.array(lossless)], names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "decoded_crc32", "lossless"])

    return _read(docs).mapInArrow(task, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, decoded_crc32 long, lossless boolean" if digest else "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give the empty text."""
    path = encoder.vocabulary(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path, 0.0, 0)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw, at = model.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            data = raw.tobytes()
            yield pa.record_batch([batch.column("doc_id"), pa.array([data[a + (b > a) : b].decode("utf-8") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def op6_merge_dropout(spark, sf_dir: str) -> DataFrame:
    return encode(shared.table(spark, sf_dir, "documents"), digest=True)
