"""Hierarchical multi-length packing of token documents into training windows.

Every document is cut into full windows of the longest tier and one rest. The rest goes to the shortest tier that
holds it. Each tier is packed on its own: a window is opened with the longest waiting rests, and what stays free in
it is filled with rests of shorter tiers, the last of them cut at the window's end. At the end of a task's documents
the waiting rests are packed into the longest windows still possible, and the last tail into descending powers of two,
so no padding arises. Windows of a tier are dealt into step groups of equal token count.

The work is one map over the documents: no shuffle, and a task holds one slice of texts and fewer waiting ids than
`HOLD` windows. Sequence ids carry the task's number in their upper bits.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from driftwood.llm import encoder, shared

#: Window lengths, longest first; each divides the one before.
TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 16384
#: Rests of a tier that may wait, in windows of that tier, before it is packed.
HOLD = 32
#: Low bits of a sequence id: its number within the task.
SEQUENCE_BITS = 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs documents in the order in which they come. Each piece is handed to `emit` with its window."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, hold: int = HOLD):
        self.tiers, self.step_tokens, self.hold = tiers, step_tokens, hold
        self.waiting: list[deque] = [deque() for _ in tiers]  # of (doc, start, ids)
        self.tokens = [0] * len(tiers)
        self.sequences = self.groups = 0
        self.open_group: dict[int, tuple[int, int]] = {}  # of a window length: the group, windows in it
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple], tier: int) -> None:
        """A window is done; it joins the open step group of its length."""
        length = sum(len(x[2]) for x in pieces)
        group, filled = self.open_group.get(tier, (-1, 0))
        if group < 0 or filled + length > self.step_tokens:
            group, filled = self.groups, 0
            self.groups += 1
        self.open_group[tier] = (group, filled + length)
        at = 0
        for doc, start, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), self.sequences, at, tier, group))
            at += len(ids)
        self.sequences += 1

    def _fill(self, level: int) -> None:
        """One window of this tier, from its own waiting rests, then from the shorter tiers."""
        room, pieces = self.tiers[level], []
        for k in range(level, len(self.tiers)):
            while room and self.waiting[k]:
                doc, start, ids = self.waiting[k].popleft()
                self.tokens[k] -= len(ids)
                if len(ids) > room:
                    self._wait(doc, start + room, ids[room:])
                    ids = ids[:room]
                pieces.append((doc, start, ids))
                room -= len(ids)
        self._close(pieces, self.tiers[level])

    def _wait(self, doc: object, start: int, ids: np.ndarray) -> None:
        level = max(k for k, w in enumerate(self.tiers) if len(ids) <= w)
        self.waiting[level].append((doc, start, ids))
        self.tokens[level] += len(ids)

    def add(self, doc: object, ids: np.ndarray) -> None:
        window, at = self.tiers[0], 0
        while len(ids) - at >= window:
            self._close([(doc, at, ids[at : at + window])], window)
            at += window
        if at < len(ids):
            self._wait(doc, at, ids[at:].copy())
        for k, w in enumerate(self.tiers):
            while self.tokens[k] > self.hold * w:
                self._fill(k)

    def finish(self) -> None:
        for k, w in enumerate(self.tiers):
            while sum(self.tokens[k:]) >= w:
                self._fill(k)
        rest = [x for q in self.waiting for x in q]
        left = sum(len(x[2]) for x in rest)
        for q in self.waiting:
            q.clear()
        self.tokens = [0] * len(self.tiers)
        while left:
            room = 1 << (left.bit_length() - 1)
            left, pieces, length = left - room, [], room
            while room:
                doc, start, ids = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:]))
                    ids = ids[:room]
                pieces.append((doc, start, ids))
                room -= len(ids)
            self._close(pieces, length)

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces of all documents, each with its sequence, offset, tier and step group.

    A null text counts as empty: its document is the end id alone. Repeated rows are packed each for itself. An empty
    table gives no rows. A null id stays null. Further columns are not read.
    """
    file = encoder.vocabulary(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(tiers, step_tokens), TaskContext.get().partitionId() << SEQUENCE_BITS
        coder = encoder.encoder(file)

        def rows() -> pa.RecordBatch:
            doc, start, length, crc, seq, at, tier, group = map(list, zip(*packer.take(), strict=True))
            name, size = zip(*doc, strict=True)
            return pa.record_batch(
                [
                    pa.array(name, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array(size, pa.int64()), pa.array(np.array(seq, np.int64) + base), pa.array(at, pa.int64()), pa.array(tier, pa.int32()), pa.array(np.array(group, np.int64) + base),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

        for part in shared.slices(batches):
            ids, bounds = encoder.with_end(*coder.encode(part.column("text")), end_id)
            ids = ids.astype("<u4")
            for k, name in enumerate(part.column("doc_id").to_pylist()):
                packer.add((name, int(bounds[k + 1] - bounds[k])), ids[bounds[k] : bounds[k + 1]])
            if packer.rows:
                yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(task, SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
