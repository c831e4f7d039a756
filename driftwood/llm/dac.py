"""Token files of directly addressable codes: random access to any id without decoding a block.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id; a continuation bitmap
says which ids go on, and level k + 1 holds the next chunk of those alone. A rank directory counts the set bits before
each group of 512, so the place of an id's next chunk is one directory entry and at most 64 bytes of bitmap away.

A file is a table in shared storage (Parquet, written by Spark, so a lost executor's shard is written again and a half
one never seen). A row is a shard: consecutive documents in ascending order of id, with the codes as binary columns
and a directory of the documents' bounds. Shards hold about SHARD_TOKENS ids, or one longer document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from driftwood.llm import encoder, shared

SHARD_TOKENS = 1 << 20
RANK_BITS = 512
#: part: the task that wrote it, ascending with doc ids; shard: its number there; first_token: ids before it in the part.
FILE_SCHEMA = "part int, shard int, first_token long, n_tokens long, doc_ids array<long>, doc_bounds binary, levels array<binary>, bitmaps array<binary>, ranks array<binary>"
TOKENS_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"


class Codes:
    """The codes of one shard."""

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            levels.append((rest & np.uint32(0xFF)).astype(np.uint8))
            more = rest > 0xFF
            if not more.any():
                return cls(levels, bitmaps, ranks)
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits)
            counts = np.add.reduceat(np.bitwise_count(bits).astype(np.uint32), np.arange(0, len(bits), RANK_BITS // 8))
            ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4"))
            rest = rest[more] >> np.uint32(8)

    def __getitem__(self, i: int) -> int:
        """One id: at each level its chunk, then the rank of its continuation bit."""
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[i]) << (8 * k)
            if k == len(self.bitmaps) or not self.bitmaps[k][i >> 3] >> (i & 7) & 1:
                break
            group = i // RANK_BITS
            begin = group * RANK_BITS // 8
            whole = int(np.bitwise_count(self.bitmaps[k][begin : i >> 3]).sum())
            last = int(self.bitmaps[k][i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(self.ranks[k][group]) + whole + last.bit_count()
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        out = self.levels[-1].astype(np.uint32)
        for level, bits in zip(reversed(self.levels[:-1]), reversed(self.bitmaps), strict=True):
            upper, out = out, level.astype(np.uint32)
            out[np.unpackbits(bits, count=len(level), bitorder="little").astype(bool)] |= upper << np.uint32(8)
        return out

    @classmethod
    def from_row(cls, row: dict) -> Codes:
        as_array = lambda xs, kind: [np.frombuffer(x, kind) for x in xs]
        return cls(as_array(row["levels"], np.uint8), as_array(row["bitmaps"], np.uint8), as_array(row["ranks"], "<u4"))


def write_file(docs: DataFrame, path: str | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Writes the documents' ids, each with end_id behind, in ascending order of doc_id, and returns the file's table.

    A null text counts as empty. Null ids come first. Rows with the same id lie in the order of their texts. An empty
    table gives a file without shards. Further columns are not read. Without a path the file lies in scratch storage.
    """
    spark, file = docs.sparkSession, encoder.vocabulary(vocabulary)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder.encoder(file), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        shard = first = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            codes = Codes.encode(ids)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            one = {"part": part, "shard": shard, "first_token": first, "n_tokens": len(ids), "doc_ids": list(keys), "doc_bounds": bounds.tobytes(), "levels": [x.tobytes() for x in codes.levels], "bitmaps": [x.tobytes() for x in codes.bitmaps], "ranks": [x.tobytes() for x in codes.ranks]}
            kinds = {"part": pa.int32(), "shard": pa.int32(), "first_token": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_bounds": pa.binary(), "levels": pa.list_(pa.binary()), "bitmaps": pa.list_(pa.binary()), "ranks": pa.list_(pa.binary())}
            return pa.RecordBatch.from_pylist([one], schema=pa.schema(list(kinds.items())))

        for slice_ in shared.slices(batches):
            ids, bounds = encoder.with_end(*coder.encode(slice_.column("text")), end_id)
            names = slice_.column("doc_id").to_pylist()
            at = 0
            while at < len(names):
                room = SHARD_TOKENS - sum(map(len, held))
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + room, side="right")) - 1)
                held.append(ids[bounds[at] : bounds[to]])
                keys += names[at:to]
                sizes += np.diff(bounds[at : to + 1]).tolist()
                at = to
                if at < len(names) or sum(map(len, held)) >= SHARD_TOKENS:
                    yield row()
                    shard, first = shard + 1, first + sum(map(len, held))
                    keys, held, sizes = [], [], []
        if held:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(task, FILE_SCHEMA)
    if path is None:
        return shared.written(shards, "dac")
    shards.write.parquet(path)
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_tokens(file: DataFrame) -> DataFrame:
    """Per document of a file: where its ids start in its part, how many they are, and their checksum."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes.from_row(row).decode().astype("<u4")
                bounds = np.frombuffer(row["doc_bounds"], "<i8")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(crcs)
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["part"], np.int32)), pa.array(bounds[:-1] + row["first_token"]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                    names=[x.split()[0] for x in TOKENS_SCHEMA.split(", ")],
                )

    return file.mapInArrow(task, TOKENS_SCHEMA)


def document_starts(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the file. Only a count for each part goes to the driver."""
    counts = file.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = dict(zip((r.part for r in counts), accumulate((r.n for r in counts), initial=0)))
    base = file.sparkSession.createDataFrame(list(before.items()) or [(-1, 0)], "part int, base long")
    tokens = read_tokens(file).join(F.broadcast(base), "part")  # a row for each part
    return tokens.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_at(file: DataFrame, part: int, position: int) -> int | None:
    """One id by its place in a part: only its shard is read, and no block of it decoded."""
    rows = file.where((F.col("part") == part) & (F.col("first_token") <= position) & (F.col("first_token") + F.col("n_tokens") > position)).select("first_token", "levels", "bitmaps", "ranks").collect()
    return Codes.from_row(rows[0].asDict())[position - rows[0].first_token] if rows else None


def op10_dac(spark, sf_dir: str) -> DataFrame:
    return document_starts(write_file(shared.table(spark, sf_dir, "documents")))
