"""Token counts by separator scan over flat, unindexed token files.

A token file is a stream of 16-bit ids with an end-of-document id behind each document and nothing else; here its
blocks of BLOCK_TOKENS ids are rows (file, block, payload), cut without regard to documents. Every block is searched on
its own by one vector comparison. A document may span many blocks, so a block tells only where separators lie in it. A
prefix scan over each file's blocks gives the number of the document that is open at each block's start and the place
where that document began, and with these the lengths are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from driftwood.llm import encoder, shared

BLOCK_TOKENS = 1 << 18
#: doc_ids: of the documents whose end lies in this block, for the caller's use; the scan doesn't read them.
FILES_SCHEMA = "file int, block int, payload binary, doc_ids array<long>"


def write_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 50256, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A flat token file from each of the input's partitions, in scratch storage. A null text counts as empty."""
    path = encoder.vocabulary(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, block = encoder.encoder(path), TaskContext.get().partitionId(), 0
        open_ids, names = np.zeros(0, np.uint16), []

        def row(ids: np.ndarray) -> pa.RecordBatch:
            ends = int((ids == end_id).sum())
            mine, names[:] = names[:ends], names[ends:]
            return pa.record_batch([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([ids.astype("<u2").tobytes()], pa.binary()), pa.array([mine], pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])

        for part in shared.slices(batches):
            ids, _ = encoder.with_end(*coder.encode(part.column("text")), end_id)
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError(f"id {int(ids.max())} doesn't fit into the file's 16 bits")
            names += part.column("doc_id").to_pylist()
            open_ids = np.concatenate([open_ids, ids.astype(np.uint16)])
            whole = len(open_ids) // block_tokens
            for k in range(whole):
                yield row(open_ids[k * block_tokens : (k + 1) * block_tokens])
                block += 1
            open_ids = open_ids[whole * block_tokens :].copy()
        if len(open_ids):
            yield row(open_ids)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.written(read.mapInArrow(task, FILES_SCHEMA), "tokens")


def scan_blocks(files: DataFrame, end_id: int = 50256) -> DataFrame:
    """Per block its size and the places of its separators, by one vector comparison."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("payload")]
            size, ends = [len(x) for x in blocks], [np.flatnonzero(x == end_id) for x in blocks]
            columns = [batch.column("file"), batch.column("block"), batch.column("doc_ids"), pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["file", "block", "doc_ids", "size", "ends"])

    return files.mapInArrow(task, "file int, block int, doc_ids array<long>, size long, ends array<long>")


def count_tokens(files: DataFrame, end_id: int = 50256) -> DataFrame:
    """Per document of the files: file, ordinal in it, start (place in the file), n_tokens without the separator, doc_id.

    A file's last ids without a separator behind them are a document as well. Empty files give no rows.
    """
    of_file = Window.partitionBy("file").orderBy("block")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    # at: ids before the block; ordinal: documents ended before it; last: it is the file's last block
    scanned = scan_blocks(files, end_id).withColumns({"at": F.coalesce(F.sum("size").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)), "last": F.lead("block").over(of_file).isNull()})
    # opened: where the document that is open at the block's start began; until: where the one that is open at its end did
    until = F.col("at") + F.element_at("ends", -1) + 1
    scanned = scanned.withColumn("until", F.when(F.size("ends") > 0, until))
    scanned = scanned.withColumn("opened", F.coalesce(F.max("until").over(before), F.lit(0)))
    unended = F.col("last") & (F.col("at") + F.col("size") > F.coalesce("until", "opened"))
    ends = F.when(unended, F.concat("ends", F.array("size"))).otherwise(F.col("ends"))
    stretches = F.transform(ends, lambda end, k: F.struct((F.col("at") + end).alias("end"), F.when(k == 0, F.col("opened")).otherwise(F.col("at") + F.get("ends", k - 1) + 1).alias("start")))
    docs = scanned.select("file", "ordinal", "doc_ids", F.posexplode(stretches).alias("k", "s"))
    return docs.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.col("s.start").alias("start"), (F.col("s.end") - F.col("s.start")).alias("n_tokens"), F.get("doc_ids", F.col("k")).alias("doc_id"))


def op3_separator_scan(spark, sf_dir: str) -> DataFrame:
    return count_tokens(write_files(shared.table(spark, sf_dir, "documents"))).select("doc_id", "n_tokens", "file", "ordinal", "start")
