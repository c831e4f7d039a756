"""What the operators have in common: scratch tables, table reading and bounded slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a Python task holds at a time (a single longer text is held alone).
SLICE_BYTES = 3 << 20


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task under a key. It keeps one thing at a time: the memory of the operator that ran
    before is given back when another begins."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """At a task's end: gives freed memory back to the system, as the idle worker stays beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, an own temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for what runs inside; the former ones come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def few_files(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """For jobs that write small tables: partitions are joined up to the advised size, not spread over all cores."""
    return settings(spark, spark__sql__adaptive__coalescePartitions__parallelismFirst="false")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read back: lineage ends here, and lost executors cost nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, column: str, most: int, rows: int) -> DataFrame:
    """Of `rows` rows about 2 * most (all, if there are fewer), chosen by a hash of a column.

    To be cut to `most`: then no task passes on much more than its share, however many tasks there are.
    """
    share = min(1.0, 2 * most / max(1, rows))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its texts in them; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[first:last], offsets - first


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, base = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin, base = end, int(size[end - 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finalizer (the splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
