"""Helpers shared by the corpus operators: Arrow text blocks, word hashes, checked broadcasts and components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaiq.session import cut_lineage, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
"""Words of a text: runs of anything but ASCII white space."""

BLOCK_BYTES = 512 << 10
"""Text handled at once inside a task; a longer single text is a block of its own."""

BROADCAST_ROWS = 500_000
"""Rows of at most two longs that a task may be sent whole; beyond it Spark joins by shuffle."""

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again; the files go with the session."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get(), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(path.toString())


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A batch function that gives its memory back when it is through: Spark keeps the Python worker for later tasks."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not this C library
            pass

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(at: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most ``limit`` bytes together; a longer text alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word (A-Z only) of a run of texts, and the number of words of each text.

    ``at`` holds absolute offsets into ``data``.
    """
    lo, hi = int(at[0]), int(at[-1])
    part, at = data[lo:hi], at - lo
    counts = np.zeros(len(at) - 1, dtype=np.int64)
    if not len(part):
        return np.zeros(0, U64), counts
    solid = ~SPACE[part]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = at[(at > 0) & (at < len(part))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), counts
    # position of each byte in its word; bytes of white space weigh nothing
    place = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part)))) if starts[0] == 0 else (
        np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))]))
    place *= solid
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15 | 1, dtype=U64))
    value = (LOWER[part].astype(U64) + U64(1)) * powers[place]
    value *= solid
    counts = np.diff(np.searchsorted(starts, at))
    return mix(np.add.reduceat(value, starts)), counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by its first word; len(words) - n + 1 values."""
    total = np.zeros(max(0, len(words) - n + 1), U64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += words[k : k + len(total)] * U64(factor)
    return mix(total)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised, narrow rows) with a broadcast hint if it is small; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows (node, component), component the smallest node.

    Every round each node takes the smallest label among its neighbours, then the
    label of its label. Rounds are checkpointed; only one changed-row count a round
    reaches the driver.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cut_lineage(both.union(both.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut_lineage(
            moved.join(jump, "label", "left")
            .select("node", "old", F.least("label", "further").alias("label"))
        )
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
