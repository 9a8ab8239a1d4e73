"""Exact running sums and order statistics that never gather one key in one task.

Rows are range-partitioned by key and order, so a key with many rows lies in several
neighbouring partitions. Each partition's sum per key is small; its running sum tells where a
partition continues, and windows stay inside one partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.session import cut_lineage, meet, spread

PART = "_part"


def spread_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` dealt into ranges of (keys, order) and materialised, with the number of the range in ``_part``.

    Later ranges hold later rows. Only rows equal in keys and order have to stay together.
    """
    columns = [c if isinstance(c, Column) else F.col(c) for c in order]
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *columns).withColumn(PART, F.spark_partition_id()))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, before: str, total: str | None = None) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over earlier rows of the key, and ``total``, that over all rows of the key.

    ``order`` should tell the rows of a key apart: those that are equal in it count in any order. Null keys are a key.
    """
    placed = spread_in_order(df, keys, order)
    key = Window.partitionBy(*[f"_sum_k{i}" for i in range(len(keys))])
    sums = placed.groupBy(F.col(PART).alias("_sum_p"), *[F.col(k).alias(f"_sum_k{i}") for i, k in enumerate(keys)]).agg(F.sum(value).alias("_sum_s"))
    sums = sums.withColumn("_sum_b", F.sum("_sum_s").over(key.orderBy("_sum_p")) - F.col("_sum_s")).withColumn("_sum_t", F.sum("_sum_s").over(key))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_sum_k{i}")) for i, k in enumerate(keys)], F.col(PART) == F.col("_sum_p"))
    local = Window.partitionBy(PART, *keys).orderBy(*order)
    inside = F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    out = meet(placed.withColumn(before, inside), sums, on).withColumn(before, F.col("_sum_b") + F.col(before))
    if total is not None:
        out = out.withColumn(total, F.col("_sum_t"))
    return out.drop(PART, "_sum_p", "_sum_s", "_sum_b", "_sum_t", *[f"_sum_k{i}" for i in range(len(keys))])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], discrete: bool = False, stats: bool = False, times: str | None = None) -> DataFrame:
    """One row per key with the exact percentiles ``wanted = {name: q}``.

    ``stats`` adds the columns ``mean`` and ``max`` from the same value counts.
    ``times`` names a column that says how often a row counts.
    ``discrete=False`` interpolates linearly between order statistics,
    ``discrete=True`` takes the nearest rank ``ceil(q*n)``.
    """
    # nulls drop out by their zero count: a null filter on the value would be pushed
    # down and copy the whole expression behind it
    count = F.count(value) if times is None else F.sum(F.when(F.col(value).isNotNull(), F.col(times)))
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(count.alias("_n")).where("_n > 0")
    ranked = running_sums(counts, keys, ["_v"], "_n", "_before", "_total")
    picks = [(F.sum(F.col("_v") * F.col("_n")) / F.max("_total")).alias("mean"), F.max("_v").alias("max")] if stats else []
    for name, q in wanted.items():
        if discrete:
            low = high = at = F.greatest(F.ceil(F.lit(float(q)) * F.col("_total")), F.lit(1)) - 1
        else:
            at = (F.col("_total") - 1) * F.lit(float(q))
            low, high = F.floor(at), F.ceil(at)
        for tag, rank in (("l", low), ("h", high)):
            here = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}_{tag}"))
        picks.append(F.max((at - low).cast("double")).alias(f"_{name}_f"))
    out = ranked.groupBy(*keys).agg(*picks)
    if not keys:
        out = out.where(F.col(f"_{next(iter(wanted))}_l").isNotNull())
    cols = [(F.col(f"_{n}_l") * (1 - F.col(f"_{n}_f")) + F.col(f"_{n}_h") * F.col(f"_{n}_f")).alias(n) for n in wanted]
    return out.select(*keys, *(["mean", "max"] if stats else []), *cols)


def value_codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Small numbers that are equal where the values are; nulls are a value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def new_groups(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether a row begins a group; equal keys lie together."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        code = value_codes(table.column(k))
        new[1:] |= code[1:] != code[:-1]
    return new


def map_whole_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` over tables of many whole groups each, sorted by (keys, order), so that small groups cost no call of their own.

    A task holds one batch of rows or one group, whichever is larger.
    """
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = int(np.flatnonzero(new_groups(batch, keys))[-1])
            whole = at > 0 or bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
            if whole:
                done = [*held, batch.slice(0, at)] if at else held
                yield from fn(pa.Table.from_batches(done)).to_batches()
                held = []
            held.append(batch.slice(at))
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(tables, schema)
