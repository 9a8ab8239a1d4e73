"""Weighted rendezvous sharding of records by a stable key, with gapless slots inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.llm.common import small_side
from mosaiq.session import cut_lineage

SHARDS = 16
SLICE_ROWS = 1 << 18
"""Rows numbered by one window task; only deals the work, slots do not depend on it."""
RUN_ROWS = 10_000
"""Equal rows are numbered in runs of so many, so that one record repeated endlessly spreads like any other."""


def _number(text: Column) -> Column:
    """A whole number below 2^48 from the digest of a text."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _cost(key: Column, shard: int, weight: float) -> Column:
    """An exponential waiting time of rate ``weight``, fixed by key and shard: the shard that comes first wins."""
    u = (_number(F.concat(key_text(key), F.lit(f":{shard}"))).cast("double") + 0.5) / float(1 << 48)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float] = (1.0,) * SHARDS) -> Column:
    """The shard of a key: 0 to len(weights) - 1, each with odds of its weight; ties go to the smaller shard.

    Only key, shard and weight decide. A further shard takes keys into itself, and
    a removed last shard gives its keys to the others; no other key moves. A null key is the key 'null'.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[_cost(key, s, w) for s, w in enumerate(weights)]))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0, slice_rows: int = SLICE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, one row for each.

    ``shard`` is that of the key doc_id, ``grown_shard`` that with one more shard of weight
    ``new_weight``. ``size`` is the UTF-8 bytes of the text plus 1 (null text: 1, as the
    empty one; their checksum is 0). ``slot`` numbers the rows of a shard from 0 without
    gaps, ordered by a digest of (doc_id, checksum, run), doc_id (nulls first), size and checksum.
    It is the same in every run and for any number of tasks.

    Rows without doc_id share one shard. Repeated rows get a slot each. Empty table: no rows.
    Other columns are dropped.

    Equal rows meet in one group, counted before the shuffle, and are numbered in runs.
    Slices of the digest range are numbered apart; a slice starts where the sizes
    of those before it end.
    """
    doc_id, body = F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    same = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows"))
    runs = (
        same.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(run_rows).cast("long"))).alias("run", "first"))
        .withColumn("rows", F.least(F.lit(run_rows).cast("long"), F.col("rows") - F.col("first")))
        .withColumn("place", _number(F.concat_ws(":", key_text(doc_id), F.col("text_crc32").cast("string"), F.col("run").cast("string"))))
        .withColumn("shard", shard_of(doc_id, weights))
    )
    runs = cut_lineage(runs.select("doc_id", "size", "text_crc32", "rows", "run", "place", "shard"))
    total = runs.agg(F.sum("rows")).first()[0] or 0
    slices = max(1, -(-total // (len(weights) * slice_rows)))
    runs = runs.withColumn("slice", F.floor(F.col("place") / float(1 << 48) * slices))
    sums = runs.groupBy("shard", "slice").agg(F.sum("rows").alias("rows"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_side(cut_lineage(sums.select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("start"))))
    inside = Window.partitionBy("shard", "slice").orderBy("place", "doc_id", "size", "text_crc32", "run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = runs.withColumn("ahead", F.coalesce(F.sum("rows").over(inside), F.lit(0).cast("long"))).join(starts, ["shard", "slice"])
    best = F.struct(_cost(doc_id, len(weights), new_weight)["cost"].alias("cost"))
    held = F.struct(F.element_at(F.array(*[_cost(doc_id, s, w)["cost"] for s, w in enumerate(weights)]), F.col("shard") + 1).alias("cost"))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.explode(F.sequence(F.col("start") + F.col("ahead"), F.col("start") + F.col("ahead") + F.col("rows") - 1)).alias("slot"),
        F.when(best < held, F.lit(len(weights))).otherwise(F.col("shard")).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, files: int = 4) -> None:
    """Writes whole rows as Parquet below ``path/shard=N``, each shard in at most ``files`` files.

    Rows are dealt to files by their content, so that a key with many rows does not end in one task.
    ``docs`` must not have a column ``shard``.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in docs.dtypes]), F.lit(files))
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), weights))
    placed.repartition(len(weights) * files, "shard", part).write.partitionBy("shard").parquet(path)
