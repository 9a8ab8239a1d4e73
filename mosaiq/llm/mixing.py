"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mosaiq.llm.common import WORD
from mosaiq.session import cut_lineage

MAX_COPIES = 3
BINS = 1 << 10
"""Slices of the rank range in which running sums are kept; a source may hold a third of all rows."""


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): a share of all words by weight, at most ``max_copies`` times the size.

    Sources by code point (null last) weigh ``weights``, repeating. The excess of a
    capped source is shared again by weight. With sources ordered by size over weight
    the capped ones come first, so one running sum finds the level at which it stops.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("_k", F.row_number().over(order) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(table, (F.col("_k") % len(weights)).cast("int")))
    cap = F.col("source_size") * float(max_copies)
    ranked = ranked.withColumn("_cap", cap).withColumn("_level", cap / F.col("_w"))
    everything = Window.partitionBy()
    before = Window.orderBy("_level", "_k").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_share", F.col("_rest") / F.col("_open"))
        .withColumn("_free", F.col("_share") < F.col("_level"))
    )
    level = F.min(F.when(F.col("_free"), F.col("_share"))).over(everything)
    first = F.min(F.when(F.col("_free"), F.struct("_level", "_k", "_share"))).over(everything)
    ranked = ranked.withColumn("_stop", F.coalesce(first["_share"], level, F.lit(float("inf"))))
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.col("_stop") * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: int = MAX_COPIES, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Copies of documents so that each source's words come near its target.

    docs(doc_id, text, source) -> doc_id, size, source_size, target, copies, taken.

    A source whose target is e times its words gives floor(e) whole copies of every
    document. What is then missing is sampled: each document has a lasting uniform
    number u (from doc_id, seed) and the inclusion probability p = frac(e), so sources
    have unequal odds; documents are ranked by (u / (1 - u)) / (p / (1 - p)) and taken
    from the smallest on until the missing words are reached. The document that crosses
    the line is taken if that comes nearer. The running sums first look at BINS slices
    of the rank, then only inside the slice where the line falls.

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Null
    doc_id: a document like any other. Repeated rows rank alike and count one by one.
    Empty table: no rows. Columns named in ``carry`` are returned too and settle ties;
    others are dropped.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = cut_lineage(docs.select("doc_id", *carry, "source", size.alias("size"), u.alias("_u")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(
        source_targets(sources, weights, max_copies)
        .withColumn("_e", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0))
        .withColumn("_whole", F.floor("_e").cast("long"))
        .withColumn("_p", F.col("_e") - F.col("_whole"))
        .withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))))
    )
    on = sized["source"].eqNullSafe(sources["source"])
    ranked = sized.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, on).select(
        "doc_id", *carry, "size", "source_size", "target", "source_no", "_whole", "_need", "_p",
        ((F.col("_u") / (1 - F.col("_u"))) / F.nullif(F.col("_p") / (1 - F.col("_p")), F.lit(0.0))).alias("_q"),
    )
    # the odds fall into slices by q / (1 + q), which is even enough for any p
    ranked = ranked.withColumn("_bin", F.coalesce(F.floor(F.col("_q") / (1 + F.col("_q")) * BINS), F.lit(BINS)).cast("int"))
    bins = ranked.groupBy("source_no", "_bin").agg(F.sum("size").alias("_words"), F.max("_need").alias("_need"))
    up_to = Window.partitionBy("source_no").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut_lineage(
        bins.withColumn("_before", F.coalesce(F.sum("_words").over(up_to), F.lit(0).cast("long")))
        .select("source_no", "_bin", "_before", (F.col("_before") + F.col("_words") > F.col("_need")).alias("_ends"))
    )
    crossing = bins.where("_ends").groupBy("source_no").agg(F.min(F.struct("_bin", "_before")).alias("_c"))
    crossing = cut_lineage(crossing.select("source_no", F.col("_c._bin").alias("_last"), F.col("_c._before").alias("_before")))
    placed = ranked.join(F.broadcast(crossing) if crossing.count() <= 100_000 else crossing, "source_no", "left")
    inside = Window.partitionBy("source_no", "_bin").orderBy("_q", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    out = ["doc_id", *carry, "size", "source_size", "target", "copies"]
    plain = placed.where("_last is null or _bin <> _last").withColumn(
        "copies", F.col("_whole") + F.when((F.col("_p") > 0) & (F.col("_last").isNull() | (F.col("_bin") < F.col("_last"))), 1).otherwise(0))
    line = (
        placed.where("_bin = _last")
        .withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
        .withColumn("copies", F.col("_whole") + F.when((F.col("_p") > 0) & (F.col("_at") + F.col("size") / 2 <= F.col("_need")), 1).otherwise(0))
    )
    both = plain.select(*out).unionByName(line.select(*out))
    return both.withColumn("taken", F.col("copies") * F.col("size"))
