"""Corpus pipeline: language, repeated lines, near duplicates, source mixture and encoding of a documents table.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents,
with what the stage decided carried out. ``run`` chains them, each result stored before
the next stage reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaiq.llm import bpe, jaccard, language, mixing, templates
from mosaiq.llm.common import read, small_side, stored
from mosaiq.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

RAW_BITS = 8.0
"""A text whose cross-parsing entropy is above that of raw bytes is in none of the learned languages."""


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which becomes their ``lang``; those without letters or like no language go."""
    found = language.identify(docs.select(*COLUMNS), language.fit(docs))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= RAW_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later lines of recurring templates; a document that loses all its words goes."""
    cut = templates.drop_recurring_lines(docs.select(*COLUMNS))
    kept = cut.where((F.col("n_dropped") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a number of its own for each row that stays the same in every job: the file and the place in it."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = stored(docs.select(*COLUMNS))
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())
    numbered = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
    row = F.shiftleft("_number", 40) + F.col("_place")
    return placed.join(F.broadcast(numbered), "_file").select(*COLUMNS, row.alias("row"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: that of the smallest doc_id, nulls last. Rows are told apart by a key, not by their id."""
    keyed = _with_row_key(docs)
    groups = jaccard.similar_documents(keyed.select(F.col("row").alias("doc_id"), "text"))
    later = cut_lineage(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("part")))
    members = small_side(cut_lineage(later.union(later.select("part", "part").distinct())))
    named = cut_lineage(keyed.select("row", "doc_id").join(members, "row"))
    first = named.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))["row"].alias("first"))
    gone = named.join(first, "part").where("row <> first").select("row")
    return keyed.join(small_side(cut_lineage(gone)), "row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as its source's share asks for, none for some."""
    keyed = _with_row_key(docs)
    copies = small_side(cut_lineage(mixing.mix_sources(keyed, carry=("row",)).where("copies > 0").select("row", "copies")))
    mixed = keyed.join(copies, "row")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document kept."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, known_words=30_000, block_bytes=1 << 19)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None  # learned models and a template tree: tests/llm holds each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = stored(docs)
    return docs
