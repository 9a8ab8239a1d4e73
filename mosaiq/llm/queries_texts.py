"""Registered queries of the operators that treat documents one by one, over the whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaiq.llm import bpe, language, mixing, scoring, templates, tokens
from mosaiq.llm.common import read
from mosaiq.llm.registry import query

@query("op7_mix_sources", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([1.0, 2.0, 3.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w
  FROM sized GROUP BY source),
lev AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS level,
               sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w FROM src),
run AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS share FROM lev
        WINDOW b AS (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT coalesce(arg_min(share, level) FILTER (WHERE share < level), 'infinity'::DOUBLE) AS s FROM run),
tgt AS (SELECT source, source_size, least(cap, s * w) AS target FROM run, stop),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS e FROM tgt),
p AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p, target - floor(e) * source_size AS need FROM e),
q AS (SELECT d.doc_id, d.size, p.*, (u / (1 - u)) / nullif(p / (1 - p), 0) AS q
      FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
n AS (SELECT *, whole + CASE WHEN p > 0 AND before + size / 2 <= need THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM n
""")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


TOKEN_LIMIT = 4096
"""Budget of op2's over_limit."""


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.prefix_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    state: dict[str, list] = {}

    def digests(sequences: list[list[int]]) -> list[pa.Array]:
        if not state:
            state["pieces"] = bpe.pieces_of(ranks)
            state["texts"] = [b",%d" % i for i in range(len(state["pieces"]))]
        coded = [hashlib.sha256(b"".join(map(state["texts"].__getitem__, ids))[1:]).hexdigest() for ids in sequences]
        decoded = [hashlib.sha256(bpe.join_pieces(ids, state["pieces"])).hexdigest() for ids in sequences]
        return [pa.array([len(ids) for ids in sequences], pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    return bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ("n_tokens long, ids_sha256 string, decoded_sha256 string", digests))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = templates.drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_lm_scores")
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.backoff_scores(read(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
