"""Registered queries of the operators that compare documents or vectors with each other, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaiq.llm import graph_search, jaccard, suffixes, vectors
from mosaiq.llm.common import read
from mosaiq.llm.registry import query


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", (F.size("edges") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
f AS (SELECT doc_id, unnest(s) AS f FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM f x JOIN f y ON x.f = y.f AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(doc_id, c) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.a, min(r.c) FROM r JOIN e ON e.b = r.doc_id JOIN recurring.r AS o ON o.doc_id = e.a WHERE r.c < o.c GROUP BY e.a)
SELECT n.doc_id, n.n AS n_shingles, r.c AS component_id FROM n JOIN r ON n.doc_id = r.doc_id
""")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read(spark, sf_dir, "documents"))


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = read(spark, sf_dir, "embeddings")
    return graph_search.nearest(graph_search.build_index(vecs, copies=6), vecs.where("vec_id % 50 = 0"), k=5)


@query("op9_embedding_duplicates")
def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)
