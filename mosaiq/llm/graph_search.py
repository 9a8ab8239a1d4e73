"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mosaiq.llm.vectors import unit, usable
from mosaiq.session import cut_lineage

SHARD_ROWS = 8192
"""Distinct vectors of a shard; shards are dealt by the hash of the vector, so each is a fair share."""

DEGREE = 24
"""Neighbours chosen for a node (twice as many may stay on the lowest layer, once edges go both ways)."""

CANDIDATES = 64
BEAM = 160
QUERY_BLOCK = 1024
BLOCKS_A_TASK = 64

INDEX = "shard int, dim int, vectors binary, id_ends binary, ids binary, layers array<binary>, neighbours array<binary>"


def _layer(x: np.ndarray, nodes: np.ndarray, degree: int, most: int) -> np.ndarray:
    """Flat neighbour array (len(nodes) x most, -1 where there is none), in positions of ``nodes``.

    A node's candidates are its nearest; one is chosen if it is nearer to the node than
    to every neighbour chosen before, which keeps edges that lead away. Places left over
    go to the nearest of the rest. Edges then go both ways, the nearest ``most`` stay.
    """
    y = x[nodes]
    n = len(nodes)
    take = min(CANDIDATES, n - 1)
    if take < 1:
        return np.full((n, most), -1, dtype=np.int32)
    heads, tails, sims = [], [], []
    for a in range(0, n, 512):
        b = min(a + 512, n)
        s = y[a:b] @ y.T
        s[np.arange(b - a), np.arange(a, b)] = -np.inf
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        near_s = np.take_along_axis(s, near, 1)
        order = np.argsort(-near_s, axis=1, kind="stable")
        near, near_s = np.take_along_axis(near, order, 1), np.take_along_axis(near_s, order, 1)
        among = np.matmul(y[near], y[near].transpose(0, 2, 1))
        chosen = np.zeros(near.shape, dtype=bool)
        closest = np.full(near.shape, -np.inf)
        count = np.zeros(b - a, dtype=np.int64)
        for k in range(take):
            good = (closest[:, k] < near_s[:, k]) & (count < degree)
            chosen[:, k] = good
            count += good
            closest = np.where(good[:, None], np.maximum(closest, among[:, k]), closest)
        rest = np.cumsum(~chosen, axis=1) <= (degree - count)[:, None]
        chosen |= ~chosen & rest
        r, k = np.nonzero(chosen)
        heads.append(r + a)
        tails.append(near[r, k])
        sims.append(near_s[r, k])
    u, v, s = np.concatenate(heads), np.concatenate(tails), np.concatenate(sims)
    key = np.concatenate([u * n + v, v * n + u])
    key, first = np.unique(key, return_index=True)
    s = np.concatenate([s, s])[first]
    u, v = key // n, key % n
    order = np.lexsort((v, -s, u))
    u, v = u[order], v[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    out = np.full((n, most), -1, dtype=np.int32)
    keep = rank < most
    out[u[keep], rank[keep]] = v[keep]
    return out


def build_graph(x: np.ndarray, marks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes and neighbour arrays of each layer, the lowest first; ``marks`` are uniform 64-bit hashes that set a node's height."""
    height = np.floor(-np.log((marks.astype(np.float64) + 1) / 2.0**64) / math.log(DEGREE)).astype(int)
    layers, edges = [], []
    for level in range(max(1, int(height.max()) + 1)):
        nodes = np.arange(len(x)) if level == 0 else np.flatnonzero(height >= level)
        if not len(nodes):
            break
        layers.append(nodes.astype(np.int32))
        edges.append(_layer(x, nodes, DEGREE, 2 * DEGREE if level == 0 else DEGREE))
    return layers, edges


def search_layer(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` nodes of one layer for each query, from its entry nodes on; all queries step together."""
    q, e = entry.shape
    beam = max(beam, e)
    seen = np.zeros((q, len(x)), dtype=bool)
    ids = np.full((q, beam), -1, dtype=np.int32)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    ids[:, :e] = entry
    sims[:, :e] = np.where(entry >= 0, np.matmul(x[entry], queries[:, :, None])[:, :, 0], -np.inf)
    done[:, :e] = entry < 0
    rows, cols = np.nonzero(entry >= 0)
    seen[rows, entry[rows, cols]] = True
    active = np.arange(q)
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        best = open_sims.argmax(axis=1)
        more = open_sims[np.arange(len(active)), best] > -np.inf
        active, best = active[more], best[more]
        if not len(active):
            break
        done[active, best] = True
        near = edges[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        r, k = np.nonzero(fresh)
        seen[active[r], near[r, k]] = True
        new = np.full(near.shape, -np.inf, dtype=np.float32)
        new[r, k] = np.einsum("ij,ij->i", x[near[r, k]], queries[active[r]])
        all_sims = np.concatenate([sims[active], new], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), keep, 1)
        done[active] |= ~np.isfinite(sims[active])
    return np.where(np.isfinite(sims), ids, -1), sims


def search_graph(x: np.ndarray, layers: list[np.ndarray], edges: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Positions of the ``beam`` best vectors found for each query (-1: none)."""
    top = layers[-1]
    found = np.tile(top[: min(len(top), 4)], (len(queries), 1)).astype(np.int32)
    for level in range(len(layers) - 1, -1, -1):
        place = np.full(len(x), -1, dtype=np.int32)
        place[layers[level]] = np.arange(len(layers[level]), dtype=np.int32)
        entry = np.where(found >= 0, place[found], -1)
        got, _ = search_layer(x[layers[level]], edges[level], queries, entry, beam if level == 0 else 8)
        found = np.where(got >= 0, layers[level][got], -1)
    return found


def build_index(vectors: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Index of vectors(vec_id, embedding): one row per shard with flat arrays, checkpointed.

    Equal vectors are one node that keeps its ``copies`` smallest ids, enough for every
    answer. Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = cut_lineage(rows.withColumn("_n", first).where(F.col("_n") <= copies).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    sized = nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    shards = sized.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    base = F.sum("shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.withColumn("base", F.coalesce(base, F.lit(0)).cast("int"))  # a row for each dimension
    mark = F.xxhash64("embedding")
    dealt = nodes.withColumn("dim", F.size("embedding")).join(F.broadcast(shards), "dim").select(
        (F.col("base") + F.pmod(mark, F.col("shards"))).cast("int").alias("shard"), "dim", "embedding", "ids", F.xxhash64(mark).alias("mark"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mark", kind="stable")
        raw = np.array(part["embedding"].tolist(), dtype=np.float64)
        layers, edges = build_graph(unit(raw).astype(np.float32), part["mark"].to_numpy().view(np.uint64))
        ids = part["ids"].tolist()
        return pd.DataFrame([{
            "shard": int(part["shard"].iloc[0]), "dim": raw.shape[1], "vectors": raw.tobytes(),
            "id_ends": np.cumsum([len(i) for i in ids]).astype(np.int64).tobytes(), "ids": np.concatenate(ids).astype(np.int64).tobytes(),
            "layers": [a.tobytes() for a in layers], "neighbours": [a.tobytes() for a in edges],
        }])

    return cut_lineage(dealt.groupBy("shard").applyInPandas(build, INDEX))


def nearest(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest vectors found for queries(vec_id, embedding), not counting the query's own id.

    -> query_id, rank, vec_id, score (cosine in double precision on the original vectors;
    ties to the smaller id). Blocks of queries are sent to the shards of their dimension,
    a shard's graph is searched for a whole block at once, and the shards' answers are
    merged. Queries that are null, zero or not finite have no answers; with fewer
    candidates than ``k`` all that are found are returned. An id with several vectors asks with each of
    them, and as an answer it counts once, by its best score.
    """
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = cut_lineage(asked.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct())
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = asked.groupBy(F.size("embedding").alias("dim"), block.alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    places = index.select("shard", "dim").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    sent = asked.join(places, "dim").select(F.explode("shards").alias("shard"), "block", "rows").withColumn("part", F.floor(F.col("block") / BLOCKS_A_TASK).cast("int"))
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_A_TASK))))
    pairs = sent.join(spread, ["shard", "part"]).select("vectors", "id_ends", "ids", "layers", "neighbours", "dim", "rows")
    hits = pairs.mapInArrow(lambda batches: _search(batches, k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            col = lambda c: batch.column(batch.schema.get_field_index(c))[r]
            dim = col("dim").as_py()
            raw = np.frombuffer(col("vectors").as_py(), dtype=np.float64).reshape(-1, dim)
            ends, ids = (np.frombuffer(col(c).as_py(), dtype=np.int64) for c in ("id_ends", "ids"))
            layers = [np.frombuffer(a, dtype=np.int32) for a in col("layers").as_py()]
            edges = [np.frombuffer(a, dtype=np.int32).reshape(len(n), -1) for a, n in zip(col("neighbours").as_py(), layers)]
            asked = col("rows").values
            who = np.asarray(asked.field("vec_id"))
            q = np.asarray(asked.field("embedding").flatten()).reshape(-1, dim)
            x = unit(raw).astype(np.float32)
            found = search_graph(x, layers, edges, unit(q).astype(np.float32), max(beam, k + 1))
            # very small or large components are scaled by a power of two, which changes no digit of a cosine
            q, raw = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (q, raw))
            norm_q, norm_x = np.sqrt((q * q).sum(1)), np.sqrt((raw * raw).sum(1))
            # every node found is scored again with the original vectors, its ids spread out
            rows, cols = np.nonzero(found >= 0)
            node = found[rows, cols]
            score = np.einsum("ij,ij->i", q[rows], raw[node]) / (norm_q[rows] * norm_x[node])
            begin = np.concatenate([[0], ends[:-1]])
            n = ends[node] - begin[node]
            at = np.repeat(begin[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows, score, vec = np.repeat(rows, n), np.repeat(score, n), ids[at]
            other = vec != who[rows]
            rows, score, vec = rows[other], score[other], vec[other]
            order = np.lexsort((vec, -score, rows))
            rows, score, vec = rows[order], score[order], vec[order]
            _, once = np.unique(np.stack([rows, vec]), axis=1, return_index=True)
            once.sort()
            rows, score, vec = rows[once], score[once], vec[once]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            yield pa.RecordBatch.from_arrays([pa.array(who[rows[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])
