"""Near-duplicate vectors: iterative quantisation to binary codes, multi-index Hamming tables, reranking with the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.llm.common import components
from mosaiq.session import cut_lineage

SAMPLE = 8192
"""Vectors that the rotation is learned from, at most (those with the smallest id hashes)."""

CODE_BITS = 64
TABLES = (8, 16, 32, 64)
"""The code is cut into so many substrings, each the key of a table: the first number that loses none of the trial pairs.
Pairs that differ in fewer bits than there are tables always meet."""

TRIALS = 4
"""Trial pairs for each sampled vector, at the cosine limit."""

BUCKET = 256
"""Buckets over this size and over four times the mean are compared in blocks, by several tasks."""


def usable(vector: Column) -> Column:
    """Not null, not zero, only finite components."""
    strange = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~strange & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotation(x: np.ndarray, bits: int = CODE_BITS, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dim x bits) of iterative quantisation on unit vectors ``x``.

    Principal directions are rotated so that the signs lose least: the codes are fixed,
    the best orthogonal rotation towards them follows by a singular value decomposition,
    and so on.
    """
    mean = x.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    main = vectors[:, ::-1][:, : min(bits, x.shape[1])]
    v = (x - mean) @ main
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((main.shape[1],) * 2))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (left @ right).T
    return mean, main @ rotation


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, projection = model
    bits = ((x - mean) @ projection >= 0).astype(np.uint64)
    return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def tables_needed(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], least: float, seed: int = 11) -> int:
    """How many tables let every trial pair meet.

    Each unit vector of ``x`` is paired with vectors at cosine ``least`` exactly, half of
    them turned to another vector of ``x``, half in a random direction.
    """
    rnd = np.random.default_rng(seed)
    need = 0
    for k in range(TRIALS):
        aim = rnd.standard_normal(x.shape) if k % 2 else x[rnd.permutation(len(x))]
        aim = aim - (aim * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((aim * aim).sum(axis=1, keepdims=True))
        turned = least * x + np.sqrt(max(0.0, 1 - least * least)) * np.divide(aim, size, out=np.zeros_like(aim), where=size > 1e-9)
        apart = codes(x, model) ^ codes(turned, model)
        while need < len(TABLES) - 1 and not _meet(apart, TABLES[need], TABLES[need]).all():
            need += 1
    return TABLES[need]


def _meet(apart: np.ndarray, tables: int, first: int) -> np.ndarray:
    """Whether codes that differ by ``apart`` share one of the first substrings."""
    width = CODE_BITS // tables
    met = np.zeros(apart.shape, dtype=bool)
    for t in range(first):
        met |= (apart >> np.uint64(width * t)) & np.uint64((1 << width) - 1) == 0
    return met


def _links(code: np.ndarray, x: np.ndarray, table: int, tables: int, least: float, rows: slice, cols: slice | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i < j if within one block) that meet in no earlier table."""
    other = rows if cols is None else cols
    near = x[rows] @ x[other].T >= least - 1e-9
    i, j = np.nonzero(np.triu(near, 1) if cols is None else near)
    i, j = i + rows.start, j + other.start
    keep = np.einsum("ij,ij->i", x[i], x[j]) >= least if len(i) else np.zeros(0, bool)
    i, j = i[keep], j[keep]
    keep = ~_meet(code[i] ^ code[j], tables, table)
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, least: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Links join vectors of equal, non-null label and dimension with cosine >= ``least`` in
    double precision. Equal vectors are one class first, so copies cost one row. A class's
    code is cut into substrings; classes that share one meet in a task, where all pairs are
    compared, and each linked pair counts in the first table where it meets. With n
    substrings all pairs of fewer than n differing bits meet; n is the first of TABLES for
    which all trial pairs at the cosine limit, made from the sample, do. Vectors of a
    dimension that the sample lacks are all compared with each other. Per task and class one count and one edge of a spanning forest leave, never
    the pairs. Buckets beyond a limit are compared block by block in several tasks.

    Vectors that are null, zero or hold null or non-finite components, null labels and
    null ids link with nothing (0 links; a component of their own, null for a null id).
    Repeated rows are vectors like others: they link. Empty table: no rows. Other columns
    are dropped.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    classes = cut_lineage(
        rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    drawn: dict[int, list] = {}
    for r in classes.select("embedding", "rep").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect():
        drawn.setdefault(len(r.embedding), []).append(r.embedding)
    tables = TABLES[0]
    for dim, some in drawn.items():
        if dim:
            x = unit(np.array(some))
            models[dim] = learn_rotation(x)
            tables = max(tables, tables_needed(x, models[dim], least))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            begin = np.concatenate([[0], np.cumsum(sizes)])
            out = np.zeros(len(sizes), dtype=np.uint64)
            packed: list[bytes] = [b""] * len(sizes)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                x = flat[begin[mine][:, None] + np.arange(dim)].astype(np.float64)
                # in a dimension that the sample lacks all codes are equal
                if int(dim) in models:
                    out[mine] = codes(unit(x), models[int(dim)])
                # half the bytes say the same of what came as floats
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                same = (short == x).all(axis=1)
                for k, row, brief, fits in zip(mine, x, short, same):
                    packed[k] = (brief if fits else row).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), batch.column(2), batch.column(3), pa.array(out.view(np.int64)), pa.array(packed, pa.binary())],
                                             names=["label", "dim", "rep", "copies", "code", "packed"])

    label_type = classes.schema["label"].dataType.simpleString()
    width = CODE_BITS // tables
    keyed = classes.select("label", "embedding", "rep", "copies").mapInArrow(coded, f"label {label_type}, dim int, rep long, copies long, code long, packed binary")
    keyed = keyed.withColumn("tab", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn(
        "sub", F.expr(f"shiftrightunsigned(code, tab * {width}) & {(1 << width) - 1}"))
    bucket = ["label", "dim", "tab", "sub"]
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    mean = cut_lineage(sizes).select(F.avg("n")).first()[0] or 0
    limit = max(BUCKET, int(4 * mean))
    # rows of a large bucket go to the tasks of all pairs of blocks that hold theirs
    large = cut_lineage(sizes.where(F.col("n") > limit).withColumn("g", F.ceil(F.col("n") / limit).cast("int")).drop("n"))
    blocked = (
        keyed.join(large, bucket, "left").withColumn("g", F.coalesce("g", F.lit(1)))
        .withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .withColumn("lo", F.least("blk", "mate")).withColumn("hi", F.greatest("blk", "mate"))
    )
    task = [*bucket, "lo", "hi"]
    dealt = blocked.select(*task, "blk", "rep", "copies", "code", "packed").repartition(*task).sortWithinPartitions(*task, "blk", "rep")
    out = cut_lineage(dealt.mapInArrow(lambda batches: _compare(batches, least, tables), "rep long, links long, root long"))
    links = out.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(out.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    found = (
        classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    )
    found = cut_lineage(found)
    joined = rows.join(found, fit & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _compare(batches: Iterator[pa.RecordBatch], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Counts and spanning edges of the buckets of one sorted partition, bucket by bucket."""
    held: list[pa.RecordBatch] = []

    def bucket(part: pa.Table) -> pa.RecordBatch:
        rep, copies = np.asarray(part["rep"]), np.asarray(part["copies"])
        code = np.asarray(part["code"]).view(np.uint64)
        dim = part["dim"][0].as_py()
        x = unit(np.stack([np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64).astype(np.float64) for raw in part["packed"].to_pylist()]))
        table, lo, hi = (part[c][0].as_py() for c in ("tab", "lo", "hi"))
        cut = int(np.searchsorted(np.asarray(part["blk"]), hi)) if lo < hi else 0
        found = []
        step = 1024
        if lo == hi:
            for a in range(0, len(rep), step):
                found.append(_links(code, x, table, tables, least, slice(a, min(a + step, len(rep))), None))
                for b in range(a + step, len(rep), step):
                    found.append(_links(code, x, table, tables, least, slice(a, a + step), slice(b, min(b + step, len(rep)))))
        else:
            for a in range(0, cut, step):
                for b in range(cut, len(rep), step):
                    found.append(_links(code, x, table, tables, least, slice(a, min(a + step, cut)), slice(b, min(b + step, len(rep)))))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        n = np.zeros(len(rep), dtype=np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        root = rep[_forest(len(rep), i, j)]
        has = n > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(n[has]), pa.array(root[has])], names=["rep", "links", "root"])

    for batch in batches:
        if not len(batch):
            continue
        # the sort puts the rows of a bucket side by side; a bucket may go on in the next batch
        keys = [batch.column(k).to_pylist() for k in range(6)]
        marks = [0, *(r for r in range(1, len(batch)) if any(k[r] != k[r - 1] for k in keys)), len(batch)]
        for a, b in zip(marks, marks[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(6)):
                whole = pa.Table.from_batches(held).combine_chunks()
                held = []
                if len(whole) > 1:
                    yield bucket(whole)
            held.append(part)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        if len(whole) > 1:
            yield bucket(whole)
