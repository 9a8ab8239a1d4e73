"""Line dedup with a log-template tree: lines of a recurring template go, its first line stays.

The tree has a fixed depth: the number of tokens, then the LEAD leading tokens, tokens with
a digit being variable fields from the start. In a leaf, a line joins the most similar
template if enough tokens agree, and the tokens that differ become variable. Templates
that several documents share are boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.llm.common import small_side
from mosaiq.session import cut_lineage

LEAD = 3
ALIKE = 0.7
MIN_DOCS = 2
RUN = 4096
"""A leaf with more distinct lines is grown in parts of about so many; the templates of its parts are grown again, until one run has them all."""

SHRINK = 0.8
"""Parts that leave more than this share of the lines of a leaf are not dealt again: the next run has the whole leaf."""

FIELD = "<*>"


def masked(line: Column) -> Column:
    """A line with single blanks and its digit-bearing tokens as variable fields."""
    ragged = reduce(or_, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    plain = F.trim(F.when(ragged, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a token: key of the document row, place, masked line and leaf."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.where("text is not null").select(key.alias("key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("key", "doc_id", "pos", masked(F.col("line")).alias("line")).where("line <> ''")
    size = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "))) + 1
    return rows.withColumn("leaf", F.xxhash64(size, F.substring_index("line", " ", LEAD)))


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Template of each distinct line, leaf by leaf (rows sorted by leaf, part and line)."""
    held: list[tuple[int, str, int, int]] = []

    def leaf() -> pa.RecordBatch:
        held.sort(key=lambda r: (-r[2], r[1]))
        tokens = [r[1].split(" ") for r in held]
        names: dict[str, int] = {FIELD: 0}
        grid = np.array([[names.setdefault(t, len(names)) for t in row] for row in tokens])
        room = np.zeros((16, grid.shape[1]), dtype=grid.dtype)
        known = room[:0]
        which = np.zeros(len(held), dtype=np.int64)
        for k, row in enumerate(grid):
            agree = (known == row).sum(axis=1)
            best = int(agree.argmax()) if len(known) else 0
            if len(known) and agree[best] >= ALIKE * len(row):
                known[best] = np.where(known[best] == row, row, 0)
                which[k] = best
            else:
                which[k] = len(known)
                if len(known) == len(room):
                    room = np.concatenate([room, np.zeros_like(room)])
                known = room[: len(known) + 1]
                known[-1] = row
        words = list(names)
        texts = [" ".join(words[t] for t in row) for row in known]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string()), pa.array([texts[k] for k in which], pa.string())],
            names=["leaf", "line", "template"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (held[0][0], held[0][3]) != (r[0], r[3]):
                yield leaf()
                held.clear()
            held.append(r)
    if held:
        yield leaf()


def _templates(distinct: DataFrame) -> DataFrame:
    """Template of each of distinct(leaf, line, n): (leaf, line, template).

    A crowded leaf is dealt out in as many parts as it has runs. Lines of one template may
    fall into different parts, so the templates of the parts, with the documents of their
    lines, are the lines of another round; the last round of each leaf is a single run.
    """
    sizes = cut_lineage(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > RUN))
    whole = F.lit(False)
    lines, named, turn = distinct, None, 0
    while True:
        runs = small_side(cut_lineage(sizes.select("leaf", F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("size") / RUN)).alias("runs"))))
        part = F.pmod(F.xxhash64("line", F.lit(turn)), F.coalesce("runs", F.lit(1)))
        dealt = lines.join(runs, "leaf", "left").withColumn("part", part).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "line")
        grown = cut_lineage(dealt.select("leaf", "line", "n", "part").mapInArrow(_grow, "leaf long, line string, template string"))
        if named is None:
            named = grown
        else:
            further = grown.select("leaf", F.col("line").alias("template"), F.col("template").alias("_further"))
            named = cut_lineage(named.join(further, ["leaf", "template"], "left").select("leaf", "line", F.coalesce("_further", "template").alias("template")))
        # what one run had is through
        open_leaves = runs.where("runs > 1").select("leaf")
        if not open_leaves.limit(1).count():
            return named
        rest = grown.join(open_leaves, "leaf", "left_semi").join(lines.select("leaf", "line", "n"), ["leaf", "line"])
        lines = cut_lineage(rest.groupBy("leaf", F.col("template").alias("line")).agg(F.sum("n").alias("n")))
        before = sizes.select("leaf", F.col("size").alias("before"))
        sizes = cut_lineage(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).join(before, "leaf"))
        whole = (F.col("size") <= RUN) | (F.col("size") > SHRINK * F.col("before"))
        sizes = cut_lineage(sizes.select("leaf", "size", whole.alias("whole")))
        whole = F.col("whole")
        turn += 1


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, pos) of the lines that go. Leaves that too few documents reach are left out before any text moves.

    Lines and templates meet by their hash: their texts move once, to grow the templates.
    """
    lines = _lines(docs)
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), (F.min("key") != F.max("key")).alias("several"))
    leaves = leaves.where((F.col("n") >= min_docs) & (F.col("several") | F.lit(min_docs < 2))).select("leaf")
    some = cut_lineage(lines.join(small_side(cut_lineage(leaves)), "leaf").withColumn("line_key", F.xxhash64("line")))
    counts = some.select("leaf", "line_key", "key").distinct().groupBy("leaf", "line_key").agg(F.count(F.lit(1)).alias("n"))
    texts = some.select("leaf", "line_key", "line").distinct()
    grown = _templates(cut_lineage(texts.join(counts, ["leaf", "line_key"]).select("leaf", "line", "n")))
    grown = small_side(cut_lineage(grown.select("leaf", F.xxhash64("line").alias("line_key"), F.xxhash64("template").alias("template"))))
    named = cut_lineage(some.select("key", "doc_id", "pos", "leaf", "line_key").join(grown, ["leaf", "line_key"]).select("key", "doc_id", "pos", "leaf", "template"))
    shared = named.select("leaf", "template", "key").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    first = named.groupBy("leaf", "template").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "pos")).alias("first"))
    chosen = small_side(cut_lineage(shared.join(first, ["leaf", "template"]).select("leaf", "template", "first")), 100_000)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "pos")
    return named.join(chosen, ["leaf", "template"]).where(~place.eqNullSafe(F.col("first"))).select("key", "pos")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates removed from ``text``, and n_lines, n_dropped (replacing columns of these names).

    A template recurs if ``min_docs`` rows or more have a line of it; of its lines the
    first stays (smallest doc_id, nulls last, then the place in the text). Lines are parted
    by newlines; lines without tokens never match and stay. Null text stays null with 0
    lines; empty text has one empty line. Rows that repeat another (doc_id and text) lose
    the same lines. Empty table: no rows. All other columns pass through.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    base = docs.select("doc_id", "text")
    gone = recurring_lines(base, min_docs).select("key", "pos").distinct().groupBy("key").agg(F.collect_list("pos").alias("_gone"))
    gone = gone.withColumnRenamed("key", "_key")
    found = kept.withColumn("_key", F.xxhash64("doc_id", "text")).join(gone, "_key", "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda line, k: ~F.array_contains(F.col("_gone"), k))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = [text.alias("text") if c.lower() == "text" else F.col(c) for c in kept.columns]
    return found.select(*out, F.greatest(F.size(lines), F.lit(0)).alias("n_lines"), F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)).alias("n_dropped"))
