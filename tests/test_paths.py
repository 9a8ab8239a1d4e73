"""Path operators over blocks: the same for every block size, and as plain loops give them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import paths as pt

POINTS = "path_id long, seq int, x double, y double, closed boolean"


@pytest.fixture(scope="module")
def outlines(spark):
    """Paths of 1 to 90 points, open and closed, with axis runs, dwelling points and noise."""
    rnd = random.Random(11)
    rows = []
    for path, n in enumerate([1, 2, 3, 4, 5, 9, 10, 11, 24, 25, 60, 90] * 2):
        x = y = 0.0
        for i in range(n):
            rows.append((path, i, x, y, path % 3 != 0))
            step = rnd.choice([(5, 0), (0, 5), (5, 0.1), (0.2, 0.1), (0, 0), (-3, 4), (4, 4), (5, 5.2)])
            x, y = x + step[0] + rnd.random() * 0.01, y + step[1]
    rows += [(500, i, 20 * math.cos(i / 8), 20 * math.sin(i / 8), True) for i in range(50)]
    rows += [(501, i, float(i), 3.0, True) for i in range(40)]  # one run all around
    return rows, spark.createDataFrame(rows, POINTS).repartition(5).cache()


def rounded(df):
    return sorted(str(tuple(round(v, 7) if isinstance(v, float) else v for v in r)) for r in df.collect())


OPERATORS = {
    "turn": lambda p, b: pt.turn_angle(p, 2, b), "collinear": lambda p, b: pt.merge_collinear(p, 30.0, b), "axis": lambda p, b: pt.snap_axis_groups(p, 10.0, b),
    "diagonal": lambda p, b: pt.snap_diagonal(p, 10.0, b), "corners": lambda p, b: pt.corner_intersections(p, 10.0, b), "stats": lambda p, b: pt.run_stats(p, b),
    "taubin": lambda p, b: pt.taubin_smooth(p, 5, b), "area": lambda p, b: pt.signed_area(p, b), "circularity": lambda p, b: pt.circularity(p, b),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_block_size_changes_nothing(outlines, name):
    _, df = outlines
    whole = rounded(OPERATORS[name](df, 1000))
    assert len(whole) > 20
    assert rounded(OPERATORS[name](df, 7)) == whole


def plain_dedupe(rows, tol):
    out = []
    for path in sorted({r[0] for r in rows}):
        kept = []
        for _, i, x, y, closed in sorted(r for r in rows if r[0] == path):
            if not kept or math.hypot(x - kept[-1][2], y - kept[-1][3]) > tol:
                kept.append((path, len(kept), x, y, closed, i))
        if len(kept) > 1 and math.hypot(kept[-1][2] - kept[0][2], kept[-1][3] - kept[0][3]) <= tol:
            kept.pop()
        out += kept
    return sorted(out)


@pytest.mark.parametrize("block", [4, 1000])
def test_dedupe_as_a_loop(outlines, block):
    rows, df = outlines
    assert sorted(tuple(r) for r in pt.dedupe_points(df, 5.5, block).collect()) == plain_dedupe(rows, 5.5)


def test_short_paths_are_walked_many_at_once(spark, outlines):
    rows, df = outlines
    got = pt.dedupe_points(df, 5.5)
    assert sorted(tuple(r) for r in got.collect()) == plain_dedupe(rows, 5.5)
    assert "CoGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    longer = [(10_000, i, float(i), 0.0, False) for i in range(400)]
    mixed = df.unionByName(spark.createDataFrame(longer, df.schema))
    assert sorted(tuple(r) for r in pt.dedupe_points(mixed, 5.5, 100).collect()) == plain_dedupe(rows + longer, 5.5)


def test_runs_around_the_end(spark):
    """A run over the end of a closed path is one run, an open path ends its runs."""
    y = [1.0, 2.0, 10.0, 200.0, 3.0, 6.0]
    for closed in (True, False):
        df = spark.createDataFrame([(1, i, [0.0, 100.0, 200.0, 100.0, -200.0, -100.0][i], v, closed) for i, v in enumerate(y)], POINTS)
        for block in (2, 100):
            got = [r.y for r in pt.snap_axis_groups(df, 6.0, block).orderBy("seq").collect()]
            tied = [(4, 5, 0, 1, 2), (3,)] if closed else [(0, 1, 2), (3,), (4, 5)]
            assert got == pytest.approx([sum(y[j] for j in run) / len(run) for i in range(6) for run in tied if i in run])


def test_one_long_path_takes_many_tasks(spark):
    n = 400_000
    line = spark.range(n).selectExpr("1L as path_id", "cast(id as int) as seq", "id * 0.25D as x", "cast(id % 3 as double) * 0.01 as y", "false as closed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = pt.blocked(line, 12)
        sizes = [r["count"] for r in df.withColumn("t", F.spark_partition_id()).groupBy("_blk").count().collect()]
        assert len(sizes) == -(-n // pt.BLOCK) and max(sizes) <= pt.BLOCK + 24
        assert pt.dedupe_points(line, 0.6).count() == -(-n // 3)
        assert pt.taubin_smooth(line).count() == n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
