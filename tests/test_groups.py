"""Small groups share a call of Python, large ones stay whole over batches."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from mosaiq.operators import pixels, regions as rg
from mosaiq.operators.ordered import map_whole_groups


def test_small_groups_share_calls_and_none_is_cut(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 900 THEN 'big' WHEN id % 50 = 0 THEN NULL ELSE CAST(id % 400 AS STRING) END AS k", "id AS v")

    def sums(t: pa.Table) -> pa.Table:
        g = t.group_by("k").aggregate([("v", "sum"), ("v", "count")])
        return pa.table({"k": g["k"], "total": g["v_sum"], "n": g["v_count"], "groups": pa.array([len(g)] * len(g))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = map_whole_groups(df, ["k"], ["v"], sums, "k string, total long, n long, groups long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    expected = {r["k"]: (r["total"], r["n"]) for r in df.groupBy("k").agg(F.sum("v").alias("total"), F.count("v").alias("n")).collect()}
    assert {r["k"]: (r["total"], r["n"]) for r in out} == expected and len(out) == len(expected)
    assert sum(1 / r["groups"] for r in out) < len(out) / 3  # calls


def test_components_of_neighbouring_groups_do_not_touch(spark):
    # images without a gap in their scanlines: the last line of one and the first of the next share columns and label
    px = spark.createDataFrame([(i, x, y, 1) for i in range(40) for y in (i % 3, i % 3 + 1) for x in range(3)], "image_id long, x int, y int, label int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = rg.components(px).groupBy("image_id").agg(F.collect_set("region").alias("r")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {r["image_id"]: r["r"] for r in got} == {i: [(i % 3) * rg.STEP] for i in range(40)}


def test_forests_of_many_images_in_one_call(spark, monkeypatch):
    monkeypatch.setattr(rg, "EDGE_CHUNK", 3)
    edges = spark.createDataFrame([(f"i{i}", n, n + 1) for i in range(30) for n in range(i % 9 + 1)], "image_id string, u long, v long")
    got = rg.graph_components(edges)
    assert got.where("root <> 0").count() == 0
    assert got.count() == sum(i % 9 + 2 for i in range(30))


def test_mixtures_of_many_images_and_palettes_in_one_call(spark):
    palettes = [[(0, 0, 0), (200, 200, 200)], [(0, 0, 0), (200, 0, 0), (0, 200, 0)], []]
    colors = [(100, 100, 100), (80, 80, 0), (100, 0, 0), (0, 0, 200)]
    rows = [(i, 100 * j, 300 * j, *c) for i in range(30) for j, c in enumerate(colors)]
    px_ = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")
    anchors = spark.createDataFrame([(i, [dict(zip("rgb", map(float, c))) for c in palettes[i % 3]]) for i in range(29)], "image_id long, anchors array<struct<r:double,g:double,b:double>>")
    out = pixels.mixture_of(px_, anchors, 10.0)
    assert "sequence(0, 7)" not in out._jdf.queryExecution().analyzed().toString()  # answers are sent once, not to eight shares
    got = {(r["image_id"], (r["r"], r["g"], r["b"])) for r in out.where("is_mixture").collect()}
    of = {0: [(100, 100, 100)], 1: [(80, 80, 0), (100, 0, 0)], 2: []}
    assert got == {(i, c) for i in range(29) for c in of[i % 3]} and out.count() == len(rows)
