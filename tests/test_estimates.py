"""Spark's own estimates: too small ones send tables of pixels through the driver, or too many pixels into one task."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions.text import markup_structure
from mosaiq.operators import jobs, pixels as px, regions as rg, stencil as st
from mosaiq.plans.registry import Tables


@pytest.mark.parametrize("view, rows", [("px", 24 * 24), ("px_pair", 24 * 24), ("px64_pair", 64 * 64)])
def test_estimate_of_a_raster_view_covers_its_rows(spark, view, rows):
    t = Tables(spark, "/root/testdata/sf0.001")
    size = t(view)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size) >= t("supplier").count() * rows * 8


def test_bands_are_not_merged_into_few_tasks(spark):
    px = spark.range(64 * 500).selectExpr("id % 500 AS image_id", "id % 8 AS x", "CAST(id / 4000 AS INT) AS y")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        df = st.banded(px, 1).withColumn("n", F.sum("x").over(st.row_window()))
        assert df.select(F.spark_partition_id().alias("p"), "n").distinct().select("p").distinct().count() == 31
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_facts_sent_to_shares_are_not_broadcast(spark):
    # 100 small rows become 6400 after their shuffle, which Spark does not count
    px = spark.range(100 * 64).selectExpr("id % 100 AS image_id", "CAST(id / 100 AS INT) AS x", "0 AS y")
    known = px.groupBy("image_id").agg(F.max("x").alias("w"))
    for how in ("inner", "left", "left_semi"):
        df = st.with_known(px, known, ["image_id"], how)
        assert df.count() == 100 * 64
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_a_raster_view_follow_its_rows(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert Tables(spark, str(tmp_path))("px").rdd.getNumPartitions() == 40


def test_chain_of_digests_is_not_merged_into_few_tasks(spark):
    rows = [(j, s, f"{j}-{s - 1}" if (j, s) != (7, 2) else "gap", f"{j}-{s}") for j in range(60) for s in (1, 2, 3)]
    stages = spark.createDataFrame(rows, "journal_id long, stage int, parent_sha256 string, accepted_sha256 string")
    ends = spark.createDataFrame([(j, f"{j}-0", f"{j}-3" if j else "other") for j in range(60)], "journal_id long, baseline_sha256 string, final_sha256 string")
    out = jobs.verify_chain(stages, "journal_id", ends)
    assert sorted(map(tuple, out.collect())) == [(0, 3, "journal_final_hash_mismatch"), (7, 2, "stage_parent_hash_mismatch")]
    assert "RepartitionByExpression [journal_id#" in out._jdf.queryExecution().analyzed().toString()


def _fills(raster):
    return raster.select("image_id", "region").distinct().selectExpr("image_id", "region", "CAST(region % 200 AS INT) AS r", "90 AS g", "40 AS b")


@pytest.mark.parametrize("run", [
    lambda p: rg.region_stats(rg.components(p)),
    lambda p: rg.remove_speckles(p),
    lambda p: rg.absorb_islands(rg.components(p), _fills(rg.components(p)), p),
    lambda p: rg.edge_f1(p.selectExpr("image_id", "x", "y", "g", "255 - g AS q"), "g", "q"),
    lambda p: rg.boundary_offsets(p.where("x = 3"), p.where("x = 9"), band=8),
    lambda p: px.fit_linear_gradient(p, "label", 40, min_gain=-1e9),
    lambda p: px.mirror_score(p, min_fg=1),
], ids=["region_stats", "remove_speckles", "absorb_islands", "edge_f1", "boundary_offsets", "fit_linear_gradient", "mirror_score"])
def test_what_grows_with_the_images_is_not_broadcast(spark, run):
    p = spark.range(20 * 144).selectExpr("id % 20 AS image_id", "CAST(id / 20 AS INT) % 12 AS x", "CAST(id / 240 AS INT) AS y").selectExpr(
        "*", "CAST(x / 5 AS INT) AS label", "x * 20 AS r", "CASE WHEN (x * 5 + y * 7) % 23 = 0 THEN 255 ELSE y * 20 END AS g", "40 AS b", "255 AS a")
    df = run(p)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan


def test_products_of_a_similarity_are_not_shuffled(spark):
    pair = spark.range(32 * 32).selectExpr("1 AS image_id", "id % 32 AS x", "CAST(id / 32 AS INT) AS y", "id % 7 AS p", "id % 5 AS q")
    out = st.ssim(pair, "p", "q")
    assert 0 < out.first()["ssim"] < 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert " AS aa#" in plan and " AS aa#" not in below


def test_borders_of_an_image_of_many_bands(spark):
    import numpy as np

    w, h = 21, 150
    v = (np.arange(h)[:, None] * 7 + np.arange(w) * 13) % 31
    px_ = spark.createDataFrame([(1, x, y, int(v[y, x])) for y in range(h) for x in range(w)], "image_id long, x int, y int, v int")
    k = np.array(st.gaussian_weights(1.5))
    r = len(k) // 2
    full = np.pad(v.astype(float), r, mode="symmetric")
    rows = sum(full[:, i : i + w] * k[i] for i in range(2 * r + 1))
    want = sum(rows[i : i + h] * k[i] for i in range(2 * r + 1))
    got = {(p.x, p.y): p.v_blur for p in st.gaussian_blur(px_, ["v"], 1.5).collect()}
    assert len(got) == w * h and all(abs(got[x, y] - want[y, x]) < 1e-9 for y in range(h) for x in range(w))


def test_markup_is_rewritten_once_a_row(spark):
    plan = markup_structure(spark.createDataFrame([(1, "<svg viewBox='0 0 1 1'/>")], "doc_id long, text string"), "doc_id")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert plan.first().codes == ""


def test_colour_differences_are_made_once_for_equal_pairs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(px, "with_delta_e", lambda df, f=px.with_delta_e: seen.append(df.count()) or f(df))
    rows = [(1, *c, *q) for c, q in [((9, 9, 9), (9, 9, 9)), ((0, 7, 3), (0, 7, 3)), ((200, 10, 10), (10, 10, 200)), ((200, 10, 10), (10, 10, 200)), ((50, 60, 70), (50, 60, 90))] for _ in range(4)]
    pair = spark.createDataFrame([*rows, (1, None, 1, 1, 1, 1, 1)], "image_id long, r int, g int, b int, rr int, rg int, rb int")
    got = px.color_metrics(pair).first()
    assert seen == [4]  # unchanged, two changes and a null
    values = [v[0] for v in px.with_delta_e(pair).select("de00").collect() if v[0] is not None]
    assert len(values) >= 20 and got.de00_max == max(values)
    for name, want in (("de00_mean", np.mean(values)), ("de00_p50", np.quantile(values, 0.5)), ("de00_p95", np.quantile(values, 0.95)), ("de00_p99", np.quantile(values, 0.99))):
        assert got[name] == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def sparse(spark):
    """Two images of several bands with gaps, pixels that come twice and missing colours."""
    rnd = random.Random(6)
    rows = [(k, x, y, *[rnd.choice([0, 20, 200, None]) if rnd.random() < 0.5 else 250 for _ in "rgb"]) for k, w, h in ((1, 30, 140), (2, 70, 25)) for x in range(w) for y in range(h) if rnd.random() < 0.8]
    rows += rnd.sample(rows, 300)
    return rows, spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int").repartition(5)


def _mates(rows, axis, shift_of):
    """Each pixel with those that lie on its place once their line is turned and shifted; left alone if there are none."""
    a, o = (1, 2) if axis == "x" else (2, 1)
    size = {k: 1 + max(r[a] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    at = {}
    for r in rows:
        at.setdefault((r[0], r[a], r[o]), []).append(r)
    for r in rows:
        shift = shift_of.get(r[0])
        yield r, [] if shift is None else at.get((r[0], size[r[0]] - 1 - r[a] + shift, r[o]), []), size[r[0]]


@pytest.mark.parametrize("axis, carried", [("x", False), ("y", False), ("x", True)])
def test_mirrors_as_plain_loops_say(sparse, axis, carried):
    rows, p = sparse
    if carried:
        p = p.join(F.broadcast(st.image_size(p).toDF("image_id", "width", "height")), "image_id")
    size = {k: [1 + max(r[a] for r in rows if r[0] == k) for a in (1, 2)] for k in (1, 2)}
    in_corner = lambda r: all(v < max(8, s // 12) or v >= s - max(8, s // 12) for v, s in zip(r[1:3], size[r[0]]))
    back = {k: [statistics.median(r[c] for r in rows if r[0] == k and in_corner(r) and r[c] is not None) for c in (3, 4, 5)] for k in (1, 2)}
    fg = {r: None if None in r[3:] else sum((v - b) ** 2 for v, b in zip(r[3:], back[r[0]])) ** 0.5 > 40 for r in rows}
    want = {}
    for shift in range(-8, 9):
        found = {}
        for r, mates, n in _mates(rows, axis, {1: shift, 2: shift}):
            if n - abs(shift) >= n // 2:
                found.setdefault(r[0], []).extend([abs(u - v) for u, v in zip(r[3:], q[3:]) if None not in (u, v)] for q in mates if fg[r] or fg[q])
        for k, pairs in found.items():
            d = [max(x) for x in pairs if x]
            if len(pairs) >= 200 and d:
                want[k] = min(want.get(k, (999,)), (round(sum(d) / len(d), 9), shift, sum(x > 30 for x in d) / len(pairs)))
    got = {r.image_id: (round(r.mean_diff, 9), r["shift"], r.high_ratio) for r in px.mirror_score(p, axis).collect()}
    assert got == want and len(got) == 2

    scores = p.sparkSession.createDataFrame([(1, 3, 1.0, 0.0), (1, -2, 0.0, 0.0), (2, 5, 9.0, 0.0)], "image_id long, shift int, mean_diff double, high_ratio double")
    turned = []
    for given in ({1: 3, 2: None}, {1: -2}):
        for r, mates, _ in _mates([r for r in rows if r[0] in given], axis, given):
            turned += [(*r[:3], *[u if None in (u, v) and v is None else None if u is None else (u + v) // 2 for u, v in zip(r[3:], q[3:])]) for q in mates or [(None,) * 6]]
    assert sorted(map(str, turned)) == sorted(str(tuple(r)) for r in px.symmetrize(p, scores, axis).collect())


@pytest.mark.parametrize("run", [px.mirror_score, lambda p: px.symmetrize(p, px.mirror_score(p), mean_tol=255.0, hi_tol=1.0)], ids=["mirror_score", "symmetrize"])
def test_pixels_are_not_shuffled_by_their_place(sparse, run):
    out = run(sparse[1])
    assert out.count()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and {re.sub(r"#\d+L?", "", keys) for keys in dealt} <= {"image_id", "image_id, _band", "image_id, shift"}


@pytest.fixture(scope="module")
def pairs(spark):
    """Images of one and of several bands, one too small for a second scale, one of odd size."""
    rnd = np.random.default_rng(8)
    grey = {k: (v := rnd.integers(0, 256, (h, w)), np.where(rnd.random((h, w)) < 0.2, 255 - v, v)) for k, w, h in ((1, 64, 64), (2, 67, 301), (3, 90, 63), (4, 65, 129))}
    rows = [(k, x, y, int(p[y, x]), int(q[y, x])) for k, (p, q) in grey.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return grey, spark.createDataFrame(rows, "image_id long, x int, y int, p long, q long").repartition(7)


def _plain_ssim(p, q):
    k = np.array(st.gaussian_weights(1.5))
    r = len(k) // 2

    def blur(v):
        full = np.pad(v, r, mode="symmetric")
        rows = sum(full[:, i : i + v.shape[1]] * k[i] for i in range(2 * r + 1))
        return sum(rows[i : i + v.shape[0]] * k[i] for i in range(2 * r + 1))

    p, q = p.astype(float), q.astype(float)
    ma, mb = blur(p), blur(q)
    va, vb, cov, c1, c2 = blur(p * p) - ma * ma, blur(q * q) - mb * mb, blur(p * q) - ma * mb, 2.55**2, 7.65**2
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean()


def test_two_scales_of_images_of_many_bands(pairs):
    grey, pair = pairs
    half = lambda v: np.array([[np.floor(v[y : y + 2, x : x + 2].mean() + 0.5) for x in range(0, v.shape[1], 2)] for y in range(0, v.shape[0], 2)])
    want = {k: _plain_ssim(p, q) if min(p.shape) < 64 else 0.6 * _plain_ssim(p, q) + 0.4 * _plain_ssim(half(p), half(q)) for k, (p, q) in grey.items()}
    got = {r.image_id: r.ms_ssim for r in st.ms_ssim(pair, "p", "q").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    carried = st.ms_ssim(pair.join(st.image_size(pair).toDF("image_id", "width", "height"), "image_id"), "p", "q")
    assert {r.image_id: r.ms_ssim for r in carried.collect()} == pytest.approx(want, abs=1e-9)


def test_both_scales_take_the_same_shuffled_pixels(pairs):
    out = st.ms_ssim(pairs[1], "p", "q")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")]
    assert re.search(r"ReusedExchange [^\n]*Exchange hashpartitioning\(image_id#\d+L?, _band", plan) and "_share" not in plan
