"""Hand cases for evidence, selection, jobs, sources and streams."""

import datetime
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import evidence as ev, intake as it, jobs as jb, paths as pt, regions as rg, selection as sel
from mosaiq.operators.ordered import exact_percentiles, running_sums, spread_in_order
from mosaiq.sources import reports as rp
from mosaiq.streaming import streams

CASE = "case_id string, category string, " + ", ".join(f"{m} double" for m in ev.METRICS)


def cases(spark, n=8, **over):
    base = dict(fidelity=99.5, ssim=0.99, edge_f1=0.99, alpha_iou=None, delta_e00=1.0, path_count=10.0, svg_bytes=100.0, render_ms=1000.0, peak_rss_mb=50.0)
    base.update(over)
    return spark.createDataFrame([(f"c{i}", "logos", *[base[m] for m in ev.METRICS]) for i in range(n)], CASE)


@pytest.mark.parametrize("parts", [1, 16])
def test_percentiles_are_exact_for_skewed_keys(spark, parts):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", rnd.choice([rnd.random(), 0.5, 1e6 * rnd.random()])) for _ in range(3000)] + [("k1", None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k string, v double")
        lin = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect()}
        near = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.05, "c": 0.95}, discrete=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    for key in {k for k, _ in rows}:
        v = np.array(sorted(x for k, x in rows if k == key and x is not None))
        for name, q in (("a", 5), ("b", 50), ("c", 95)):
            assert lin[key][name] == pytest.approx(np.percentile(v, q), rel=1e-12)
        for name, q in (("a", 0.05), ("c", 0.95)):
            assert near[key][name] == v[max(1, int(np.ceil(q * len(v)))) - 1]


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums(spark, keys):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(50), i, rnd.randrange(10)) for i in range(500)]
    out = running_sums(spark.createDataFrame(rows, "k string, t int, i int, v int"), keys, ["t", "i"], "v", "s", "all").collect()
    assert len(out) == 500
    for r in out:
        mine = [x for x in rows if not keys or x[0] == r["k"]]
        assert r["s"] == sum(v for _, t, i, v in mine if (t, i) < (r["t"], r["i"]))
        assert r["all"] == sum(x[3] for x in mine)


def test_one_key_with_all_rows_spreads_over_all_tasks(spark):
    rows = spark.range(4000).selectExpr("'hot' as k", "id as t", "1L as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in spread_in_order(rows, ["k"], ["t"]).groupBy("_part").count().collect()]
        assert len(parts) == 8 and max(parts) < 1000
        assert running_sums(rows, ["k"], ["t"], "v", "s").where("s <> t").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # a flood within one second is numbered all the same
    flood = spark.range(300).selectExpr("id as event_id", "'login' as namespace", "7 as key_id", "timestamp'2024-01-01 00:00:05' as ts")
    got = {r.event_id: (r["count"], r.allowed) for r in jb.attempt_windows(flood, 10, 60).collect()}
    assert got == {k: (k + 1, k < 10) for k in range(300)}


def test_sessions_cut_into_aligned_blocks(spark):
    rnd = random.Random(4)
    spans = [(a := rnd.randrange(5000), a + rnd.randrange(3000)) for _ in range(200)] + [(0, 0), (7, 8), (0, 1023)]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", jb.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect():
        seconds = sorted(x for c in r.c for x in range(c.block << c.level, (c.block + 1) << c.level))
        assert seconds == list(range(r.a, r.b + 1)) and len(r.c) <= 2 * (r.b - r.a + 1).bit_length()
    decade = spark.createDataFrame([(1_000_000_007, 1_000_000_007 + 10 * 365 * 86400)], "a long, b long")
    assert decade.select(F.size(jb.dyadic_cover(F.col("a"), F.col("b")))).first()[0] < 100


def test_active_sessions(spark):
    rnd = random.Random(5)
    at = lambda s: None if s is None else f"2024-01-01 00:00:00.{rnd.randrange(10)}" if s < 0 else (datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)).isoformat(sep=" ")
    sessions, probes = [], []
    for k in range(120):
        a = rnd.randrange(100_000)
        sessions.append((k, rnd.randrange(4), at(a), at(rnd.choice([a + 1, a + 5000.5, a + 10**8, a - 3, a])), at(rnd.choice([None, a + 700]))))
        probes.append((k, rnd.randrange(4), at(rnd.choice([rnd.randrange(110_000), a, a + 1, a + 700, a + 699.9]))))
    stamp = lambda df, *cs: df.select(*[F.col(c).cast("timestamp").alias(c) if c in cs else c for c in df.columns])
    s = stamp(spark.createDataFrame(sessions, "session_id int, user_id int, created_at string, expires_at string, revoked_at string"), "created_at", "expires_at", "revoked_at")
    p = stamp(spark.createDataFrame(probes, "probe_id int, user_id int, ts string"), "ts")
    want = {(x.probe_id, y.session_id) for x in p.collect() for y in s.collect()
            if x.user_id == y.user_id and y.created_at <= x.ts < y.expires_at and (y.revoked_at is None or x.ts < y.revoked_at)}
    got = [(r.probe_id, r.session_id) for r in jb.active_sessions(s, p).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    assert jb.active_sessions(s.limit(0), p).count() == 0


def test_digest_of_a_row_set(spark):
    rows = [(k % 7, None if k % 5 == 0 else f"v{k % 3}") for k in range(60)]
    make = lambda r, n=3: ev.canonical_digest(spark.createDataFrame(r, "a int, b string").repartition(n), ["b", "a"]).first()
    assert make(rows) == make(rows[::-1], 11) and make(rows).row_count == 60
    assert make(rows).digest not in (make(rows + rows[:1]).digest, make(rows[1:]).digest, make([(0, "x")] + rows[1:]).digest)
    assert make([]).row_count == 0 and len(make([]).digest) == 64


def test_digest_is_the_hash_of_all_sorted_row_hashes(spark):
    rows = [(k % 900, f"v{k % 900}") for k in range(2000)]
    counts = Counter(hashlib.sha256(f'{{"a":{a},"b":"{b}"}}'.encode()).hexdigest() for a, b in rows)
    parts = {}
    for h, n in sorted(counts.items()):
        parts.setdefault(int(h[:6], 16) % 256, []).append(f"{h}x{n}")
    sha = lambda items: hashlib.sha256(",".join(items).encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # parts go over several batches
    try:
        got = ev.canonical_digest(spark.createDataFrame(rows, "a int, b string"), ["b", "a"]).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(got) == (2000, sha(f"{p:09d}:{sha(parts[p])}" for p in sorted(parts)))


def test_release_gate_paths(spark):
    base = cases(spark)
    gate = lambda b, c, t=None: tuple(ev.release_gate(b, c, t).first()[:2])
    assert gate(None, base) == ("bootstrap", "baseline_missing")
    assert gate(base, base) == ("pass", "within_tolerance")
    assert gate(base, cases(spark, 9)) == ("bootstrap", "case_set_expanded")
    assert gate(cases(spark, 9), base) == ("fail", "case_set_mismatch")
    assert gate(base, cases(spark, ssim=None)) == ("fail", "unmeasured_required_metrics")
    assert gate(base, cases(spark, ssim=0.9)) == ("fail", "metric_regression")
    # a common 1.4x slowdown is normalised away, 1.6x is not
    assert gate(base, cases(spark, render_ms=1400.0)) == ("pass", "within_tolerance")
    assert gate(base, cases(spark, render_ms=1600.0)) == ("fail", "metric_regression")
    assert gate(base, cases(spark, render_ms=1600.0), cases(spark, render_ms=1500.0)) == ("pass", "within_tolerance")
    assert gate(base, base, cases(spark, render_ms=None)) == ("fail", "invalid_same_runner_timing_baseline")


def test_release_gate_reads_each_side_once(spark, tmp_path):
    for side in ("base", "cur"):
        cases(spark).write.parquet(f"{tmp_path}/{side}")
    gate = ev.release_gate(*[spark.read.parquet(f"{tmp_path}/{side}") for side in ("base", "cur")])
    assert tuple(gate.first()[:2]) == ("pass", "within_tolerance")
    assert "parquet" not in gate._jdf.queryExecution().executedPlan().toString()


def test_nulls_are_never_filled(spark):
    df = spark.createDataFrame([("a", 1, "s", None, 3.0), ("a", 2, "s", None, 1.0)], "case_id string, repeat_index int, artifact_sha256 string, ssim double, render_ms double")
    for m in ev.METRICS:
        if m not in df.columns:
            df = df.withColumn(m, F.lit(None).cast("double"))
    r = ev.aggregate_repeats(df, ["case_id"]).first()
    assert r["ssim"] is None and r["render_ms"] == 2.0 and r["error"] is None


def test_clean_evidence_passes_gates(spark):
    sha = "0" * 64
    good = spark.createDataFrame([(f"c{i}", sha, sha, sha, 0.99, 0.995, 3, ["color"], 0) for i in range(24)], "case_id string, input_sha256 string, model_sha256 string, output_sha256 string, pre_fidelity double, post_fidelity double, edit_count int, edit_classes array<string>, defects int")
    assert ev.refiner_gate(good).count() == 0
    assert {r["code"] for r in ev.refiner_gate(good.withColumn("post_fidelity", F.when(F.col("case_id") == "c0", 0.5).otherwise(0.995))).collect()} >= {"fidelity_regression"}
    final = spark.createDataFrame([("a", 0.99, 0.99, 0.99, 0.99, 0.99, 0.995, True)], "case_id string, geometric double, edge double, color double, typography double, print_readiness double, overall_fidelity double, published boolean")
    assert ev.final_gate(final).count() == 0
    assert [r["code"] for r in ev.final_gate(final.withColumn("published", F.lit(False))).collect()] == ["qualified_artifact_not_published"]


def test_pareto_bruteforce_on_one_hot_job(spark):
    rnd = random.Random(2)
    rows = [(7, f"n{i}", rnd.randrange(60) / 4, rnd.randrange(20) / 20, rnd.randrange(40)) for i in range(600)]
    rows += [(8, "x", 1.0, 1.0, 1), (8, "y", 1.0, 1.0, 1), (8, "z", 1.0, 1.0, 2)]
    df = spark.createDataFrame(rows, "job_id long, name string, fidelity double, edge_f1 double, path_count int").repartition(6)
    beats = lambda a, b: a[2] >= b[2] and a[3] >= b[3] and a[4] <= b[4] and (a[2] > b[2] or a[3] > b[3] or a[4] < b[4])
    want = {(r[0], r[1]) for r in rows if not any(o[0] == r[0] and beats(o, r) for o in rows)}
    assert {tuple(r) for r in sel.pareto_frontier(df).collect()} == want
    for slice_rows in (1, 7, 50):
        assert {tuple(r) for r in sel.pareto_frontier(df, slice_rows).collect()} == want
    odd = spark.createDataFrame([(1, "a", None, 0.5, 3), (1, "b", 9.0, 0.9, 1), (1, "c", float("nan"), 0.1, 9), (None, "d", 1.0, 0.1, 9), (1, "e", 1.0, 0.1, 9)], df.schema)
    assert {r.name for r in sel.pareto_frontier(odd).collect()} == {"a", "b", "c", "d"}
    assert sel.pareto_frontier(df.limit(0)).count() == 0


def test_frontier_of_a_job_that_is_all_frontier(spark):
    """A million candidates of one job, none or few of them dominated, in slices."""
    n = 1_000_000
    line = spark.range(n).selectExpr("1L as job_id", "cast(id as string) as name", "cast(id as double) as fidelity", f"cast({n} - id as double) as edge_f1", "1 as path_count")
    spoilt = line.where("id % 1000 = 0").selectExpr("job_id", "name || 'x' as name", "fidelity - 0.5 as fidelity", "edge_f1 - 0.25 as edge_f1", "path_count")
    got = sel.pareto_frontier(line.select("job_id", "name", "fidelity", "edge_f1", "path_count").unionByName(spoilt))
    assert got.where("name like '%x'").count() == 0 and got.count() == n


def test_editability_respects_quality_floor(spark):
    rows = [(1, "best", 1, 79.0, 0.9, 100, 70.0, True), (1, "lean", 2, 77.9, 0.9, 10, 70.0, True), (2, "best", 1, 90.0, 0.9, 100, 70.0, True), (2, "lean", 2, 88.0, 0.9, 10, 70.0, True)]
    df = spark.createDataFrame(rows, "job_id long, name string, ord int, fidelity double, edge_f1 double, path_count int, total_score double, rendered_ok boolean")
    assert {r["job_id"]: r["chosen"] for r in sel.editability_preference(df).collect()} == {1: "best", 2: "lean"}


def test_dedupe_compares_with_last_kept_point(spark):
    pts = [(1, i, x, 0.0, True) for i, x in enumerate([0.0, 0.4, 0.8, 1.2, 5.0, 0.1])]
    got = pt.dedupe_points(spark.createDataFrame(pts, "path_id long, seq int, x double, y double, closed boolean"), 0.6).orderBy("seq").collect()
    assert [r["x"] for r in got] == [0.0, 0.8, 5.0]


def test_corner_intersections_keep_square(spark):
    pts = [(1, i, float(x), float(y), True) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])]
    df = spark.createDataFrame(pts, "path_id long, seq int, x double, y double, closed boolean")
    assert sorted(tuple(r) for r in pt.corner_intersections(df, 5.0).collect()) == sorted(tuple(r) for r in df.collect())


def test_half_edges_of_a_square(spark):
    h = "graph_id long, id string, twin_id string, curve_id int, reversed boolean, origin string, dest string, next_id string, prev_id string"
    rows = [(1, "a", "b", 0, False, "v", "v", "a", "a"), (1, "b", "a", 0, True, "v", "v", "b", "b")]
    f = spark.createDataFrame([(1, "f", True, False, "c")], "graph_id long, id string, visible boolean, is_exterior boolean, outer_cycle_id string")
    c = spark.createDataFrame([(1, "c", "f", True, False)], "graph_id long, id string, face_id string, is_outer boolean, is_inner_of_face boolean")
    v = spark.createDataFrame([(1, "v", 0.0, float("nan"))], "graph_id long, id string, x double, y double")
    codes = lambda r: {x["code"] for x in rg.validate_half_edges(spark.createDataFrame(r, h), f, c, v).collect()}
    assert codes(rows) == {"nonfinite_coordinate"}
    assert codes([rows[0][:2] + ("gone",) + rows[0][3:], rows[1]]) == {"nonfinite_coordinate", "twin_missing"}


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.5)], "job_id long, state string, score double")
    rp.write_checked(df, str(tmp_path / "env"), "job_id", ["state", "score"])
    ok, bad = rp.read_checked(spark, str(tmp_path / "env"))
    assert ok.count() == 2 and bad.count() == 0 and '"score":null' in ok.where("job_id = 1").first()["payload"]
    spark.read.parquet(str(tmp_path / "env")).withColumn("payload", F.lit("{}")).write.parquet(str(tmp_path / "env2"))
    assert rp.read_checked(spark, str(tmp_path / "env2"))[1].count() == 2
    rec = spark.createDataFrame([(1, "aa1", "png"), (2, "aa1", "png"), (3, "bb2", "png")], "case_id long, source_sha256 string, source_format string")
    for _ in range(2):
        rp.write_content_addressed(rec, str(tmp_path / "cas"))
    assert spark.read.parquet(str(tmp_path / "cas")).count() == 2
    for _ in range(2):
        rp.append_telemetry(df, str(tmp_path / "tel"))
    assert spark.read.json(str(tmp_path / "tel")).count() == 4
    rp.export_report(df, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 2


def test_log_and_result_readers(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"job_id":"' + "a" * 32 + '","issue_type":"other"}\n\n{broken\n')
    assert rp.read_feedback_log(spark, str(tmp_path / "f.jsonl")).count() == 1
    (tmp_path / "r.json").write_text('{"schema_version":"benchmark-results-v1",\n"results":[{"case_id":"c","metrics":{"ssim":0.5,"fidelity":null}}]}')
    got = {r["metric"]: r["value"] for r in rp.read_bench_results(spark, str(tmp_path / "r.json")).collect()}
    assert len(got) == 9 and got["ssim"] == 0.5 and got["fidelity"] is None


def test_chain_and_duplicates(spark):
    st = spark.createDataFrame([(1, 1, "s", "a"), (1, 2, "a", "b"), (1, 3, "x", "c")], "journal_id long, stage int, parent_sha256 string, accepted_sha256 string")
    assert [(r["stage"], r["code"]) for r in jb.verify_chain(st).collect()] == [(3, "stage_parent_hash_mismatch")]
    new = spark.createDataFrame([("n1", "d1"), ("n2", "d9")], "case_id string, source_sha256 string")
    old = spark.createDataFrame([("o1", "d1"), ("n2", "d2")], "case_id string, source_sha256 string")
    got = {(r["case_id"], r["code"]) for r in it.reject_duplicates(new, old, ["case_id", "source_sha256"]).collect()}
    assert got == {("n1", "duplicate_source_sha256"), ("n2", "duplicate_case_id")}


def test_late_attempts_are_dropped(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    write = lambda rows: spark.createDataFrame(rows, "ts string, namespace string, key_id long").select(F.col("ts").cast("timestamp").alias("ts"), "namespace", "key_id").coalesce(1).write.mode("append").parquet(str(src))
    write([("2024-01-01 00:00:10", "login", 1), ("2024-01-01 00:00:20", "login", 1)])
    schema = spark.read.parquet(str(src)).schema

    def run():
        counts = streams.stream_attempts(spark.readStream.schema(schema).parquet(str(src)), 2, 60)
        q = counts.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    write([("2024-01-01 01:00:00", "login", 1)])
    run()
    write([("2024-01-01 00:00:30", "login", 1)])  # an hour late: beyond two windows
    run()
    best = spark.read.parquet(str(out)).groupBy("window_start").agg(F.max("count").alias("n")).orderBy("window_start").collect()
    assert [r["n"] for r in best] == [2, 1]
