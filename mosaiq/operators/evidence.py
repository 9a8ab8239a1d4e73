"""Benchmark evidence: repeats, deltas, gates and audits over result tables.

Wide results have one row per (side, case, repeat) and nullable metric columns;
``to_long`` gives (ids, metric, value) with nulls kept.  Missing measurements
stay null everywhere and are never filled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.functions.columns import codes, finite, is_digest, lookup
from mosaiq.operators.ordered import exact_percentiles
from mosaiq.session import cut_lineage

# Metric names, directions and tolerances.
HIGHER = ["fidelity", "ssim", "edge_f1", "alpha_iou"]
LOWER_QUALITY = ["delta_e00", "path_count", "svg_bytes"]
PERFORMANCE = ["render_ms", "peak_rss_mb"]
LOWER = LOWER_QUALITY + PERFORMANCE
METRICS = HIGHER + LOWER
TOLERANCES = {
    "fidelity": 0.002, "ssim": 0.002, "edge_f1": 0.003, "alpha_iou": 0.003, "delta_e00": 0.25,
    "path_count": 0.05, "svg_bytes": 0.05, "render_ms": 0.10, "peak_rss_mb": 0.10,
}
RELEASE_TOLERANCES = {**TOLERANCES, "render_ms": 0.25}
CATEGORIES = [
    "logos", "seals", "technical", "signatures", "gradients", "low_resolution", "transparent", "multilingual",
]
ALPHA_CATEGORIES = ["transparent"]
ALERT_RULES = [("alpha_iou", "<", 0.95), ("ssim", "<", 0.97), ("render_ms", ">", 15000.0)]
QUALITY_THRESHOLDS = {"fidelity": 99.0, "ssim": 0.98, "edge_f1": 0.98, "alpha_iou": 0.98}
COVERAGE_METRICS = ["alpha_iou", "delta_e00", "edge_f1", "ssim"]
RETRY_CLASSES = ["TimeoutError", "isolated_worker_exit", "isolated_worker_no_result"]
ARTIFACT_LIMITS = {"ink_recall": 0.995, "ink_precision": 0.975, "seam_ratio": 0.002, "halo_ratio": 0.02}
VOLATILE_PROVENANCE = [
    "exact_evaluator_failure_message_sanitized", "repeat_count", "repeat_provenance_schema", "repeat_provenance",
]
EDIT_CLASSES = ["geometry", "color", "topology", "artifact_cleanup"]
PRINT_FORMATS = ["svg", "pdf", "eps", "dxf"]
FINAL_COMPONENTS = ["geometric", "edge", "color", "typography", "print_readiness"]


def to_long(df: DataFrame, ids: list[str], metrics: list[str] = METRICS) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def validate_manifest(cases: DataFrame) -> DataFrame:
    """Violations of benchmark cases: one row per (case_id, code)."""
    repeated = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit(True).alias("_dup"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    path = F.col("source_path")
    checked = cases.join(repeated, "case_id", "left").select(
        "case_id",
        F.explode(
            codes(
                ("case_id_required", blank("case_id")),
                ("unsupported_category", ~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))),
                ("source_path_required", blank("source_path")),
                ("license_id_required", blank("license_id")),
                ("invalid_source_sha256", ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))),
                ("duplicate_case_id", F.col("_dup")),
                ("source_path_escapes_root", path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")),
            )
        ).alias("code"),
    )
    return checked


def diff_manifests(base: DataFrame, cur: DataFrame) -> DataFrame:
    """added / removed / changed / stable per case of two manifest generations."""
    b = base.select("case_id", F.col("source_sha").alias("_b"), F.lit(True).alias("_in_b"))
    c = cur.select("case_id", F.col("source_sha").alias("_c"), F.lit(True).alias("_in_c"))
    return b.join(c, "case_id", "full_outer").select(
        "case_id",
        F.when(F.col("_in_b").isNull(), "added")
        .when(F.col("_in_c").isNull(), "removed")
        .when(~F.col("_b").eqNullSafe(F.col("_c")), "changed")
        .otherwise("stable")
        .alias("change"),
    )


def manifest_status(diff: DataFrame, baseline_available: bool = True) -> DataFrame:
    n = lambda kind: F.count_if(F.col("change") == kind)
    status = F.when(n("added") + n("removed") + n("changed") > 0, "changed").otherwise("stable")
    return diff.agg(
        (status if baseline_available else F.lit("bootstrap")).alias("status"),
        F.count_if(F.col("change") != "removed").alias("case_count"),
        n("added").alias("added"), n("removed").alias("removed"), n("changed").alias("changed"),
    )


def aggregate_repeats(repeats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per case: worst repeat for quality, median for performance.

    Disagreeing artifacts or a failed repeat give an ``error`` and null metrics.
    ``failure`` is optional in the input.
    """
    failed = F.count("failure") if "failure" in repeats.columns else F.lit(0)
    worst = [F.min(m).alias(m) for m in HIGHER] + [F.max(m).alias(m) for m in LOWER_QUALITY]
    out = repeats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("repeats"),
        F.min("artifact_sha256").alias("_lo"),
        F.max("artifact_sha256").alias("_hi"),
        F.count_if(F.col("artifact_sha256").isNull()).alias("_nosha"),
        failed.alias("_failed"),
        # repeats of one case are few by definition, so their median needs no sliced form
        *worst, *[F.bround(F.percentile(m, 0.5), 6).alias(m) for m in PERFORMANCE],
    )
    same = (F.col("_lo") == F.col("_hi")) & (F.col("_nosha") == 0) | (F.col("_nosha") == F.col("repeats"))
    error = F.when(~F.coalesce(same, F.lit(False)), "non_deterministic_artifact").when(
        F.col("_failed") > 0, "benchmark_repeat_failed"
    )
    out = out.withColumn("error", error)
    return out.select(
        *keys, "repeats", "error",
        F.when(F.col("error").isNull(), F.col("_lo")).alias("artifact_sha256"),
        *[F.when(F.col("error").isNull(), F.col(m)).alias(m) for m in METRICS],
    )


def metric_status(tolerances: dict[str, float] = TOLERANCES) -> Column:
    """Status of a (metric, baseline, current) row; null sides are unmeasurable."""
    tol = lookup("metric", tolerances)
    delta = F.col("current") - F.col("baseline")
    shift = F.when(
        F.col("metric").isin(LOWER) & (F.col("baseline") != 0), delta / F.abs("baseline")
    ).otherwise(delta)
    gain = F.when(F.col("metric").isin(HIGHER), shift).otherwise(-shift)
    return (
        F.when(F.col("baseline").isNull() | F.col("current").isNull(), "unmeasurable")
        .when(gain < -tol, "regression")
        .when(gain > tol, "improvement")
        .otherwise("stable")
    )


def metric_delta(base: DataFrame, cur: DataFrame, keys: list[str], tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """Join two long tables on keys + metric and classify each change."""
    b = base.select(*keys, "metric", F.col("value").alias("baseline"))
    c = cur.select(*keys, "metric", F.col("value").alias("current"))
    return classified(b.join(c, keys + ["metric"]), keys, tolerances)


def classified(pairs: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Adds change and status to rows (keys, metric, baseline, current)."""
    delta = F.col("current") - F.col("baseline")
    return pairs.select(
        *keys, "metric", "baseline", "current",
        delta.alias("delta"),
        F.when(F.col("baseline") != 0, delta / F.abs("baseline")).alias("relative_delta"),
        metric_status(tolerances).alias("status"),
    )


def alpha_not_applicable() -> Column:
    """alpha_iou is compared only for categories where alpha matters."""
    return (F.col("metric") == "alpha_iou") & ~F.col("category").isin(ALPHA_CATEGORIES)


def delta_report(deltas: DataFrame) -> DataFrame:
    """Case status rolled up per category and overall (null category = all)."""
    cases = (
        deltas.where(~alpha_not_applicable())
        .groupBy("category", "case_id")
        .agg(F.count_if(F.col("status") == "regression").alias("_r"))
    )
    return cases.rollup("category").agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(F.col("_r") > 0).alias("regression_count"),
        F.when(F.count_if(F.col("_r") > 0) > 0, "fail").otherwise("pass").alias("status"),
    )


def unmeasured(results: DataFrame) -> DataFrame:
    """(case_id, metric) pairs that the category requires but are null or absent."""
    long = to_long(results, ["case_id", "category"])
    return long.where(~alpha_not_applicable() & F.col("value").isNull()).select("case_id", "metric").distinct()


def normalize_common_timing(
    deltas: DataFrame, min_cases: int = 6, share: float = 0.75, trigger: float = 0.10, max_factor: float = 1.50
) -> DataFrame:
    """One row: whether a bounded common slowdown explains the timing, and its factor.

    Applies only if render_ms is the single regressed metric.
    """
    timing = deltas.where("metric = 'render_ms'").withColumn("ratio", F.col("current") / F.col("baseline"))
    facts = deltas.agg(
        F.count_if(F.col("status") == "regression").alias("_reg"),
        F.count_if((F.col("status") == "regression") & (F.col("metric") != "render_ms")).alias("_other"),
        F.count_if(F.col("metric") == "render_ms").alias("case_count"),
        F.count_if((F.col("metric") == "render_ms") & ((F.col("baseline") <= 0) | (F.col("current") <= 0))).alias("_bad"),
        F.count_if((F.col("metric") == "render_ms") & (F.col("current") / F.col("baseline") > 1.0 + trigger)).alias("slow_case_count"),
    )
    factor = exact_percentiles(timing, [], "ratio", {"factor": 0.5})
    joined = facts.join(F.broadcast(factor), F.lit(True), "left")  # both sides are one row
    applied = (
        (F.col("_reg") > 0) & (F.col("_other") == 0) & (F.col("_bad") == 0)
        & (F.col("case_count") >= min_cases)
        & (F.col("slow_case_count") / F.col("case_count") >= share)
        & (F.col("factor") > 1.0 + trigger) & (F.col("factor") <= max_factor)
    )
    return joined.select(
        F.coalesce(applied, F.lit(False)).alias("applied"), "factor", "case_count", "slow_case_count"
    )


def same_run_baseline(historical: DataFrame, timing: DataFrame) -> DataFrame:
    """Historical long baseline with render_ms replaced from the timing run.

    A case whose timing is missing or not positive gets a null (unmeasured) value.
    """
    t = timing.where("metric = 'render_ms'").select("case_id", F.lit("render_ms").alias("metric"), F.col("value").alias("_t"))
    return historical.join(t, ["case_id", "metric"], "left").select(
        *[c for c in historical.columns if c != "value"],
        F.when(F.col("metric") == "render_ms", F.when(F.col("_t") > 0, F.col("_t"))).otherwise(F.col("value")).alias("value"),
    )


def release_gate(base: DataFrame | None, cur: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """One-row verdict over wide per-case results (case_id, category, metrics)."""
    count_gaps = lambda results: unmeasured(results).agg(F.count(F.lit(1)).alias("unmeasured"))
    if base is None:
        return count_gaps(cur).select(
            F.when(F.col("unmeasured") > 0, "fail").otherwise("bootstrap").alias("status"),
            F.when(F.col("unmeasured") > 0, "unmeasured_required_metrics").otherwise("baseline_missing").alias("reason"),
            "unmeasured",
            F.lit(0).cast("bigint").alias("regressions"),
        )
    # sides meet once, a case a row; all counts are taken from these rows, so that no table of single metrics is shuffled
    pair = cut_lineage(base.select("case_id", F.struct(*METRICS).alias("_b")).join(
        cur.select("case_id", "category", F.struct(*METRICS).alias("_c")), "case_id", "full_outer"
    ))
    gaps = count_gaps(pair.where("_c is not null").select("case_id", "category", "_c.*"))
    sets = pair.agg(
        F.count_if(F.col("_b").isNull()).alias("_added"), F.count_if(F.col("_c").isNull()).alias("_removed")
    )
    if timing is None:
        values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_b.{m}").alias("baseline"), F.col(f"_c.{m}").alias("current")) for m in METRICS]))
        rows = pair.where("_b is not null and _c is not null").select("case_id", "category", values.alias("m")).select("case_id", "category", "m.*")
        deltas = classified(rows, ["case_id", "category"], RELEASE_TOLERANCES)
    else:
        b_long, c_long = to_long(base, ["case_id", "category"]), to_long(cur, ["case_id", "category"])
        b_long = same_run_baseline(b_long, to_long(timing, ["case_id", "category"]))
        timing_ok = b_long.where("metric = 'render_ms'").agg((F.count_if(F.col("value").isNull()) == 0).alias("_timing_ok"))
        deltas = metric_delta(b_long, c_long.drop("category"), ["case_id"], RELEASE_TOLERANCES).join(cur.select("case_id", "category"), "case_id")
    deltas = deltas.where(~alpha_not_applicable())
    raw = deltas.agg(F.count_if(F.col("status") == "regression").alias("_raw"))
    verdict = gaps.join(F.broadcast(sets), F.lit(True)).join(F.broadcast(raw), F.lit(True))
    if timing is None:
        norm = normalize_common_timing(deltas)
        again = (
            deltas.where("metric = 'render_ms'")
            .join(F.broadcast(norm.select("applied", "factor")), F.lit(True))
            .withColumn("current", F.col("current") / F.col("factor"))
            .withColumn("status", metric_status(RELEASE_TOLERANCES))
            .agg(F.coalesce(F.bool_or("applied"), F.lit(False)).alias("_norm"),
                 F.count_if(F.col("status") == "regression").alias("_after"))
        )
        verdict = verdict.join(F.broadcast(again), F.lit(True)).withColumn("_timing_ok", F.lit(True))
    else:
        verdict = verdict.join(F.broadcast(timing_ok), F.lit(True)).withColumn("_norm", F.lit(False)).withColumn("_after", F.lit(0))
    left = F.when(F.col("_norm"), F.col("_after")).otherwise(F.col("_raw"))
    reason = (
        F.when(F.col("unmeasured") > 0, "unmeasured_required_metrics")
        .when((F.col("_added") > 0) & (F.col("_removed") == 0), "case_set_expanded")
        .when(F.col("_added") + F.col("_removed") > 0, "case_set_mismatch")
        .when(~F.col("_timing_ok"), "invalid_same_runner_timing_baseline")
        .when(left > 0, "metric_regression")
        .otherwise("within_tolerance")
    )
    status = (
        F.when(reason == "case_set_expanded", "bootstrap").when(reason == "within_tolerance", "pass").otherwise("fail")
    )
    return verdict.select(status.alias("status"), reason.alias("reason"), "unmeasured", left.alias("regressions"))


def worst_cases(results: DataFrame, k: int = 3) -> DataFrame:
    """The k worst cases per metric; alpha only where it applies."""
    long = to_long(results, ["case_id", "category"]).where(~alpha_not_applicable() & F.col("value").isNotNull())
    badness = F.when(F.col("metric").isin(HIGHER), F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy("metric").orderBy(badness, "case_id")
    # rank <= k is pushed below the shuffle as a per-task limit
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("metric", "rank", "case_id", "value")


def alerts(results: DataFrame) -> DataFrame:
    long = to_long(results, ["case_id", "category"], [m for m, _, _ in ALERT_RULES]).where(~alpha_not_applicable())
    hit = F.lit(False)
    for metric, op, limit in ALERT_RULES:
        out_of_range = F.col("value") < limit if op == "<" else F.col("value") > limit
        hit = hit | ((F.col("metric") == metric) & out_of_range)
    return long.where(hit).select("case_id", "metric", "value")


def metric_summary(long: DataFrame) -> DataFrame:
    """measured count, min, median, p95, max per metric."""
    measured = long.where(finite("value"))
    basic = long.groupBy("metric").agg(
        F.count_if(finite("value")).alias("measured_count"),
        F.min(F.when(finite("value"), F.col("value"))).alias("min_value"),
        F.max(F.when(finite("value"), F.col("value"))).alias("max_value"),
    )
    return basic.join(exact_percentiles(measured, ["metric"], "value", {"median": 0.5, "p95": 0.95}), "metric", "left")


def case_violations(results: DataFrame, thresholds: dict[str, float] = QUALITY_THRESHOLDS) -> DataFrame:
    """Per case: sorted missing and below-threshold metrics (both may be empty)."""
    names = sorted(thresholds)
    return results.select(
        "case_id",
        F.when(finite("fidelity"), F.col("fidelity")).alias("fidelity"),
        codes(*[(m, ~finite(m)) for m in names]).alias("missing"),
        codes(*[(m, finite(m) & (F.col(m) < thresholds[m])) for m in names]).alias("violations"),
    )


def quality_decision(results: DataFrame, thresholds: dict[str, float] = QUALITY_THRESHOLDS, worst: int = 5) -> DataFrame:
    """One row: violation counts, reasons, worst cases and go / no_go."""
    cases = case_violations(results, thresholds)
    hits = lambda m: F.count_if(F.array_contains("violations", m))
    totals = cases.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if((F.size("missing") > 0) | (F.size("violations") > 0)).alias("violation_case_count"),
        F.count_if(F.size("missing") > 0).alias("missing_case_count"),
        *[hits(m).alias(f"{m}_violations") for m in thresholds],
    )
    low = cases.orderBy(F.col("fidelity").asc_nulls_last(), "case_id").limit(worst)
    low = low.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("fidelity").isNull().alias("n"), "fidelity", "case_id"))),
                lambda s: s["case_id"].cast("string"),
            ),
            ",",
        ).alias("worst_case_ids")
    )
    parts = sum((F.col(f"{m}_violations") for m in thresholds if m != "fidelity"), F.lit(0))
    return totals.join(F.broadcast(low), F.lit(True), "left").select(
        "case_count", "violation_case_count", "missing_case_count",
        *[f"{m}_violations" for m in thresholds],
        "worst_case_ids",
        F.when(F.col("violation_case_count") > 0, "no_go").otherwise("go").alias("release_decision"),
        F.array_join(
            codes(
                ("fidelity_threshold_not_met", F.col("fidelity_violations") > 0),
                ("component_threshold_not_met", parts > 0),
                ("missing_required_component_metrics", F.col("missing_case_count") > 0),
            ),
            ",",
        ).alias("reasons"),
    )


def retry_audit(expected_cases: DataFrame, samples: DataFrame, repeats: int = 3, budget: int = 2) -> DataFrame:
    """(case_id, repeat_index, code) for every broken retry contract."""
    grid = expected_cases.select("case_id").distinct().select(
        "case_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat_index")
    )
    keys = ["case_id", "repeat_index"]
    known = grid.withColumn("_known", F.lit(True))
    counted = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = samples.join(counted, keys).join(known, keys, "left")
    rows = joined.select(
        *keys,
        F.explode(
            codes(
                ("unexpected_identity", F.col("_known").isNull()),
                ("duplicate_identity", F.col("_n") > 1),
                ("attempt_budget_exceeded", ~F.coalesce(F.col("attempt_count").between(1, budget), F.lit(False))),
                ("retry_flag_mismatch", ~F.coalesce(F.col("retried") == (F.col("attempt_count") == 2), F.lit(False))),
                ("incomplete_sample", ~F.coalesce(F.col("status") == "success", F.lit(False))),
                ("non_allowlisted_retry_class", F.col("retry_class").isNotNull() & ~F.col("retry_class").isin(RETRY_CLASSES)),
            )
        ).alias("code"),
    )
    lost = grid.join(samples.select(*keys), keys, "left_anti").withColumn("code", F.lit("missing_identity"))
    return rows.unionByName(lost).distinct()


def metric_coverage(results: DataFrame) -> DataFrame:
    """Cases with missing component metrics and the signature they match."""
    missing = codes(*[(m, F.col(m).isNull()) for m in COVERAGE_METRICS])
    partial = F.array_join("missing", ",").isin("edge_f1,ssim", "delta_e00,edge_f1,ssim")
    return (
        results.select("case_id", "alpha_iou", missing.alias("missing"))
        .where(F.size("missing") > 0)
        .select(
            "case_id",
            F.array_join("missing", ",").alias("missing_metrics"),
            F.when(partial & F.col("alpha_iou").isNotNull(), "partial_quality_report_fallback")
            .otherwise("unclassified_required_metric_gap").alias("diagnosis"),
        )
    )


def verify_clusters(results: DataFrame, members: DataFrame, failed_metrics: DataFrame) -> DataFrame:
    """Violations of a remediation plan given in long form.

    ``members(cluster_id, role, case_id)`` with role evidence / verification /
    regression, ``failed_metrics(cluster_id, metric)`` as claimed by the plan.
    """
    names = sorted(QUALITY_THRESHOLDS)
    bad = codes(*[(m, ~F.coalesce(finite(m) & (F.col(m) >= QUALITY_THRESHOLDS[m]), F.lit(False))) for m in names])
    cases = results.select("case_id", bad.alias("_bad"))
    evidence = members.where("role = 'evidence'").select("cluster_id", "case_id")
    seen = evidence.join(cases, "case_id", "left")
    text = F.col("case_id").cast("string")

    def rows(df: DataFrame, code: str, subject: Column = text) -> DataFrame:
        return df.select(F.col("cluster_id").cast("string").alias("cluster_id"), F.lit(code).alias("code"), subject.alias("subject"))

    measured = seen.select("cluster_id", F.explode("_bad").alias("metric")).distinct()
    claimed = failed_metrics.select("cluster_id", "metric").distinct()
    metric = F.col("metric")
    twice = evidence.distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("cluster_id").alias("cluster_id")).where("n > 1")
    regression = members.where("role = 'regression'").select("cluster_id", "case_id")
    clusters = members.select("cluster_id").distinct()
    failing = cases.where(F.size("_bad") > 0)
    out = [
        rows(seen.where(F.col("_bad").isNull()), "unknown_case"),
        rows(seen.where(F.size("_bad") == 0), "passing_case_listed"),
        rows(twice, "case_in_two_clusters"),
        rows(measured.exceptAll(claimed), "failed_metric_not_claimed", metric),
        rows(claimed.exceptAll(measured), "claimed_metric_not_failing", metric),
        rows(members.where("role = 'verification'").join(evidence, ["cluster_id", "case_id"], "left_anti"), "verification_outside_evidence"),
        rows(regression.intersect(evidence), "regression_overlaps_evidence"),
        rows(regression.join(cases, "case_id", "left_anti"), "unknown_regression_case"),
        rows(clusters.join(regression, "cluster_id", "left_anti"), "missing_regression_sentinels", F.lit(None).cast("string")),
        rows(failing.join(evidence, "case_id", "left_anti").withColumn("cluster_id", F.lit(None).cast("string")), "unclustered_failing_case"),
    ]
    res = out[0]
    for part in out[1:]:
        res = res.unionByName(part)
    return res


def determinism_failures(samples: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Cases whose repeats disagree on any signature field (nulls count as values)."""
    sig = F.sha2(F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}), 256)
    g = samples.groupBy(*keys).agg(F.min(sig).alias("_lo"), F.max(sig).alias("_hi"))
    return g.where("_lo <> _hi").select(*keys)


def mode_release(samples: DataFrame, unit: list[str], repeats: int = 3) -> DataFrame:
    """Per release unit: pass / fail, release status and reason codes.

    Samples carry mode, repeat_index, status, verdict, artifact_sha256,
    evaluator_sha256, path_count and the five artefact measures.
    """
    is_photo = F.col("mode") == "photo_poster"
    done = F.col("status") == "completed"
    measured = F.lit(True)
    for m in ["ink_recall", "ink_precision", "component_delta", "seam_ratio", "halo_ratio"]:
        measured = measured & finite(m)
    metric_ok = done & ~is_photo & measured
    rules = [
        ("artifact_digest_missing", done & (F.length(F.coalesce("artifact_sha256", F.lit(""))) != 64)),
        ("evaluator_digest_mismatch", done & ~F.col("artifact_sha256").eqNullSafe(F.col("evaluator_sha256"))),
        ("empty_vector_document", done & (F.coalesce(F.col("path_count"), F.lit(0)) <= 0)),
        ("invalid_completed_verdict", done & ~F.coalesce(F.col("verdict").isin("production_ready", "needs_review"), F.lit(False))),
        ("false_production_ready", done & is_photo & ~F.col("verdict").eqNullSafe(F.lit("needs_review"))),
        *[(f"{m}_unmeasured", done & ~is_photo & ~finite(m)) for m in ["ink_recall", "ink_precision", "component_delta", "seam_ratio", "halo_ratio"]],
        ("ink_recall_below_min", metric_ok & (F.col("ink_recall") < ARTIFACT_LIMITS["ink_recall"])),
        ("ink_precision_below_min", metric_ok & (F.col("ink_precision") < ARTIFACT_LIMITS["ink_precision"])),
        ("component_delta_nonzero", metric_ok & (F.col("component_delta") != 0)),
        ("seam_ratio_above_max", metric_ok & (F.col("seam_ratio") > ARTIFACT_LIMITS["seam_ratio"])),
        ("halo_ratio_above_max", metric_ok & (F.col("halo_ratio") > ARTIFACT_LIMITS["halo_ratio"])),
        ("invalid_sample_status", ~F.coalesce(F.col("status").isin("completed", "unavailable", "failed"), F.lit(False))),
        ("sample_failed", F.col("status") == "failed"),
    ]
    g = samples.groupBy(*unit, "mode").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("repeat_index").alias("_first"), F.max("repeat_index").alias("_last"),
        F.count_if(F.col("repeat_index").isNull()).alias("_noidx"),
        F.count_distinct("repeat_index").alias("_indices"),
        F.count_if(done).alias("_done"), F.count_if(F.col("status") == "unavailable").alias("_gone"),
        F.min(F.coalesce("artifact_sha256", F.lit(""))).alias("_lo"), F.max(F.coalesce("artifact_sha256", F.lit(""))).alias("_hi"),
        F.count_if(F.col("verdict") == "production_ready").alias("_ready"),
        *[F.coalesce(F.bool_or(cond), F.lit(False)).alias(f"_c_{code}") for code, cond in rules],
    )
    all_done, all_gone = F.col("_done") == F.col("_n"), F.col("_gone") == F.col("_n")
    reasons = codes(
        ("repeat_sample_count_mismatch", F.col("_n") != repeats),
        ("repeat_indices_invalid", (F.col("_noidx") > 0) | (F.col("_first") != 1) | (F.col("_last") != repeats) | (F.col("_indices") != repeats)),
        *[(code, F.col(f"_c_{code}") & (all_done if cond_needs_done else F.lit(True)))
          for code, cond_needs_done in [(c, c not in ("invalid_sample_status", "sample_failed")) for c, _ in rules]],
        ("non_deterministic_artifact_digest", all_done & (F.col("_lo") != F.col("_hi"))),
        ("mixed_repeat_status", ~all_done & ~all_gone),
    )
    return g.select(
        *unit, "mode",
        F.when(F.size(reasons) > 0, "fail").otherwise("pass").alias("status"),
        F.when(all_gone, "unavailable").when(~all_done, "failed").when(is_photo, "needs_review")
        .when(F.col("_ready") == F.col("_n"), "production_ready").otherwise("needs_review").alias("release_status"),
        F.array_join(reasons, ",").alias("reason_codes"),
    )


def fidelity_gate(evidence: DataFrame, error_limit: float = 0.020, discrete_kinds: list[str] | None = None) -> DataFrame:
    """Per kind: mean score >= .99, p05 >= .98, p95 error <= limit, no defects, unique ids.

    ``discrete_kinds`` use nearest-rank percentiles; the kind ``geometric``
    uses the minimum score and a maximum error of .005 instead.
    """
    discrete_kinds = discrete_kinds or ["edge"]
    basic = evidence.groupBy("kind").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg("score").alias("mean_score"), F.min("score").alias("_min"), F.max("error").alias("_max"),
        F.sum("defects").alias("defects"),
        F.count_if(~F.coalesce(finite("score") & F.col("score").between(0, 1) & finite("error") & (F.col("error") >= 0), F.lit(False))).alias("_bad"),
    )
    repeated = evidence.groupBy("kind", "case_id").count().groupBy("kind").agg(F.count_if(F.col("count") > 1).alias("duplicate_ids"))
    parts = []
    for discrete in (False, True):
        picked = evidence.where(F.col("kind").isin(discrete_kinds) == F.lit(discrete))
        s = exact_percentiles(picked, ["kind"], "score", {"p05": 0.05}, discrete)
        e = exact_percentiles(picked, ["kind"], "error", {"p95_error": 0.95}, discrete)
        parts.append(s.join(e, "kind"))
    out = basic.join(repeated, "kind").join(parts[0].unionByName(parts[1]), "kind", "left")
    geo = F.col("kind") == "geometric"
    low = F.when(geo, F.col("_min")).otherwise(F.col("p05"))
    high = F.when(geo, F.col("_max")).otherwise(F.col("p95_error"))
    reasons = codes(
        ("invalid_evidence", F.col("_bad") > 0),
        ("duplicate_case_id", F.col("duplicate_ids") > 0),
        ("mean_score", F.col("mean_score") < 0.990),
        ("low_score", low < 0.980),
        ("high_error", high > F.when(geo, F.lit(0.005)).otherwise(F.lit(error_limit))),
        ("defects", F.col("defects") > 0),
    )
    return out.select(
        "kind", "cases", "mean_score", low.alias("low_score"), high.alias("high_error"), "defects",
        F.when(F.size(reasons) > 0, "fail").otherwise("pass").alias("status"),
        F.array_join(reasons, ",").alias("reasons"),
    )


def refiner_gate(evidence: DataFrame, max_edits: int = 64) -> DataFrame:
    """(subject, code) violations of refinement evidence; empty when qualified.

    Columns: case_id, input/model/output_sha256, pre/post_fidelity, edit_count,
    edit_classes, defects.
    """
    unit = lambda c: F.coalesce(finite(c) & F.col(c).between(0, 1), F.lit(False))
    rows = evidence.select(
        F.col("case_id").cast("string").alias("subject"),
        F.explode(
            codes(
                ("invalid_digest", ~(is_digest("input_sha256") & is_digest("model_sha256") & is_digest("output_sha256"))),
                ("out_of_range_fidelity", ~(unit("pre_fidelity") & unit("post_fidelity"))),
                ("fidelity_regression", F.col("post_fidelity") < F.col("pre_fidelity")),
                ("unbounded_edit_count", ~F.coalesce(F.col("edit_count").between(0, max_edits), F.lit(False))),
                ("unexpected_edit_class", F.size(F.array_except("edit_classes", F.array(*map(F.lit, EDIT_CLASSES)))) > 0),
                ("refiner_defect", F.col("defects") > 0),
            )
        ).alias("code"),
    )
    drift = (
        evidence.groupBy("input_sha256", "model_sha256")
        .agg(F.min("output_sha256").alias("lo"), F.max("output_sha256").alias("hi"))
        .where("lo <> hi")
        .select(F.col("input_sha256").alias("subject"), F.lit("nondeterministic_output_digest").alias("code"))
    )
    twice = evidence.groupBy("case_id").count().where("count > 1").select(
        F.col("case_id").cast("string").alias("subject"), F.lit("duplicate_case_id").alias("code")
    )
    gain = evidence.agg(F.avg(F.col("post_fidelity") - F.col("pre_fidelity")).alias("g")).where("g < 0").select(
        F.lit("*").alias("subject"), F.lit("negative_mean_gain").alias("code")
    )
    p05 = exact_percentiles(evidence, [], "post_fidelity", {"p05": 0.05}).where("p05 < 0.99e0").select(
        F.lit("*").alias("subject"), F.lit("p05_post_fidelity").alias("code")
    )
    return rows.unionByName(drift).unionByName(twice).unionByName(gain).unionByName(p05)


def print_ready_gate(formats: DataFrame, defects: DataFrame) -> DataFrame:
    """(case_id, code): exact format set, valid items, consistency >= .99, no defects.

    ``formats(case_id, format, artifact_sha256, parsed, structure_valid,
    metadata_consistency)`` and ``defects(case_id, defects)``.
    """
    score = "metadata_consistency"
    per_case = formats.groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_set("format")), ",").alias("_set"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~is_digest("artifact_sha256")).alias("_dig"),
        F.count_if(~F.coalesce(F.col("parsed"), F.lit(False))).alias("_parse"),
        F.count_if(~F.coalesce(F.col("structure_valid"), F.lit(False))).alias("_struct"),
        F.count_if(~F.coalesce(finite(score) & F.col(score).between(0, 1), F.lit(False))).alias("_range"),
    )
    rows = defects.join(per_case, "case_id", "left").select(
        F.col("case_id").cast("string").alias("case_id"),
        F.explode(
            codes(
                ("invalid_formats", F.coalesce((F.col("_set") != ",".join(sorted(PRINT_FORMATS))) | (F.col("_n") != len(PRINT_FORMATS)), F.lit(True))),
                ("invalid_artifact_digest", F.col("_dig") > 0),
                ("failed_parsed", F.col("_parse") > 0),
                ("failed_structure_valid", F.col("_struct") > 0),
                ("invalid_metadata_consistency", F.col("_range") > 0),
                ("print_ready_defect", F.col("defects") > 0),
            )
        ).alias("code"),
    )
    mean = formats.agg(F.avg(score).alias("m")).where("m < 0.99e0").select(
        F.lit("*").alias("case_id"), F.lit("metadata_consistency_regression").alias("code")
    )
    return rows.unionByName(mean)


def final_gate(records: DataFrame, overall: float = 0.990, component: float = 0.980) -> DataFrame:
    """(case_id, code) over five component columns, overall_fidelity and published."""
    unit = lambda c: F.coalesce(finite(c) & F.col(c).between(0, 1), F.lit(False))
    bad_range, low = F.lit(False), F.lit(False)
    for name in FINAL_COMPONENTS:
        bad_range, low = bad_range | ~unit(name), low | (F.col(name) < component)
    rows = records.select(
        F.col("case_id").cast("string").alias("case_id"),
        F.explode(
            codes(
                ("component_out_of_range", bad_range),
                ("component_fidelity_regression", low),
                ("overall_out_of_range", ~unit("overall_fidelity")),
                ("rejected_artifact_published", (F.col("overall_fidelity") < overall) & F.col("published")),
                ("overall_fidelity_regression", (F.col("overall_fidelity") < overall) & ~F.col("published")),
                ("qualified_artifact_not_published", (F.col("overall_fidelity") >= overall) & ~F.col("published")),
            )
        ).alias("code"),
    )
    mean = records.agg(F.avg("overall_fidelity").alias("m")).where(F.col("m") < overall).select(
        F.lit("*").alias("case_id"), F.lit("mean_overall_fidelity_regression").alias("code")
    )
    return rows.unionByName(mean)


def fixture_acceptance(results: DataFrame, expectations: DataFrame, key: str) -> DataFrame:
    """Failed expectations: (key, case_id, metric, value) outside [min_value, max_value].

    ``expectations(key, metric, min_value, max_value)`` is a policy table, of any
    size; unmeasured values fail.
    """
    return (
        results.join(expectations, [key, "metric"])
        .where(
            F.col("value").isNull()
            | (F.col("value") < F.col("min_value"))
            | (F.col("value") > F.col("max_value"))
        )
        .select(key, "case_id", "metric", "value")
    )


def provenance_agreement(samples: DataFrame, keys: list[str], provenance: str) -> DataFrame:
    """Cases whose repeats disagree on the non-volatile provenance entries."""
    stable = F.map_filter(provenance, lambda k, v: ~k.isin(VOLATILE_PROVENANCE))
    text = F.to_json(F.array_sort(F.map_entries(stable)), {"ignoreNullFields": "false"})
    g = samples.groupBy(*keys).agg(
        F.min(text).alias("_lo"), F.max(text).alias("_hi"),
        F.count_if(F.col(provenance).isNull()).alias("_none"), F.count(F.lit(1)).alias("_n"),
    )
    problem = F.when((F.col("_none") > 0) & (F.col("_none") < F.col("_n")), "mixed_provenance_coverage").when(
        F.col("_lo") != F.col("_hi"), "non_deterministic_provenance"
    )
    return g.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


DIGEST_PARTS = 256


def _part_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the entries of each part, joined by commas; entries come sorted, a batch at a time."""
    part, digest, rows = None, None, 0
    for pdf in batches:
        for p, group in pdf.groupby("p", sort=True):
            if p != part and digest is not None:
                yield pd.DataFrame({"p": [part], "g": [digest.hexdigest()], "n": [rows]})
            text = ",".join(group["h"])
            if p != part:
                part, digest, rows = p, hashlib.sha256(), 0
            else:
                text = "," + text
            digest.update(text.encode())
            rows += int(group["n"].sum())
    if digest is not None:
        yield pd.DataFrame({"p": [part], "g": [digest.hexdigest()], "n": [rows]})


def canonical_digest(df: DataFrame, fields: list[str]) -> DataFrame:
    """Order-independent digest of a row set, repeated rows included, as one row (row_count, digest).

    Rows hash to 64 hex digits, equal ones are counted; each of 256 parts by the first digits hashes its
    sorted entries, and the result hashes the 256 part digests. A part is sorted by Spark and hashed as a stream, so a task holds one batch of it.
    """
    row = df.select(F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256).alias("h"))
    entries = row.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(
        F.pmod(F.conv(F.substring("h", 1, 6), 16, 10).cast("int"), F.lit(DIGEST_PARTS)).alias("p"), F.concat_ws("x", "h", F.col("n").cast("string")).alias("h"), "n"
    )
    parts = entries.repartition("p").sortWithinPartitions("p", "h").mapInPandas(_part_digests, "p int, g string, n long")
    listed = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("p").cast("string"), 9, "0"), "g")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def fallback_evidence(results: DataFrame, samples: DataFrame, gaps: list[str], repeats: int = 3) -> DataFrame:
    """Cases missing every metric of ``gaps`` with their sorted repeat audit.

    Groups without exact cover of repeats 1..n are flagged, not dropped; only
    the n expected repeats are gathered, so a case's list is bounded.
    """
    missing = F.lit(True)
    for m in gaps:
        missing = missing & F.col(m).isNull()
    cases = results.where(missing).select("case_id")
    audit = samples.join(cases, "case_id", "left_semi")
    # one row per (case, repeat index) first, so repeated indices are counted, not gathered
    per_index = audit.groupBy("case_id", "repeat_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("attempt_count").alias("attempt_count"), F.min("status").alias("status")
    )
    inside = F.col("repeat_index").between(1, repeats)
    g = per_index.groupBy("case_id").agg(
        F.count_if(inside & (F.col("n") == 1)).alias("_good"),
        F.count_if(~F.coalesce(inside & (F.col("n") == 1), F.lit(False))).alias("_bad"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("repeat_index", "attempt_count", "status")))).alias("_audit"),
    )
    covered = (F.col("_good") == repeats) & (F.col("_bad") == 0)
    return cases.join(g, "case_id", "left").select(
        "case_id",
        F.coalesce(covered, F.lit(False)).alias("repeat_cover"),
        F.array_join(F.transform("_audit", lambda s: F.concat_ws(":", s["repeat_index"].cast("string"), s["attempt_count"].cast("string"), s["status"])), "|").alias("repeat_audit"),
    )
