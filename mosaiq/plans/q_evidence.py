"""Queries over benchmark evidence, calibration and corpus records."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions.columns import rounded
from mosaiq.operators import calibration as cal, evidence as ev
from mosaiq.plans.registry import Tables, query

_METRIC_LIST = "fidelity, ssim, edge_f1, alpha_iou, delta_e00, path_count, svg_bytes, render_ms, peak_rss_mb"
_LONG = f"UNPIVOT INCLUDE NULLS {{}} ON {_METRIC_LIST} INTO NAME metric VALUE value"
_TOL = "CASE metric WHEN 'fidelity' THEN 0.002e0 WHEN 'ssim' THEN 0.002e0 WHEN 'edge_f1' THEN 0.003e0 WHEN 'alpha_iou' THEN 0.003e0 WHEN 'delta_e00' THEN 0.25e0 WHEN 'path_count' THEN 0.05e0 WHEN 'svg_bytes' THEN 0.05e0 ELSE 0.1e0 END"
_RTOL = _TOL.replace("WHEN 'svg_bytes'", "WHEN 'render_ms' THEN 0.25e0 WHEN 'svg_bytes'")
_UP = "metric IN ('fidelity','ssim','edge_f1','alpha_iou')"


def _deltas_cte(tol: str = _TOL, alpha_filter: bool = False) -> str:
    """CTEs l(side,case_id,category,metric,value) and d(case_id,category,metric,baseline,current,status)."""
    where = "WHERE NOT (metric='alpha_iou' AND category<>'transparent')" if alpha_filter else ""
    return f"""
l AS (SELECT side, case_id, category, metric, value FROM (SELECT * FROM bench_case) UNPIVOT INCLUDE NULLS (value FOR metric IN ({_METRIC_LIST}))),
p AS (SELECT case_id, category, metric, MAX(CASE WHEN side='base' THEN value END) AS baseline, MAX(CASE WHEN side='cur' THEN value END) AS current,
  COUNT(DISTINCT side) AS sides FROM l {where} GROUP BY case_id, category, metric),
d AS (SELECT case_id, category, metric, baseline, current, current-baseline AS delta,
  CASE WHEN baseline<>0 THEN (current-baseline)/ABS(baseline) END AS relative_delta,
  CASE WHEN baseline IS NULL OR current IS NULL THEN 'unmeasurable'
       WHEN {_UP} THEN CASE WHEN current-baseline < -({tol}) THEN 'regression' WHEN current-baseline > ({tol}) THEN 'improvement' ELSE 'stable' END
       ELSE CASE WHEN (CASE WHEN baseline<>0 THEN (current-baseline)/ABS(baseline) ELSE current-baseline END) > ({tol}) THEN 'regression'
                 WHEN (CASE WHEN baseline<>0 THEN (current-baseline)/ABS(baseline) ELSE current-baseline END) < -({tol}) THEN 'improvement' ELSE 'stable' END END AS status
  FROM p WHERE sides=2)"""


def _side(t: Tables, side: str):
    return t("bench_case").where(F.col("side") == side).drop("side")


def _deltas(t: Tables, tolerances=ev.TOLERANCES):
    base = ev.to_long(_side(t, "base"), ["case_id", "category"])
    cur = ev.to_long(_side(t, "cur"), ["case_id", "category"])
    return ev.metric_delta(base, cur, ["case_id", "category"], tolerances)


_CASES_SQL = """SELECT SUBSTRING(source_sha256,1,8) AS case_id, CASE category WHEN 'en' THEN 'logos' WHEN 'de' THEN 'seals' WHEN 'fr' THEN 'technical' ELSE 'posters' END AS category,
  CASE WHEN case_id%29=0 THEN '../up.png' WHEN case_id%31=0 THEN '' ELSE CONCAT('in/', source_format) END AS source_path,
  CASE WHEN license='unknown' THEN '' ELSE license END AS license_id,
  CASE WHEN case_id%37=0 THEN SUBSTRING(source_sha256,1,60) ELSE source_sha256 END AS source_sha256 FROM case_rec"""


@query("validate_manifest", f"""
WITH c AS ({_CASES_SQL}), n AS (SELECT case_id, COUNT(*) AS k FROM c GROUP BY case_id)
SELECT c.case_id, code FROM c JOIN n USING (case_id) CROSS JOIN (SELECT unnest(['unsupported_category','source_path_required','license_id_required','invalid_source_sha256','duplicate_case_id','source_path_escapes_root']) AS code) q
WHERE (code='unsupported_category' AND category='posters') OR (code='source_path_required' AND source_path='') OR (code='license_id_required' AND license_id='')
  OR (code='invalid_source_sha256' AND length(source_sha256)<>64) OR (code='duplicate_case_id' AND k>1) OR (code='source_path_escapes_root' AND source_path LIKE '../%')""")
def _(t: Tables):
    t("case_rec").createOrReplaceTempView("case_rec")
    return ev.validate_manifest(t.spark.sql(_CASES_SQL))


@query("diff_manifests", """
WITH b AS (SELECT case_id, source_sha FROM manifest WHERE side='base'), c AS (SELECT case_id, source_sha FROM manifest WHERE side='cur')
SELECT COALESCE(b.case_id, c.case_id) AS case_id,
  CASE WHEN b.case_id IS NULL THEN 'added' WHEN c.case_id IS NULL THEN 'removed' WHEN b.source_sha IS DISTINCT FROM c.source_sha THEN 'changed' ELSE 'stable' END AS change
FROM b FULL OUTER JOIN c ON b.case_id=c.case_id""")
def _(t: Tables):
    m = t("manifest")
    return ev.diff_manifests(m.where("side='base'"), m.where("side='cur'"))


@query("manifest_status", """
WITH b AS (SELECT case_id, source_sha FROM manifest WHERE side='base'), c AS (SELECT case_id, source_sha FROM manifest WHERE side='cur'),
d AS (SELECT b.case_id AS bi, c.case_id AS ci, b.source_sha AS bs, c.source_sha AS cs FROM b FULL OUTER JOIN c ON b.case_id=c.case_id)
SELECT CASE WHEN COUNT(*) FILTER (bi IS NULL OR ci IS NULL OR bs<>cs)>0 THEN 'changed' ELSE 'stable' END AS status,
  COUNT(ci) AS case_count, COUNT(*) FILTER (bi IS NULL) AS added, COUNT(*) FILTER (ci IS NULL) AS removed, COUNT(*) FILTER (bs<>cs) AS changed FROM d""")
def _(t: Tables):
    m = t("manifest")
    return ev.manifest_status(ev.diff_manifests(m.where("side='base'"), m.where("side='cur'")))


@query("aggregate_repeats", """
WITH g AS (SELECT side, case_id, COUNT(*) AS repeats, COUNT(DISTINCT artifact_sha256) AS shas, MIN(artifact_sha256) AS sha,
  MIN(fidelity) AS fidelity, MIN(ssim) AS ssim, MIN(edge_f1) AS edge_f1, MIN(alpha_iou) AS alpha_iou, MAX(delta_e00) AS delta_e00, MAX(path_count) AS path_count,
  MAX(svg_bytes) AS svg_bytes, median(render_ms) AS render_ms, median(peak_rss_mb) AS peak_rss_mb FROM bench GROUP BY side, case_id)
SELECT side, case_id, repeats, CASE WHEN shas<>1 THEN 'non_deterministic_artifact' END AS error, CASE WHEN shas=1 THEN sha END AS artifact_sha256,
  round(CASE WHEN shas=1 THEN fidelity END,6) AS fidelity, round(CASE WHEN shas=1 THEN ssim END,6) AS ssim, round(CASE WHEN shas=1 THEN edge_f1 END,6) AS edge_f1,
  round(CASE WHEN shas=1 THEN alpha_iou END,6) AS alpha_iou, round(CASE WHEN shas=1 THEN delta_e00 END,6) AS delta_e00, round(CASE WHEN shas=1 THEN path_count END,6) AS path_count,
  round(CASE WHEN shas=1 THEN svg_bytes END,6) AS svg_bytes, round(CASE WHEN shas=1 THEN render_ms END,6) AS render_ms, round(CASE WHEN shas=1 THEN peak_rss_mb END,6) AS peak_rss_mb FROM g""")
def _(t: Tables):
    return rounded(ev.aggregate_repeats(t("bench"), ["side", "case_id"]))


@query("metric_delta", f"WITH {_deltas_cte()} SELECT case_id, category, metric, round(baseline,6) AS baseline, round(current,6) AS current, round(delta,6) AS delta, round(relative_delta,6) AS relative_delta, status FROM d")
def _(t: Tables):
    return rounded(_deltas(t))


@query("delta_report", f"""WITH {_deltas_cte(alpha_filter=True)}, c AS (SELECT category, case_id, COUNT(*) FILTER (status='regression') AS r FROM d GROUP BY category, case_id)
SELECT category, COUNT(*) AS case_count, COUNT(*) FILTER (r>0) AS regression_count, CASE WHEN COUNT(*) FILTER (r>0)>0 THEN 'fail' ELSE 'pass' END AS status FROM c GROUP BY ROLLUP(category)""")
def _(t: Tables):
    return ev.delta_report(_deltas(t))


@query("unmeasured", f"""WITH l AS (SELECT case_id, category, metric, value FROM (SELECT * FROM bench_case WHERE side='cur') UNPIVOT INCLUDE NULLS (value FOR metric IN ({_METRIC_LIST})))
SELECT DISTINCT case_id, metric FROM l WHERE value IS NULL AND (metric<>'alpha_iou' OR category='transparent')""")
def _(t: Tables):
    return ev.unmeasured(_side(t, "cur"))


@query("normalize_common_timing", f"""WITH {_deltas_cte(_RTOL, True)}, f AS (SELECT median(current/baseline) AS factor, COUNT(*) AS case_count, COUNT(*) FILTER (current/baseline>1.1e0) AS slow_case_count,
  COUNT(*) FILTER (baseline<=0 OR current<=0) AS bad FROM d WHERE metric='render_ms'),
o AS (SELECT COUNT(*) FILTER (status='regression') AS reg, COUNT(*) FILTER (status='regression' AND metric<>'render_ms') AS other FROM d)
SELECT (reg>0 AND other=0 AND bad=0 AND case_count>=6 AND slow_case_count/case_count>=0.75e0 AND factor>1.1e0 AND factor<=1.5e0) AS applied, round(factor,6) AS factor, case_count, slow_case_count FROM f CROSS JOIN o""")
def _(t: Tables):
    d = _deltas(t, ev.RELEASE_TOLERANCES).where(~ev.alpha_not_applicable())
    return rounded(ev.normalize_common_timing(d))


@query("normalize_common_timing_slow_run", """
WITH b AS (SELECT case_id, MAX(render_ms) AS baseline FROM bench_case WHERE side='base' GROUP BY case_id), r AS (SELECT baseline*(1.2e0+(case_id%10)/100e0)/baseline AS ratio FROM b)
SELECT TRUE AS applied, round(median(ratio),6) AS factor, COUNT(*) AS case_count, COUNT(*) FILTER (ratio>1.1e0) AS slow_case_count FROM r""")
def _(t: Tables):
    base = ev.to_long(_side(t, "base"), ["case_id", "category"])
    slow = F.when(F.col("metric") == "render_ms", F.col("value") * (1.2 + F.expr("case_id % 10") / 100)).otherwise(F.col("value"))
    d = ev.metric_delta(base, base.withColumn("value", slow), ["case_id", "category"], ev.RELEASE_TOLERANCES)
    return rounded(ev.normalize_common_timing(d))


@query("same_run_baseline", f"""WITH l AS (SELECT side, case_id, category, metric, value FROM (SELECT * FROM bench_case) UNPIVOT INCLUDE NULLS (value FOR metric IN ({_METRIC_LIST})))
SELECT b.case_id, b.category, b.metric, round(CASE WHEN b.metric='render_ms' THEN CASE WHEN c.value>0 THEN c.value END ELSE b.value END,6) AS value
FROM l b LEFT JOIN l c ON c.side='cur' AND c.case_id=b.case_id AND c.metric=b.metric WHERE b.side='base'""")
def _(t: Tables):
    base = ev.to_long(_side(t, "base"), ["case_id", "category"])
    return rounded(ev.same_run_baseline(base, ev.to_long(_side(t, "cur"), ["case_id", "category"])))


@query("release_gate", f"""WITH {_deltas_cte(_RTOL, True)}, u AS (SELECT COUNT(*) AS unmeasured FROM l WHERE side='cur' AND value IS NULL AND NOT (metric='alpha_iou' AND category<>'transparent')),
g AS (SELECT COUNT(*) FILTER (status='regression') AS regressions FROM d)
SELECT CASE WHEN unmeasured>0 OR regressions>0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN unmeasured>0 THEN 'unmeasured_required_metrics' WHEN regressions>0 THEN 'metric_regression' ELSE 'within_tolerance' END AS reason,
  unmeasured, regressions FROM u CROSS JOIN g""")
def _(t: Tables):
    return ev.release_gate(_side(t, "base"), _side(t, "cur"))


@query("worst_cases", f"""WITH l AS (SELECT case_id, category, metric, value FROM (SELECT * FROM bench_case WHERE side='cur') UNPIVOT (value FOR metric IN ({_METRIC_LIST}))),
r AS (SELECT metric, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY CASE WHEN {_UP} THEN value ELSE -value END, case_id) AS rank, case_id, value FROM l WHERE metric<>'alpha_iou' OR category='transparent')
SELECT metric, rank, case_id, round(value,6) AS value FROM r WHERE rank<=3""")
def _(t: Tables):
    return rounded(ev.worst_cases(_side(t, "cur")))


@query("alerts", """
SELECT case_id, 'alpha_iou' AS metric, round(alpha_iou,6) AS value FROM bench_case WHERE side='cur' AND category='transparent' AND alpha_iou<0.95e0
UNION ALL SELECT case_id, 'ssim', round(ssim,6) FROM bench_case WHERE side='cur' AND ssim<0.97e0
UNION ALL SELECT case_id, 'render_ms', round(render_ms,6) FROM bench_case WHERE side='cur' AND render_ms>15000""")
def _(t: Tables):
    return rounded(ev.alerts(_side(t, "cur")))


@query("metric_summary", f"""WITH l AS (SELECT metric, value FROM (SELECT * FROM bench WHERE side='cur') UNPIVOT INCLUDE NULLS (value FOR metric IN ({_METRIC_LIST})))
SELECT metric, COUNT(value) AS measured_count, round(MIN(value),6) AS min_value, round(MAX(value),6) AS max_value, round(median(value),6) AS median, round(quantile_cont(value,0.95),6) AS p95 FROM l GROUP BY metric""")
def _(t: Tables):
    cur = t("bench").where("side = 'cur'")
    return rounded(ev.metric_summary(ev.to_long(cur, ["case_id"])))


@query("quality_decision", """
WITH v AS (SELECT case_id, fidelity, (CASE WHEN alpha_iou IS NULL THEN 1 ELSE 0 END) AS miss, CASE WHEN fidelity<99e0 THEN 1 ELSE 0 END AS f, CASE WHEN ssim<0.98e0 THEN 1 ELSE 0 END AS s,
  CASE WHEN edge_f1<0.98e0 THEN 1 ELSE 0 END AS e, CASE WHEN alpha_iou<0.98e0 THEN 1 ELSE 0 END AS a FROM bench_case WHERE side='cur'),
g AS (SELECT COUNT(*) AS case_count, CAST(SUM(CASE WHEN miss+f+s+e+a>0 THEN 1 ELSE 0 END) AS BIGINT) AS violation_case_count, CAST(SUM(miss) AS BIGINT) AS missing_case_count, CAST(SUM(f) AS BIGINT) AS fidelity_violations,
  CAST(SUM(s) AS BIGINT) AS ssim_violations, CAST(SUM(e) AS BIGINT) AS edge_f1_violations, CAST(SUM(a) AS BIGINT) AS alpha_iou_violations FROM v),
w AS (SELECT string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY fidelity, case_id) AS worst_case_ids FROM (SELECT case_id, fidelity FROM v ORDER BY fidelity NULLS LAST, case_id LIMIT 5) z)
SELECT g.*, worst_case_ids, CASE WHEN violation_case_count>0 THEN 'no_go' ELSE 'go' END AS release_decision,
  concat_ws(',', CASE WHEN fidelity_violations>0 THEN 'fidelity_threshold_not_met' END, CASE WHEN ssim_violations+edge_f1_violations+alpha_iou_violations>0 THEN 'component_threshold_not_met' END,
  CASE WHEN missing_case_count>0 THEN 'missing_required_component_metrics' END) AS reasons FROM g CROSS JOIN w""")
def _(t: Tables):
    return ev.quality_decision(_side(t, "cur"))


@query("case_violations", """
SELECT case_id, round(fidelity,6) AS fidelity, CASE WHEN alpha_iou IS NULL THEN 'alpha_iou' ELSE '' END AS missing,
  concat_ws(',', CASE WHEN alpha_iou<0.98e0 THEN 'alpha_iou' END, CASE WHEN edge_f1<0.98e0 THEN 'edge_f1' END, CASE WHEN fidelity<99e0 THEN 'fidelity' END, CASE WHEN ssim<0.98e0 THEN 'ssim' END) AS violations
FROM bench_case WHERE side='cur'""")
def _(t: Tables):
    d = ev.case_violations(_side(t, "cur"))
    return rounded(d.withColumn("missing", F.array_join("missing", ",")).withColumn("violations", F.array_join("violations", ",")))


@query("retry_audit", """
WITH g AS (SELECT case_id, i AS repeat_index FROM (SELECT DISTINCT case_id FROM bench) c CROSS JOIN (SELECT unnest([1,2,3]) AS i) q), x AS (
SELECT case_id, repeat_index, 'missing_identity' AS code FROM g ANTI JOIN retry USING (case_id, repeat_index)
UNION ALL SELECT case_id, repeat_index, 'incomplete_sample' FROM retry WHERE status<>'success'
UNION ALL SELECT case_id, repeat_index, 'non_allowlisted_retry_class' FROM retry WHERE retry_class='quality_threshold_failure')
SELECT DISTINCT * FROM x""")
def _(t: Tables):
    return ev.retry_audit(t("bench").select("case_id").distinct(), t("retry"))


_COVER_SQL = """SELECT case_id, alpha_iou, CASE WHEN delta_e00>=9e0 THEN NULL ELSE delta_e00 END AS delta_e00, CASE WHEN ssim<0.96e0 OR delta_e00>=9e0 THEN NULL ELSE edge_f1 END AS edge_f1,
  CASE WHEN ssim<0.96e0 OR delta_e00>=9e0 THEN NULL ELSE ssim END AS ssim FROM bench_case WHERE side='cur'"""


@query("metric_coverage", f"""WITH c AS ({_COVER_SQL}), m AS (SELECT case_id, alpha_iou, concat_ws(',', CASE WHEN alpha_iou IS NULL THEN 'alpha_iou' END, CASE WHEN delta_e00 IS NULL THEN 'delta_e00' END,
  CASE WHEN edge_f1 IS NULL THEN 'edge_f1' END, CASE WHEN ssim IS NULL THEN 'ssim' END) AS missing_metrics FROM c)
SELECT case_id, missing_metrics, CASE WHEN missing_metrics IN ('edge_f1,ssim','delta_e00,edge_f1,ssim') AND alpha_iou IS NOT NULL THEN 'partial_quality_report_fallback' ELSE 'unclassified_required_metric_gap' END AS diagnosis
FROM m WHERE missing_metrics<>''""")
def _(t: Tables):
    t("bench_case").createOrReplaceTempView("bench_case")
    return ev.metric_coverage(t.spark.sql(_COVER_SQL))


@query("verify_clusters", """
WITH b AS (SELECT case_id, category, (alpha_iou IS NULL OR alpha_iou<0.98e0) AS a, edge_f1<0.98e0 AS e, fidelity<99e0 AS f, ssim<0.98e0 AS s FROM bench_case WHERE side='cur'),
m AS (SELECT category AS cluster_id, 'evidence' AS role, case_id FROM b WHERE case_id%20<>0
  UNION ALL SELECT 'seals', 'evidence', case_id FROM b WHERE category='logos' AND case_id%40=1
  UNION ALL SELECT category, 'verification', case_id FROM b WHERE case_id%10=0
  UNION ALL SELECT category, 'regression', case_id+1000000 FROM b WHERE case_id%50=0 AND category<>'gradients'),
ev AS (SELECT cluster_id, case_id FROM m WHERE role='evidence'),
meas AS (SELECT DISTINCT cluster_id, metric FROM (SELECT cluster_id, unnest(list_filter([CASE WHEN a THEN 'alpha_iou' END, CASE WHEN e THEN 'edge_f1' END, CASE WHEN f THEN 'fidelity' END, CASE WHEN s THEN 'ssim' END], lambda q: q IS NOT NULL)) AS metric FROM ev JOIN b USING (case_id)) z),
claim AS (SELECT DISTINCT category AS cluster_id, 'fidelity' AS metric FROM b UNION ALL SELECT DISTINCT category, 'color' FROM b WHERE category='logos')
SELECT cluster_id, 'passing_case_listed' AS code, CAST(case_id AS VARCHAR) AS subject FROM ev JOIN b USING (case_id) WHERE NOT (a OR e OR f OR s)
UNION ALL SELECT MIN(cluster_id), 'case_in_two_clusters', CAST(case_id AS VARCHAR) FROM (SELECT DISTINCT * FROM ev) q GROUP BY case_id HAVING COUNT(*)>1
UNION ALL SELECT cluster_id, 'failed_metric_not_claimed', metric FROM (SELECT * FROM meas EXCEPT SELECT * FROM claim) q
UNION ALL SELECT cluster_id, 'claimed_metric_not_failing', metric FROM (SELECT * FROM claim EXCEPT SELECT * FROM meas) q
UNION ALL SELECT cluster_id, 'verification_outside_evidence', CAST(case_id AS VARCHAR) FROM (SELECT cluster_id, case_id FROM m WHERE role='verification') v ANTI JOIN ev USING (cluster_id, case_id)
UNION ALL SELECT cluster_id, 'unknown_regression_case', CAST(case_id AS VARCHAR) FROM (SELECT cluster_id, case_id FROM m WHERE role='regression') v ANTI JOIN b USING (case_id)
UNION ALL SELECT cluster_id, 'missing_regression_sentinels', NULL FROM (SELECT DISTINCT cluster_id FROM m) q ANTI JOIN (SELECT cluster_id FROM m WHERE role='regression') z USING (cluster_id)
UNION ALL SELECT NULL, 'unclustered_failing_case', CAST(case_id AS VARCHAR) FROM (SELECT * FROM b WHERE a OR e OR f OR s) q ANTI JOIN ev USING (case_id)""")
def _(t: Tables):
    r = _side(t, "cur")
    member = lambda df, cid, role, case="case_id": df.select(cid.alias("cluster_id"), F.lit(role).alias("role"), F.expr(case).alias("case_id"))
    cat = F.col("category")
    members = (
        member(r.where("case_id % 20 <> 0"), cat, "evidence")
        .unionByName(member(r.where("category = 'logos' and case_id % 40 = 1"), F.lit("seals"), "evidence"))
        .unionByName(member(r.where("case_id % 10 = 0"), cat, "verification"))
        .unionByName(member(r.where("case_id % 50 = 0 and category <> 'gradients'"), cat, "regression", "case_id + 1000000"))
    )
    claims = r.select(cat.alias("cluster_id"), F.lit("fidelity").alias("metric")).distinct()
    claims = claims.unionByName(r.where("category = 'logos'").select(cat.alias("cluster_id"), F.lit("color").alias("metric")).distinct())
    return ev.verify_clusters(r, members, claims)


@query("determinism_failures", "SELECT side, case_id FROM bench GROUP BY side, case_id HAVING COUNT(DISTINCT artifact_sha256)>1")
def _(t: Tables):
    return ev.determinism_failures(t("bench"), ["side", "case_id"], ["artifact_sha256"])


_RELEASE_SAMPLES = """SELECT side, case_id, CASE category WHEN 'gradients' THEN 'photo_poster' WHEN 'seals' THEN 'lineart' ELSE 'geometric_logo' END AS mode, repeat_index,
  CASE WHEN case_id%17=0 AND repeat_index=2 THEN 'failed' WHEN case_id%19=0 THEN 'unavailable' ELSE 'completed' END AS status,
  CASE WHEN fidelity>90 THEN 'production_ready' ELSE 'needs_review' END AS verdict, artifact_sha256,
  CASE WHEN case_id%23=0 THEN md5('x') ELSE artifact_sha256 END AS evaluator_sha256, CASE WHEN case_id%29=0 THEN 0 ELSE path_count END AS path_count,
  edge_f1 AS ink_recall, alpha_iou AS ink_precision, CASE WHEN delta_e00>9 THEN 1e0 ELSE 0e0 END AS component_delta, (1-ssim)/10 AS seam_ratio, (1-edge_f1) AS halo_ratio FROM bench"""


@query("mode_release", f"""
WITH s AS ({_RELEASE_SAMPLES}), x AS (SELECT *, status='completed' AS dn, mode='photo_poster' AS ph, status='completed' AND mode<>'photo_poster' AND ink_precision IS NOT NULL AS mt FROM s),
g AS (SELECT side, case_id, mode, COUNT(*) AS n, COUNT(DISTINCT repeat_index) AS ri, MIN(repeat_index) AS lo, MAX(repeat_index) AS hi, bool_and(dn) AS alldone, bool_and(status='unavailable') AS gone, bool_or(status='failed') AS failed, COUNT(DISTINCT artifact_sha256) AS shas,
  bool_and(verdict='production_ready') AS ready, bool_or(dn AND artifact_sha256<>evaluator_sha256) AS c1, bool_or(dn AND path_count<=0) AS c2, bool_or(dn AND ph AND verdict<>'needs_review') AS c3,
  bool_or(dn AND NOT ph AND ink_precision IS NULL) AS c4, COALESCE(bool_or(mt AND ink_recall<0.995e0),FALSE) AS c5, COALESCE(bool_or(mt AND ink_precision<0.975e0),FALSE) AS c6, bool_or(mt AND component_delta<>0) AS c7,
  bool_or(mt AND seam_ratio>0.002e0) AS c8, bool_or(mt AND halo_ratio>0.02e0) AS c9 FROM x GROUP BY side, case_id, mode),
r AS (SELECT *, concat_ws(',', CASE WHEN n<>3 THEN 'repeat_sample_count_mismatch' END, CASE WHEN ri<>3 OR lo<>1 OR hi<>3 THEN 'repeat_indices_invalid' END, CASE WHEN alldone AND c1 THEN 'evaluator_digest_mismatch' END, CASE WHEN alldone AND c2 THEN 'empty_vector_document' END,
  CASE WHEN alldone AND c3 THEN 'false_production_ready' END, CASE WHEN alldone AND c4 THEN 'ink_precision_unmeasured' END, CASE WHEN alldone AND c5 THEN 'ink_recall_below_min' END, CASE WHEN alldone AND c6 THEN 'ink_precision_below_min' END,
  CASE WHEN alldone AND c7 THEN 'component_delta_nonzero' END, CASE WHEN alldone AND c8 THEN 'seam_ratio_above_max' END, CASE WHEN alldone AND c9 THEN 'halo_ratio_above_max' END, CASE WHEN failed THEN 'sample_failed' END,
  CASE WHEN alldone AND shas<>1 THEN 'non_deterministic_artifact_digest' END, CASE WHEN NOT alldone AND NOT gone THEN 'mixed_repeat_status' END) AS reason_codes FROM g)
SELECT side, case_id, mode, CASE WHEN reason_codes<>'' THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN gone THEN 'unavailable' WHEN NOT alldone THEN 'failed' WHEN mode='photo_poster' THEN 'needs_review' WHEN ready THEN 'production_ready' ELSE 'needs_review' END AS release_status, reason_codes FROM r""")
def _(t: Tables):
    t("bench").createOrReplaceTempView("bench")
    return ev.mode_release(t.spark.sql(_RELEASE_SAMPLES), ["side", "case_id"])


_KINDS_SQL = """SELECT CASE category WHEN 'logos' THEN 'geometric' WHEN 'seals' THEN 'edge' WHEN 'technical' THEN 'color' WHEN 'signatures' THEN 'typography' ELSE 'multi_scale' END AS kind,
  CONCAT(CAST(case_id AS VARCHAR(20)), '-', CAST(repeat_index AS VARCHAR(2))) AS case_id, edge_f1 AS score, (1-ssim)/4 AS error, CASE WHEN delta_e00>9.5e0 THEN 1 ELSE 0 END AS defects FROM bench WHERE side='cur'"""


@query("fidelity_gate", f"""
WITH k AS ({_KINDS_SQL}), g AS (SELECT kind, COUNT(*) AS cases, AVG(score) AS mean_score, CASE kind WHEN 'geometric' THEN MIN(score) WHEN 'edge' THEN quantile_disc(score,0.05) ELSE quantile_cont(score,0.05) END AS low_score,
  CASE kind WHEN 'geometric' THEN MAX(error) WHEN 'edge' THEN quantile_disc(error,0.95) ELSE quantile_cont(error,0.95) END AS high_error, CAST(SUM(defects) AS BIGINT) AS defects FROM k GROUP BY kind),
r AS (SELECT *, concat_ws(',', CASE WHEN mean_score<0.99e0 THEN 'mean_score' END, CASE WHEN low_score<0.98e0 THEN 'low_score' END, CASE WHEN high_error>CASE WHEN kind='geometric' THEN 0.005e0 ELSE 0.02e0 END THEN 'high_error' END,
  CASE WHEN defects>0 THEN 'defects' END) AS reasons FROM g)
SELECT kind, cases, round(mean_score,6) AS mean_score, round(low_score,6) AS low_score, round(high_error,6) AS high_error, defects, CASE WHEN reasons<>'' THEN 'fail' ELSE 'pass' END AS status, reasons FROM r""")
def _(t: Tables):
    t("bench").createOrReplaceTempView("bench")
    return rounded(ev.fidelity_gate(t.spark.sql(_KINDS_SQL)))


_REFINE_SQL = """SELECT b.case_id, CONCAT(md5(b.category), md5('in')) AS input_sha256, CONCAT(md5('m'), md5('odel')) AS model_sha256,
  CASE WHEN b.case_id%41=0 THEN SUBSTRING(md5('o'),1,9) ELSE CONCAT(md5(CASE WHEN b.category IN ('logos','seals') THEN CAST(b.case_id AS VARCHAR(20)) ELSE b.category END), md5('out')) END AS output_sha256,
  b.edge_f1 AS pre_fidelity, c.edge_f1 AS post_fidelity, CAST(c.fidelity-50 AS INT) + CASE WHEN b.case_id%43=0 THEN 60 ELSE 0 END AS edit_count,
  CASE WHEN b.case_id%47=0 THEN 'geometry,texture' ELSE 'geometry,color' END AS classes, CASE WHEN b.case_id%53=0 THEN 1 ELSE 0 END AS defects
  FROM bench_case b JOIN bench_case c ON b.case_id=c.case_id AND b.side='base' AND c.side='cur'"""


@query("refiner_gate", f"""
WITH r AS ({_REFINE_SQL})
SELECT CAST(case_id AS VARCHAR) AS subject, code FROM r CROSS JOIN (SELECT unnest(['invalid_digest','fidelity_regression','unbounded_edit_count','unexpected_edit_class','refiner_defect']) AS code) q
WHERE (code='invalid_digest' AND length(output_sha256)<>64) OR (code='fidelity_regression' AND post_fidelity<pre_fidelity) OR (code='unbounded_edit_count' AND (edit_count<0 OR edit_count>64))
 OR (code='unexpected_edit_class' AND classes LIKE '%texture%') OR (code='refiner_defect' AND defects>0)
UNION ALL SELECT input_sha256, 'nondeterministic_output_digest' FROM r GROUP BY input_sha256 HAVING COUNT(DISTINCT output_sha256)>1
UNION ALL SELECT '*', 'negative_mean_gain' FROM (SELECT AVG(post_fidelity-pre_fidelity) AS g FROM r) z WHERE g<0
UNION ALL SELECT '*', 'p05_post_fidelity' FROM (SELECT quantile_cont(post_fidelity,0.05) AS g FROM r) z WHERE g<0.99e0""")
def _(t: Tables):
    t("bench_case").createOrReplaceTempView("bench_case")
    return ev.refiner_gate(t.spark.sql(_REFINE_SQL).withColumn("edit_classes", F.split("classes", ",")))


_FORMATS_SQL = """SELECT c.case_id, f.fmt AS format, CASE WHEN c.case_id%59=0 THEN 'bad' ELSE c.source_sha256 END AS artifact_sha256, c.case_id%61<>0 AS parsed, c.case_id%67<>0 AS structure_valid,
  CASE WHEN c.case_id%71=0 THEN 2e0 ELSE 1-(c.case_id%5)/100e0 END AS metadata_consistency FROM case_rec c CROSS JOIN (SELECT 'svg' AS fmt UNION ALL SELECT 'pdf' UNION ALL SELECT 'eps' UNION ALL SELECT 'dxf') f
  WHERE NOT (c.case_id%73=0 AND f.fmt='eps')"""


@query("print_ready_gate", f"""
WITH f AS ({_FORMATS_SQL})
SELECT CAST(case_id AS VARCHAR) AS case_id, code FROM case_rec CROSS JOIN (SELECT unnest(['invalid_formats','invalid_artifact_digest','failed_parsed','failed_structure_valid','invalid_metadata_consistency','print_ready_defect']) AS code) q
WHERE (code='invalid_formats' AND case_id%73=0) OR (code='invalid_artifact_digest' AND case_id%59=0) OR (code='failed_parsed' AND case_id%61=0) OR (code='failed_structure_valid' AND case_id%67=0)
 OR (code='invalid_metadata_consistency' AND case_id%71=0) OR (code='print_ready_defect' AND contains_public_pii)
UNION ALL SELECT '*', 'metadata_consistency_regression' FROM (SELECT AVG(metadata_consistency) AS m FROM f) z WHERE m<0.99e0""")
def _(t: Tables):
    c = t("case_rec")
    c.createOrReplaceTempView("case_rec")
    return ev.print_ready_gate(t.spark.sql(_FORMATS_SQL), c.select("case_id", F.col("contains_public_pii").cast("int").alias("defects")))


_FINAL_SQL = """SELECT case_id, edge_f1 AS geometric, ssim AS edge, edge_f1 AS color, 1-delta_e00/1000 AS typography, CASE WHEN case_id%79=0 THEN 2e0 ELSE 1e0 END AS print_readiness,
  (ssim+edge_f1)/2 AS overall_fidelity, case_id%3<>0 AS published FROM bench_case WHERE side='cur'"""


@query("final_gate", f"""
WITH r AS ({_FINAL_SQL})
SELECT CAST(case_id AS VARCHAR) AS case_id, code FROM r CROSS JOIN (SELECT unnest(['component_out_of_range','component_fidelity_regression','rejected_artifact_published','overall_fidelity_regression','qualified_artifact_not_published']) AS code) q
WHERE (code='component_out_of_range' AND print_readiness>1) OR (code='component_fidelity_regression' AND least(geometric,edge,color,typography,print_readiness)<0.98e0)
 OR (code='rejected_artifact_published' AND overall_fidelity<0.99e0 AND published) OR (code='overall_fidelity_regression' AND overall_fidelity<0.99e0 AND NOT published) OR (code='qualified_artifact_not_published' AND overall_fidelity>=0.99e0 AND NOT published)
UNION ALL SELECT '*', 'mean_overall_fidelity_regression' FROM (SELECT AVG(overall_fidelity) AS m FROM r) z WHERE m<0.99e0""")
def _(t: Tables):
    t("bench_case").createOrReplaceTempView("bench_case")
    return ev.final_gate(t.spark.sql(_FINAL_SQL))


_EXPECT = "SELECT * FROM (VALUES ('transparent','alpha_iou',0.95e0,1e0),('logos','fidelity',60e0,100e0),('seals','path_count',10e0,500e0),('technical','delta_e00',0e0,9.5e0)) AS e(category, metric, min_value, max_value)"


@query("fixture_acceptance", f"""WITH e AS ({_EXPECT}), l AS (SELECT case_id, category, metric, value FROM (SELECT * FROM bench_case WHERE side='cur') UNPIVOT INCLUDE NULLS (value FOR metric IN ({_METRIC_LIST})))
SELECT category, case_id, metric, round(value,6) AS value FROM l JOIN e USING (category, metric) WHERE value IS NULL OR value<min_value OR value>max_value""")
def _(t: Tables):
    return rounded(ev.fixture_acceptance(ev.to_long(_side(t, "cur"), ["case_id", "category"]), t.spark.sql(_EXPECT), "category"))


@query("provenance_agreement", """
WITH p AS (SELECT side, case_id, CASE WHEN case_id%83=0 AND repeat_index=1 THEN NULL ELSE CONCAT(category, '|', CASE WHEN case_id%31=0 THEN CAST(repeat_index AS VARCHAR) ELSE 'exact' END) END AS p FROM bench)
SELECT side, case_id, CASE WHEN COUNT(*)-COUNT(p) BETWEEN 1 AND COUNT(*)-1 THEN 'mixed_provenance_coverage' ELSE 'non_deterministic_provenance' END AS problem FROM p GROUP BY side, case_id
HAVING COUNT(*)-COUNT(p) BETWEEN 1 AND COUNT(*)-1 OR COUNT(DISTINCT p)>1""")
def _(t: Tables):
    prov = F.expr("""CASE WHEN case_id%83=0 AND repeat_index=1 THEN NULL ELSE map('metric_source', CASE WHEN case_id%31=0 THEN CAST(repeat_index AS STRING) ELSE 'exact' END,
      'category', category, 'exact_evaluator_failure_message_sanitized', CAST(render_ms AS STRING)) END""")
    return ev.provenance_agreement(t("bench").withColumn("prov", prov), ["side", "case_id"], "prov")


@query("canonical_digest", """
WITH h AS (SELECT sha256(CONCAT('{"case_id":', case_id, ',"category":"', category, '","source_sha256":"', source_sha256, '"}')) AS h FROM case_rec),
g AS (SELECT h, COUNT(*) AS n FROM h GROUP BY h),
p AS (SELECT CAST(CONCAT('0x', substring(h,1,6)) AS INT) % 256 AS p, CONCAT(h, 'x', n) AS hx, n FROM g),
q AS (SELECT p, sha256(string_agg(hx, ',' ORDER BY hx)) AS g, SUM(n) AS n FROM p GROUP BY p)
SELECT CAST(SUM(n) AS BIGINT) AS row_count, sha256(string_agg(CONCAT(lpad(CAST(p AS VARCHAR),9,'0'), ':', g), ',' ORDER BY p)) AS digest FROM q""")
def _(t: Tables):
    return ev.canonical_digest(t("case_rec"), ["case_id", "category", "source_sha256"])


@query("fallback_evidence", """
WITH c AS (SELECT case_id FROM bench_case WHERE side='cur' AND alpha_iou IS NULL), a AS (SELECT case_id, COUNT(*) AS n, COUNT(DISTINCT repeat_index) AS k,
  string_agg(CONCAT(repeat_index, ':', attempt_count, ':', status), '|' ORDER BY repeat_index) AS repeat_audit FROM retry GROUP BY case_id)
SELECT c.case_id, COALESCE(n=3 AND k=3, FALSE) AS repeat_cover, repeat_audit FROM c LEFT JOIN a USING (case_id)""")
def _(t: Tables):
    return ev.fallback_evidence(_side(t, "cur"), t("retry"), ["alpha_iou"])


# -- analyzer calibration ----------------------------------------------------

_MBIN = "CASE WHEN m BETWEEN -1 AND 0.05e0 THEN 0 WHEN m>0.05e0 AND m<=0.2e0 THEN 1 WHEN m>0.2e0 AND m<=0.4e0 THEN 2 WHEN m>0.4e0 THEN 3 ELSE 0 END"
_BINS = f"""g AS (SELECT CAST({_MBIN.replace('m ', 'runner_up_margin ').replace('m>', 'runner_up_margin>').replace('m<', 'runner_up_margin<')} AS INT) AS bin, COUNT(*) FILTER (label=recommended_mode) AS correct, COUNT(*) AS total FROM calib GROUP BY 1),
cb AS (SELECT CAST(b AS INT) AS bin, COALESCE(correct,0) AS correct, COALESCE(total,0) AS total, round_even((COALESCE(correct,0)+1)/(COALESCE(total,0)+2),6) AS confidence FROM (SELECT unnest(range(4)) AS b) q LEFT JOIN g ON g.bin=q.b)"""


@query("calibration_bins", f"WITH {_BINS} SELECT * FROM cb")
def _(t: Tables):
    return cal.calibration_bins(t("calib"))


@query("calibrated_confidence", f"""WITH {_BINS}, d AS (SELECT case_id, confidence AS selected_score, runner_up_margin, CAST({_MBIN.replace('m ', 'runner_up_margin ').replace('m>', 'runner_up_margin>').replace('m<', 'runner_up_margin<')} AS INT) AS bin, case_id%2=0 AS signal FROM calib)
SELECT case_id, d.bin, round_even(greatest(0e0, least(1e0, least(selected_score, confidence, CASE WHEN runner_up_margin<0 THEN 0.25e0 ELSE 9 END, CASE WHEN NOT signal THEN 0.85e0 ELSE 9 END))),6) AS calibrated FROM d JOIN cb ON cb.bin=d.bin""")
def _(t: Tables):
    c = t("calib")
    d = c.withColumn("selected_score", F.col("confidence")).withColumn("signal_available", F.expr("case_id % 2 = 0"))
    return cal.calibrated_confidence(d, cal.calibration_bins(c)).select("case_id", "bin", "calibrated")


@query("auto_decision", """
SELECT case_id, CASE WHEN case_id%13=0 THEN 'manual' WHEN confidence<0.5e0 OR runner_up_margin<0.05e0 THEN 'needs_review' ELSE 'accepted' END AS decision,
 CASE WHEN case_id%13=0 THEN 'manual_mode_bypass' WHEN confidence<0.5e0 OR runner_up_margin<0.05e0 THEN concat_ws(',', CASE WHEN confidence<0.5e0 THEN 'confidence_below_minimum' END, CASE WHEN runner_up_margin<0.05e0 THEN 'margin_below_minimum' END) ELSE 'verified_recommendation' END AS reason_codes FROM calib""")
def _(t: Tables):
    d = t("calib").withColumn("requested_mode", F.expr("CASE WHEN case_id%13=0 THEN 'lineart' ELSE 'auto' END"))
    return cal.auto_decision(d).select("case_id", "decision", F.array_join("reason_codes", ",").alias("reason_codes"))


_MODES = "(SELECT unnest(['geometric_logo','minimal_ai','logo_color','single_color','lineart','photo_poster']) AS mode)"
_CONF = f"""p AS (SELECT recommended_mode AS mode, COUNT(*) AS recommended, COUNT(*) FILTER (label=recommended_mode) AS correct, COUNT(*) FILTER (decision_status='accepted') AS accepted, COUNT(*) FILTER (decision_status='accepted' AND label=recommended_mode) AS ac FROM calib GROUP BY 1),
lb AS (SELECT label AS mode, COUNT(*) AS labelled, COUNT(*) FILTER (label=recommended_mode) AS hit FROM calib GROUP BY 1),
cm AS (SELECT m.mode, COALESCE(recommended,0) AS recommended, COALESCE(correct,0) AS correct, COALESCE(accepted,0) AS accepted, COALESCE(labelled,0) AS labelled, correct/NULLIF(recommended,0) AS precision, ac/NULLIF(accepted,0) AS accepted_precision, COALESCE(hit/NULLIF(labelled,0),0e0) AS recall
FROM {_MODES} m LEFT JOIN p USING (mode) LEFT JOIN lb USING (mode))"""


@query("confusion_matrix", f"WITH {_CONF} SELECT mode, recommended, correct, accepted, labelled, round(precision,6) AS precision, round(accepted_precision,6) AS accepted_precision, round(recall,6) AS recall FROM cm")
def _(t: Tables):
    return rounded(cal.confusion_matrix(t("calib")))


@query("confusion_counts", "SELECT label, " + ", ".join(f"COUNT(*) FILTER (recommended_mode='{m}') AS {m}" for m in cal.AUTO_MODES) + " FROM calib GROUP BY label")
def _(t: Tables):
    return cal.confusion_counts(t("calib"))


_ECE = """o AS (SELECT confidence AS c, CASE WHEN decision_status='accepted' AND label=recommended_mode THEN 1e0 ELSE 0e0 END AS o FROM calib WHERE confidence BETWEEN 0 AND 1),
eb AS (SELECT CASE WHEN c<=0.5e0 THEN 0 WHEN c<=0.7e0 THEN 1 WHEN c<=0.85e0 THEN 2 ELSE 3 END AS bin, COUNT(*) AS n, AVG(c) AS c, AVG(o) AS o, SUM((c-o)*(c-o)) AS sq FROM o GROUP BY 1),
ce AS (SELECT CAST(SUM(n) AS BIGINT) AS case_count, round_even(SUM(sq)/SUM(n),6) AS brier_score, round_even(SUM(n*ABS(c-o))/SUM(n),6) AS expected_calibration_error FROM eb)"""


@query("calibration_error", f"WITH {_ECE} SELECT * FROM ce")
def _(t: Tables):
    return cal.calibration_error(t("calib"))


@query("analyzer_release_gate", f"""WITH {_CONF}, {_ECE}, k AS (SELECT *, CASE WHEN case_id%2=0 THEN 'in_domain' ELSE 'boundary' END AS kind FROM calib)
SELECT DISTINCT code FROM (
SELECT CONCAT('in_domain_prediction_mismatch:', case_id) AS code FROM k WHERE kind='in_domain' AND label<>recommended_mode
UNION ALL SELECT CONCAT('boundary_false_accept:', case_id) FROM k WHERE kind='boundary' AND label<>recommended_mode AND decision_status<>'needs_review'
UNION ALL SELECT CONCAT('correct_recommendation_coverage:', mode) FROM cm WHERE correct<1
UNION ALL SELECT CONCAT('recommendation_precision:', mode) FROM cm WHERE precision IS NULL OR precision<1
UNION ALL SELECT CONCAT('accepted_precision:', mode) FROM cm WHERE accepted_precision<1
UNION ALL SELECT 'brier_score' FROM ce WHERE brier_score>0.35e0
UNION ALL SELECT 'expected_calibration_error' FROM ce WHERE expected_calibration_error>0.35e0
UNION ALL SELECT 'accepted_wrong_mode' FROM k WHERE decision_status='accepted' AND label<>recommended_mode
UNION ALL SELECT 'mode_kind_coverage' FROM (SELECT COUNT(*) AS n FROM (SELECT DISTINCT label, kind FROM k) z) y WHERE n<12) q""")
def _(t: Tables):
    return cal.analyzer_release_gate(t("calib").withColumn("kind", F.expr("CASE WHEN case_id%2=0 THEN 'in_domain' ELSE 'boundary' END")))
