"""Queries over jobs, sessions, feedback, corpus records and report sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.functions.columns import rounded
from mosaiq.operators import intake as it, jobs as jb
from mosaiq.plans.registry import Tables, query, scratch
from mosaiq.session import cut_lineage, spread
from mosaiq.sources import images as im, reports as rp


def _sql(t: Tables, view: str, text: str) -> DataFrame:
    t(view).createOrReplaceTempView(view)
    return t.spark.sql(text)


_TERM = "state IN ('succeeded','failed','cancelled','damaged')"
_EVENTS = "SELECT owner AS job_id, CAST(updated_at AS DATE) AS ts, job_id AS seq, state FROM job"


@query("job_state", f"""WITH e AS ({_EVENTS}), f AS (SELECT job_id, MIN((ts, seq)) AS en FROM e WHERE {_TERM} GROUP BY job_id),
l AS (SELECT job_id, state FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC)=1),
d AS (SELECT job_id, state FROM e WHERE {_TERM} QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts, seq)=1)
SELECT l.job_id, COALESCE(d.state, l.state) AS state, n.events, n.rejected_events FROM l LEFT JOIN d USING (job_id)
JOIN (SELECT e.job_id, COUNT(*) AS events, COUNT(*) FILTER ((e.ts, e.seq)>f.en) AS rejected_events FROM e LEFT JOIN f USING (job_id) GROUP BY e.job_id) n ON n.job_id=l.job_id""")
def _(t: Tables):
    return jb.job_state(_sql(t, "job", _EVENTS))


@query("recover_buckets", f"SELECT job_id, CASE WHEN job_id%13=0 THEN 'damaged' WHEN {_TERM} THEN 'complete' ELSE 'incomplete' END AS bucket FROM job")
def _(t: Tables):
    env = rp.with_envelope(t("job").withColumn("job", F.col("job_id")), "job_id", ["job", "owner", "state"])
    broken = env.withColumn("sha256", F.expr("CASE WHEN job_id%13=0 THEN md5(sha256) ELSE sha256 END"))
    checked = rp.check_envelope(broken).withColumn("state", F.get_json_object("payload", "$.state"))
    return jb.recover_buckets(checked).select("job_id", "bucket")


_QUOTA, _DAYS, _BUDGET = 1_000_000, 2000, 0.5


@query("retention_plan", f"""WITH a AS (SELECT job_id, owner, bytes, updated_at AS u FROM job), x AS (SELECT job_id, owner, date_diff('second', u, MAX(u) OVER ())>{_DAYS}*86400 AS old, bytes, u FROM a),
k AS (SELECT * FROM x WHERE NOT old), o AS (SELECT *, SUM(bytes) OVER (PARTITION BY owner ORDER BY u DESC, job_id DESC) > {_QUOTA} AS ev FROM k),
k2 AS (SELECT * FROM o WHERE NOT ev), g AS (SELECT *, SUM(bytes) OVER (ORDER BY u DESC, job_id DESC) > 1000000000 AS eg FROM k2)
SELECT job_id, owner, 'expired' AS phase FROM x WHERE old UNION ALL SELECT job_id, owner, 'user_quota' FROM o WHERE ev UNION ALL SELECT job_id, owner, 'disk_budget' FROM g WHERE eg""")
def _(t: Tables):
    return jb.retention_plan(t("job"), _DAYS, _QUOTA, 1_000_000_000)


_REMOTE = "SELECT job_id, CASE WHEN job_id%4=0 THEN revision+1 WHEN job_id%4=1 THEN revision-1 ELSE revision END AS revision, CASE WHEN job_id%3=0 THEN md5(sha256) ELSE sha256 END AS sha256 FROM job WHERE job_id%9<>0"


@query("accept_remote", f"""WITH r AS ({_REMOTE}), l AS (SELECT job_id, revision, sha256 FROM job WHERE job_id%10<>0)
SELECT COALESCE(l.job_id, r.job_id) AS job_id, l.revision AS local_revision, r.revision AS remote_revision, CASE WHEN r.job_id IS NULL THEN 'no_remote' WHEN r.revision<COALESCE(l.revision,0) THEN 'rejected_stale' WHEN r.revision=l.revision AND r.sha256<>l.sha256 THEN 'conflict' ELSE 'accepted' END AS status
FROM l FULL OUTER JOIN r ON l.job_id=r.job_id""")
def _(t: Tables):
    return jb.accept_remote(t("job").where("job_id % 10 <> 0"), _sql(t, "job", _REMOTE))


@query("attempt_windows", """WITH a AS (SELECT event_id, namespace, key_id, ts, CAST(FLOOR(epoch(ts)) AS BIGINT) AS s FROM attempt), w AS (SELECT *, s - s%86400 AS window_start FROM a),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY namespace, key_id, window_start ORDER BY ts, event_id) AS count FROM w)
SELECT event_id, namespace, key_id, window_start, count, count<=2 AS allowed, GREATEST(0, 2-count) AS remaining, GREATEST(1, window_start+86400-s) AS retry_after FROM c""")
def _(t: Tables):
    return jb.attempt_windows(t("attempt"), 2, 86400)


@query("active_sessions", """SELECT a.event_id AS probe_id, s.session_id, s.user_id FROM session s JOIN attempt a ON a.key_id=s.user_id AND s.created_at<=a.ts AND a.ts<s.expires_at AND (s.revoked_at IS NULL OR a.ts<s.revoked_at)""")
def _(t: Tables):
    probes = t("attempt").select(F.col("event_id").alias("probe_id"), F.col("key_id").alias("user_id"), "ts")
    return jb.active_sessions(t("session"), probes)


@query("cleanup_candidates", "SELECT job_id, state, bytes FROM job WHERE state IN ('succeeded','failed','cancelled','timed_out','quarantined') AND NOT pinned")
def _(t: Tables):
    return jb.cleanup_candidates(t("job")).select("job_id", "state", "bytes")


@query("stale_leases", "SELECT job_id, lease_age FROM (SELECT job_id, (job_id*17)%300 AS lease_age FROM job) z WHERE lease_age>120")
def _(t: Tables):
    return jb.stale_leases(_sql(t, "job", "SELECT job_id, (job_id*17)%300 AS lease_age FROM job"))


_STAGE = """SELECT b.case_id, CASE b.category WHEN 'logos' THEN 'clean_logo' WHEN 'technical' THEN 'lineart' WHEN 'seals' THEN 'geometric' WHEN 'gradients' THEN 'photo' ELSE 'illustration' END AS image_class,
 CASE WHEN b.case_id%6=0 THEN NULL ELSE b.ssim END AS b_ssim, b.edge_f1 AS b_edge_f1, (1-b.ssim)/10 AS b_seam_ratio, CAST(b.path_count AS INT)%3 AS b_component_delta, CAST(b.path_count AS INT)%2 AS b_hole_delta, b.path_count/20 AS b_path_count, b.path_count AS b_node_count, b.svg_bytes AS b_byte_size,
 c.ssim AS a_ssim, CASE WHEN b.case_id%25=0 THEN NULL ELSE c.edge_f1 END AS a_edge_f1, (1-c.ssim)/10 AS a_seam_ratio, CAST(c.path_count AS INT)%3 AS a_component_delta, CAST(c.path_count AS INT)%2 AS a_hole_delta, c.path_count AS a_path_count, c.path_count*8 AS a_node_count, c.svg_bytes*4 AS a_byte_size
 FROM bench_case b JOIN bench_case c ON b.case_id=c.case_id WHERE b.side='base' AND c.side='cur'"""
_ABS = lambda i: "CASE image_class WHEN 'geometric' THEN %s WHEN 'clean_logo' THEN %s WHEN 'lineart' THEN %s WHEN 'photo' THEN %s ELSE %s END" % tuple(
    f"{v[i]}e0" for v in [*(jb.ABSOLUTE_GATES[k] for k in ("geometric", "clean_logo", "lineart", "photo")), jb.ABSOLUTE_DEFAULT]
)
_STAGE_ORACLE = f"""st AS ({_STAGE}), kn AS (SELECT *, b_ssim IS NOT NULL AS k, image_class<>'photo' AS tp FROM st),
sg AS (SELECT *, CASE WHEN a_edge_f1 IS NULL THEN 'stage_metrics_incomplete' ELSE concat_ws(',', CASE WHEN tp AND a_component_delta>CASE WHEN k THEN b_component_delta ELSE 0 END THEN 'topology_component_regression' END, CASE WHEN tp AND a_hole_delta>CASE WHEN k THEN b_hole_delta ELSE 0 END THEN 'topology_hole_regression' END,
 CASE WHEN k AND a_ssim<b_ssim-0.0005e0 THEN 'ssim_regression' END, CASE WHEN k AND a_edge_f1<b_edge_f1-0.0015e0 THEN 'edge_f1_regression' END, CASE WHEN k AND a_seam_ratio>GREATEST(b_seam_ratio+0.0005e0, b_seam_ratio*1.25e0) THEN 'seam_regression' END,
 CASE WHEN NOT k AND a_ssim<{_ABS(0)} THEN 'ssim_absolute_gate' END, CASE WHEN NOT k AND a_edge_f1<{_ABS(1)} THEN 'edge_f1_absolute_gate' END, CASE WHEN NOT k AND a_seam_ratio>{_ABS(2)} THEN 'seam_absolute_gate' END,
 CASE WHEN a_path_count>GREATEST(GREATEST(1,b_path_count)*4, GREATEST(1,b_path_count)+500) THEN 'path_complexity_explosion' END, CASE WHEN a_node_count>GREATEST(GREATEST(1,b_node_count)*4, GREATEST(1,b_node_count)+2500) THEN 'node_complexity_explosion' END,
 CASE WHEN a_byte_size>GREATEST(GREATEST(1,b_byte_size)*3, GREATEST(1,b_byte_size)+250000) THEN 'byte_complexity_explosion' END) END AS reasons FROM kn)"""


@query("stage_gate", f"WITH {_STAGE_ORACLE} SELECT case_id, reasons, reasons='' AS accepted FROM sg")
def _(t: Tables):
    return jb.stage_gate(_sql(t, "bench_case", _STAGE)).select("case_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query("measured_apply", f"WITH {_STAGE_ORACLE} SELECT case_id, round(CASE WHEN reasons='' THEN a_ssim ELSE b_ssim END,6) AS ssim, round(CASE WHEN reasons='' THEN a_path_count ELSE b_path_count END,6) AS path_count, reasons='' AS accepted FROM sg")
def _(t: Tables):
    pairs = _sql(t, "bench_case", _STAGE)
    names = [*jb.STAGE_METRICS, "path_count", "node_count", "byte_size"]
    before = pairs.select("case_id", "image_class", *[F.col(f"b_{c}").alias(c) for c in names])
    after = pairs.select("case_id", *[F.col(f"a_{c}").alias(c) for c in names])
    out = jb.measured_apply(before, lambda df: df.select("case_id").join(after, "case_id"), "case_id")
    return rounded(out.select("case_id", "ssim", "path_count", "accepted"))


_CHAIN = """SELECT case_id AS journal_id, repeat_index AS stage, CASE WHEN case_id%15=0 AND repeat_index=3 THEN md5('gap') WHEN repeat_index=1 THEN md5('start') ELSE md5(CONCAT(CAST(case_id AS VARCHAR(20)), '-', CAST(repeat_index-1 AS VARCHAR(5)))) END AS parent_sha256,
 md5(CONCAT(CAST(case_id AS VARCHAR(20)), '-', CAST(repeat_index AS VARCHAR(5)))) AS accepted_sha256 FROM bench WHERE side='cur'"""


@query("verify_chain", f"""WITH c AS ({_CHAIN}) SELECT a.journal_id, a.stage, 'stage_parent_hash_mismatch' AS code FROM c a JOIN c b ON a.journal_id=b.journal_id AND a.stage=b.stage+1 WHERE a.parent_sha256<>b.accepted_sha256
UNION ALL SELECT journal_id, MAX(stage), 'journal_final_hash_mismatch' FROM c WHERE journal_id%21=0 GROUP BY journal_id UNION ALL SELECT journal_id, stage, 'journal_boundary_hash_mismatch' FROM c WHERE stage=1 AND journal_id%22=0""")
def _(t: Tables):
    c = cut_lineage(spread(_sql(t, "bench", _CHAIN), "journal_id"))  # read six times
    ends = c.groupBy("journal_id").agg(F.max_by("accepted_sha256", "stage").alias("accepted_sha256")).selectExpr("journal_id", "CASE WHEN journal_id%22=0 THEN md5('other') ELSE md5('start') END AS baseline_sha256", "CASE WHEN journal_id%21=0 THEN md5('x') ELSE accepted_sha256 END AS final_sha256")
    return jb.verify_chain(c, "journal_id", ends)


_FB = """f AS (SELECT event_id, line::JSON->>'job_id' AS job_id, line::JSON->>'issue_type' AS issue_type, line::JSON->>'expected_color_hex' AS e, line::JSON->>'actual_color_hex' AS a FROM feedback WHERE json_valid(line)),
fc AS (SELECT *, CASE WHEN issue_type='refund' THEN 'invalid_issue_type' END AS reject_reason, sqrt(list_sum(list_transform([2,4,6], lambda i: power(CAST(CONCAT('0x',substring(e,i,2)) AS INT)-CAST(CONCAT('0x',substring(a,i,2)) AS INT),2))))*0.1e0 AS d FROM f)"""


@query("read_feedback_log", f"WITH {_FB} SELECT event_id, job_id, issue_type, e AS expected_color_hex, a AS actual_color_hex FROM f")
def _(t: Tables):
    return rp.parse_feedback(t("feedback")).select("event_id", "job_id", "issue_type", "expected_color_hex", "actual_color_hex")


@query("feedback_cases", f"WITH {_FB} SELECT event_id, job_id, reject_reason, round(CASE WHEN reject_reason IS NULL THEN d END,6) AS delta_e_estimation FROM fc")
def _(t: Tables):
    return rounded(jb.feedback_cases(rp.parse_feedback(t("feedback"))).select("event_id", "job_id", "reject_reason", "delta_e_estimation"))


@query("feedback_rollup", f"WITH {_FB} SELECT issue_type, job_id, COUNT(*) AS cases, round(AVG(d),6) AS mean_delta_e FROM fc WHERE reject_reason IS NULL GROUP BY ROLLUP(issue_type, job_id)")
def _(t: Tables):
    return rounded(jb.feedback_rollup(jb.feedback_cases(rp.parse_feedback(t("feedback")))))


@query("admin_jobs", "SELECT job_id, owner, state FROM job ORDER BY updated_at DESC, job_id DESC LIMIT 100")
def _(t: Tables):
    return jb.admin_jobs(t("job"), 100).select("job_id", "owner", "state")


# -- corpus intake -------------------------------------------------------------

_REC = """SELECT CASE WHEN case_id%31=0 THEN 'X' ELSE CONCAT('case-', CAST(case_id AS VARCHAR(20))) END AS case_id, category, CASE WHEN case_id%37=0 THEN 'train' ELSE split END AS split, source_sha256, license, source_format, file_bytes, width, height*5 AS height, contains_public_pii,
 case_id%41=0 AS lied, CASE WHEN case_id%43=0 THEN 's3://x' ELSE CONCAT('objects/', source_sha256) END AS storage_object_id FROM case_rec"""


@query("validate_records", f"""WITH r AS ({_REC}) SELECT case_id, source_sha256, concat_ws(',', CASE WHEN case_id='X' THEN 'invalid_case_id' END, CASE WHEN category NOT IN ('en','de') THEN 'unknown_category' END, CASE WHEN split='train' THEN 'wrong_split' END, CASE WHEN license='unknown' THEN 'unreviewed_license' END,
 CASE WHEN source_format='bmp' THEN 'unsupported_source_format' END, CASE WHEN width*height>8294400 THEN 'pixel_budget_exceeded' END, CASE WHEN file_bytes<=0 OR file_bytes>26214400 THEN 'file_budget_exceeded' END, CASE WHEN contains_public_pii THEN 'privacy_gate_failed' END,
 CASE WHEN storage_object_id='s3://x' THEN 'invalid_storage_object' END, CASE WHEN lied THEN 'inspection_mismatch' END) AS codes FROM r""")
def _(t: Tables):
    r = _sql(t, "case_rec", _REC)
    insp = F.struct(*[(F.when(F.col("lied"), F.col("width") + 1).otherwise(F.col("width")) if c == "width" else F.col(c)).alias(c) for c in it.INSPECTED])
    return it.validate_records(r.withColumn("inspection", insp), ["en", "de"]).select("case_id", "source_sha256", F.array_join("codes", ",").alias("codes"))


@query("reject_duplicates", """WITH o AS (SELECT * FROM case_rec WHERE split='holdout'), n AS (SELECT * FROM case_rec WHERE split<>'holdout')
SELECT case_id, 'duplicate_source_sha256' AS code FROM n SEMI JOIN o USING (source_sha256)""")
def _(t: Tables):
    r = t("case_rec")
    return it.reject_duplicates(r.where("split <> 'holdout'"), r.where("split = 'holdout'"), ["case_id", "source_sha256"])


_TARGETS = "SELECT s.split, c.category, s.target FROM (VALUES ('calibration',72),('qualification',24),('holdout',24)) AS s(split, target) CROSS JOIN (VALUES ('en'),('de'),('fr'),('xx')) AS c(category)"


@query("coverage", f"""WITH t AS ({_TARGETS}), n AS (SELECT split, category, COUNT(*) AS n FROM case_rec GROUP BY 1,2), c AS (SELECT split, category, target, COALESCE(n,0) AS n FROM t LEFT JOIN n USING (split, category))
SELECT split, category, CAST(SUM(n) AS BIGINT) AS records, CAST(SUM(target) AS BIGINT) AS target, COUNT(*) FILTER (n=0) AS empty_cells, bool_and(n>=target) AS complete FROM c GROUP BY ROLLUP(split, category)""")
def _(t: Tables):
    return it.coverage(t("case_rec"), t.spark.sql(_TARGETS))


_OUT = """SELECT c.case_id AS job_id, f.fmt AS format, CASE WHEN c.case_id%61=0 THEN 0 ELSE c.file_bytes END AS byte_size, c.source_sha256 AS sha256, CASE WHEN c.case_id%67=0 AND f.fmt='pdf' THEN md5('x') ELSE c.source_sha256 END AS expected_sha256, NOT (c.contains_public_pii AND f.fmt='svg') AS structural_safe
 FROM case_rec c CROSS JOIN (SELECT 'svg' AS fmt UNION ALL SELECT 'pdf' UNION ALL SELECT 'eps' UNION ALL SELECT 'dxf' UNION ALL SELECT 'png') f WHERE NOT (c.case_id%73=0 AND f.fmt='eps')"""
_INTEG = f"""o AS ({_OUT}), g AS (SELECT case_id AS job_id, f AS format FROM case_rec CROSS JOIN (SELECT unnest(['svg','pdf','eps','dxf','png']) AS f) q),
ai AS (SELECT g.job_id, g.format, concat_ws(',', CASE WHEN byte_size IS NULL THEN 'artifact_missing' END, CASE WHEN byte_size=0 THEN 'artifact_empty' END, CASE WHEN sha256<>expected_sha256 THEN 'digest_mismatch' END, CASE WHEN NOT structural_safe THEN 'not_structurally_safe' END) AS codes FROM g LEFT JOIN o USING (job_id, format))"""


def _integrity(t: Tables) -> DataFrame:
    o = _sql(t, "case_rec", _OUT)
    return it.artifact_integrity(o, t("case_rec").select(F.col("case_id").alias("job_id")))


@query("artifact_integrity", f"WITH {_INTEG} SELECT * FROM ai")
def _(t: Tables):
    return _integrity(t).withColumn("codes", F.array_join("codes", ","))


@query("downloadable_formats", f"WITH {_INTEG} SELECT job_id, string_agg(format, ',' ORDER BY format) AS formats FROM ai WHERE codes='' GROUP BY job_id")
def _(t: Tables):
    return it.downloadable_formats(_integrity(t))


# -- report sources and sinks ----------------------------------------------------

@query("flatten_job_reports", """SELECT CONCAT(CAST(job_id AS VARCHAR), '-', CAST(ord AS VARCHAR)) AS job_id, CONCAT('u', CAST(ord AS VARCHAR)) AS user, mode AS mode_used, CASE WHEN rendered_ok THEN 'production_ready' ELSE 'needs_review' END AS status,
 round(CASE WHEN path_count%3=0 AND fidelity IS NOT NULL THEN fidelity WHEN path_count%2=0 THEN total_score ELSE edge_f1*100 END,6) AS fidelity, name AS best_candidate, CASE WHEN rendered_ok THEN 0 ELSE 1 END AS warning_count FROM cand""")
def _(t: Tables):
    c = t("cand")
    rep = F.to_json(F.struct(
        F.concat_ws("-", F.col("job_id").cast("string"), F.col("ord").cast("string")).alias("job_id"), F.concat(F.lit("u"), F.col("ord").cast("string")).alias("user"), F.col("mode").alias("mode_used"),
        F.struct(F.when(F.col("rendered_ok"), "production_ready").otherwise("needs_review").alias("status"), F.when(F.col("rendered_ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("w"))).alias("warnings"),
                 F.struct(F.when(F.expr("path_count%3=0"), F.col("fidelity")).alias("fidelity_score")).alias("metrics")).alias("quality_report"),
        F.struct(F.col("name").alias("best_candidate"), F.when(F.expr("path_count%2=0"), F.col("total_score")).alias("best_score"),
                 F.array(F.struct(F.lit("other").alias("name"), F.lit(1.0).alias("fidelity_score")), F.struct(F.col("name"), (F.col("edge_f1") * 100).alias("fidelity_score"))).alias("candidates")).alias("candidate_report"),
    ))
    return rounded(rp.flatten_job_reports(c.select(rep.alias("report"))))


@query("read_bench_results", """WITH m AS (SELECT side, CONCAT(CAST(case_id AS VARCHAR), '-', category) AS case_id, unnest(['fidelity','ssim','edge_f1','alpha_iou','delta_e00','path_count','svg_bytes','render_ms','peak_rss_mb']) AS metric,
 unnest([fidelity,ssim,edge_f1,alpha_iou,delta_e00,path_count,svg_bytes,render_ms,peak_rss_mb]) AS value FROM bench_case WHERE case_id%30<>0)
SELECT case_id, metric, round(value,6) AS value, CAST(NULL AS VARCHAR) AS error FROM m UNION ALL SELECT NULL, NULL, NULL, 'unsupported_schema' FROM bench_case WHERE case_id%30=0""")
def _(t: Tables):
    b = t("bench_case")
    metrics = F.map_from_arrays(F.array(*[F.lit(m) for m in rp.METRICS]), F.array(*rp.METRICS))
    row = F.struct(F.concat_ws("-", F.col("case_id").cast("string"), "category").alias("case_id"), F.lit("v").alias("engine_version"), metrics.alias("metrics"))
    doc = F.to_json(F.struct(F.when(F.expr("case_id%30=0"), "benchmark-results-v0").otherwise(rp.BENCH_SCHEMA).alias("schema_version"), F.array(row).alias("results")), {"ignoreNullFields": "false"})
    return rounded(rp.parse_bench_results(b.select(doc.alias("value"))))


@query("first_present", """SELECT event_id, CASE WHEN NOT json_valid(line) THEN NULL ELSE COALESCE(line::JSON->>'$.missing.path', line::JSON->>'$.expected_color_hex', line::JSON->>'$.issue_type') END AS value FROM feedback""")
def _(t: Tables):
    return t("feedback").select("event_id", rp.first_present("line", ["$.missing.path", "$.expected_color_hex", "$.issue_type"]).alias("value"))


_SHARD = """SELECT case_id, CAST(CASE WHEN case_id%35=0 THEN 7 ELSE (ROW_NUMBER() OVER (ORDER BY case_id)-1)%4 END AS INT) AS shard FROM (SELECT DISTINCT case_id FROM bench_case) z"""


@query("union_shards", """WITH e AS (SELECT DISTINCT p_partkey AS case_id FROM part), p AS (SELECT case_id, (ROW_NUMBER() OVER (ORDER BY case_id)-1)%4 AS want FROM e)
SELECT case_id, 'missing_case' AS code FROM p WHERE case_id%50=0 UNION ALL SELECT case_id, 'duplicate_case' FROM p WHERE case_id%45=0 AND case_id%50<>0
UNION ALL SELECT case_id, 'wrong_shard' FROM p WHERE case_id%50<>0 AND (CASE WHEN case_id%35=0 THEN 7 ELSE case_id%4 END)<>want UNION ALL SELECT case_id+10000000, 'unexpected_case' FROM e WHERE case_id%40=0""")
def _(t: Tables):
    e = t("part").select(F.col("p_partkey").alias("case_id"))
    shard = F.expr("CAST(CASE WHEN case_id%35=0 THEN 7 ELSE case_id%4 END AS INT)").alias("shard")
    main = e.where("case_id % 50 <> 0").select("case_id", shard)
    twice = e.where("case_id % 45 = 0 and case_id % 50 <> 0").select("case_id", shard)
    alien = e.where("case_id % 40 = 0").select((F.col("case_id") + 10000000).alias("case_id"), F.lit(0).alias("shard"))
    return rp.check_shards(rp.union_shards([main, twice, alien]), e, 4)


@query("read_checked", """SELECT job_id, CONCAT('{"owner":', owner, ',"revision":', revision, ',"state":"', state, '"}') AS payload, job_id%13<>0 AS intact FROM job""")
def _(t: Tables):
    env = rp.with_envelope(t("job"), "job_id", ["owner", "revision", "state"])
    broken = env.withColumn("sha256", F.expr("CASE WHEN job_id%13=0 THEN md5(sha256) ELSE sha256 END"))
    return rp.check_envelope(broken).select("job_id", "payload", "intact")


@query("write_content_addressed", """WITH n AS (SELECT * FROM case_rec c WHERE split<>'holdout' AND NOT EXISTS (SELECT 1 FROM case_rec h WHERE h.split='holdout' AND h.source_sha256=c.source_sha256)),
k AS (SELECT * FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY source_sha256 ORDER BY case_id)=1)
SELECT case_id, source_sha256, substring(source_sha256,1,2) AS prefix, CONCAT('objects/', substring(source_sha256,1,2), '/', source_sha256, '.', source_format) AS object_id FROM k""")
def _(t: Tables):
    r, path = t("case_rec"), scratch(t, "objects")
    old = r.where("split = 'holdout'")
    rp.write_content_addressed(old, path)
    rp.write_content_addressed(r.where("split <> 'holdout'"), path)
    stored = t.spark.read.option("basePath", path).parquet(path).withColumn("prefix", F.substring("source_sha256", 1, 2))
    return stored.join(old.select("source_sha256").distinct(), "source_sha256", "left_anti").select("case_id", "source_sha256", "prefix", "object_id")


@query("append_telemetry", """SELECT CONCAT('{"job_id":', job_id, ',"name":"', name, '","ord":', ord, ',"rendered_ok":', CASE WHEN rendered_ok THEN 'true' ELSE 'false' END, '}') AS value FROM cand""")
def _(t: Tables):
    path = scratch(t, "telemetry")
    lines = t("cand").select("job_id", "name", "ord", "rendered_ok")
    rp.append_telemetry(lines.where("ord % 2 = 0"), path)
    rp.append_telemetry(lines.where("ord % 2 <> 0"), path)
    return t.spark.read.text(path)


@query("export_report", """WITH g AS (SELECT category, COUNT(*) AS cases, COUNT(alpha_iou) AS alpha_measured FROM bench_case WHERE side='cur' GROUP BY category) SELECT CONCAT('{"category":"', category, '","cases":', cases, ',"alpha_measured":', alpha_measured, '}') AS value FROM g""")
def _(t: Tables):
    g = t("bench_case").where("side = 'cur'").groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.count("alpha_iou").alias("alpha_measured"))
    path = scratch(t, "report")
    rp.export_report(g, path)
    return t.spark.read.text(path)


@query("read_images", """WITH d AS (SELECT doc_id, doc_id%5 AS k, strlen(text) + CASE doc_id%5 WHEN 1 THEN 2 WHEN 2 THEN 24 WHEN 3 THEN 4 ELSE 12 END AS n, doc_id%256 AS w, n_chars%256 AS h FROM documents)
SELECT doc_id, CASE WHEN k=0 THEN 'corrupt_image' WHEN n>20000 THEN 'file_too_large' WHEN k=1 THEN 'unsupported_format' WHEN k=2 AND (w=0 OR h=0) THEN 'corrupt_image' WHEN k=2 AND (w>200 OR h>200 OR w*h>20000) THEN 'image_too_large' END AS reason,
 CASE k WHEN 2 THEN 'PNG' WHEN 3 THEN 'JPEG' WHEN 4 THEN 'WEBP' END AS format FROM d""")
def _(t: Tables):
    png = "concat(unhex('89504E470D0A1A0A0000000D49484452'), unhex(lpad(hex(doc_id%256),8,'0')), unhex(lpad(hex(n_chars%256),8,'0')), encode(text,'utf-8'))"
    content = f"""CASE doc_id%5 WHEN 0 THEN encode('','utf-8') WHEN 1 THEN encode(concat('zz',text),'utf-8') WHEN 2 THEN {png}
      WHEN 3 THEN concat(unhex('FFD8FFE0'), encode(text,'utf-8')) ELSE concat(encode('RIFF','utf-8'), unhex('00000000'), encode('WEBP','utf-8'), encode(text,'utf-8')) END"""
    d = t.base("documents").withColumn("content", F.expr(content))
    return im.screen_uploads(d, max_bytes=20000, max_side=200, max_pixels=20000).select("doc_id", "reason", "format")


@query("explode_pixels", "SELECT image_id, x, y, r, g, b, a FROM px")
def _(t: Tables):
    two = lambda c: F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0")
    pixel = F.concat(two("b"), two("g"), two("r"), two("a"))
    # the raster of one image is a bounded byte string (24 x 24 x 4)
    images = t("px").groupBy("image_id").agg(
        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", pixel.alias("p")))), lambda s: s["p"]), "")).alias("data")
    ).select("image_id", F.lit(24).alias("width"), F.lit(24).alias("height"), F.lit(4).alias("nChannels"), "data")
    return im.explode_pixels(images).drop("width", "height")
