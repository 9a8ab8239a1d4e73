"""Queries over candidates: ranking, selection and shadow comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.functions.columns import rounded
from mosaiq.operators import selection as sel
from mosaiq.plans.registry import Tables, query

_KEY = "round_even(COALESCE(fidelity,0),1) DESC, path_count, total_score DESC, ord"
_LIVE = "rendered_ok AND fidelity IS NOT NULL"
_K1 = f"k1 AS (SELECT job_id, name AS chosen FROM cand WHERE {_LIVE} QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY {_KEY})=1)"

_GEO_SQL = """SELECT job_id, CASE ord WHEN 1 THEN 'geo_clean' WHEN 2 THEN 'geo_standard' WHEN 3 THEN 'geo_detail' WHEN 4 THEN 'geo_contour' WHEN 5 THEN 'geo_mixed' ELSE CONCAT('geo_', CAST(ord AS VARCHAR(9))) END AS name,
  ord, engine, mode, fidelity, edge_f1, path_count, total_score, rendered_ok, CASE WHEN path_count%7=0 THEN 4 ELSE 5 END AS unique_colors, path_count%20+70e0 AS geometry_score,
  (path_count*3)%30+60e0 AS corner_score, (path_count*7)%30+60e0 AS axis_score, (path_count*11)%25+60e0 AS straight_score FROM cand"""


def _geo_cte(where: str = "") -> str:
    return f"""c AS (SELECT * FROM ({_GEO_SQL}) z {where}),
v AS (SELECT *, unique_colors >= MAX(unique_colors) OVER w AND path_count >= GREATEST(1, FLOOR(0.4e0*MAX(path_count) OVER w)) AS ok FROM c WINDOW w AS (PARTITION BY job_id)),
vv AS (SELECT * FROM v QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY job_id)),
raw AS (SELECT * FROM vv QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY total_score DESC, ord)=1),
near AS (SELECT vv.* FROM vv JOIN raw USING (job_id) WHERE raw.total_score-vv.total_score<=4),
pref AS (SELECT *, CASE name WHEN 'geo_standard' THEN 0 WHEN 'geo_detail' THEN 1 WHEN 'geo_mixed' THEN 2 WHEN 'geo_clean' THEN 3 WHEN 'geo_contour' THEN 4 END AS pr FROM near),
c1 AS (SELECT * FROM (SELECT * FROM pref UNION ALL SELECT *, 9 FROM raw) q WHERE pr IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY pr)=1),
cl AS (SELECT * FROM near WHERE name='geo_clean'),
c2 AS (SELECT c1.job_id, COALESCE(cl.name<>c1.name AND cl.corner_score>=c1.corner_score+8 AND cl.axis_score>=c1.axis_score+8 AND cl.straight_score>=c1.straight_score, FALSE) AS corner,
  c1.name AS n1, c1.fidelity AS f1, c1.rendered_ok AS r1, c1.geometry_score AS g1, c1.corner_score AS k1, cl.name AS n2, cl.fidelity AS f2, cl.rendered_ok AS r2, cl.geometry_score AS g2, cl.corner_score AS k2 FROM c1 LEFT JOIN cl USING (job_id)),
c3 AS (SELECT job_id, corner, n1, CASE WHEN corner THEN n2 ELSE n1 END AS n, CASE WHEN corner THEN CASE WHEN r2 THEN f2 END ELSE CASE WHEN r1 THEN f1 END END AS f, CASE WHEN corner THEN g2 ELSE g1 END AS g, CASE WHEN corner THEN k2 ELSE k1 END AS k FROM c2),
top AS (SELECT * FROM vv WHERE {_LIVE} QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY fidelity DESC, ord)=1),
gd AS (SELECT c3.*, raw.name AS raw_best, top.name AS tn, COALESCE(top.name<>n AND top.fidelity>f+1.5e0 AND top.geometry_score>=g-5 AND top.corner_score>=k-5, FALSE) AS guard FROM c3 JOIN raw USING (job_id) LEFT JOIN top USING (job_id)),
geo AS (SELECT job_id, raw_best, CASE WHEN guard THEN tn ELSE n END AS chosen, CASE WHEN guard THEN 'fidelity_guard' WHEN corner THEN 'corner_cleanliness_preference' WHEN n1=raw_best THEN 'highest_total_score' ELSE 'near_score_geometric_preference' END AS reason FROM gd)"""


def _geo(t: Tables) -> DataFrame:
    t("cand").createOrReplaceTempView("cand")
    return t.spark.sql(_GEO_SQL)


@query("rank_candidates", f"WITH {_K1}, n AS (SELECT job_id, COUNT(*) AS rendered FROM cand WHERE {_LIVE} GROUP BY job_id) SELECT job_id, chosen, rendered FROM k1 JOIN n USING (job_id)")
def _(t: Tables):
    return sel.rank_candidates(t("cand"))


_NEAR = """rb AS (SELECT job_id, name AS raw_best, total_score AS best FROM {src} QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY total_score DESC, ord)=1),
np AS (SELECT job_id, name FROM {src} JOIN rb USING (job_id) WHERE best-total_score<=2 AND name IN ('c3','c1') QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY CASE name WHEN 'c3' THEN 0 ELSE 1 END)=1),
nr AS (SELECT rb.job_id, raw_best, COALESCE(np.name, raw_best) AS chosen, CASE WHEN COALESCE(np.name, raw_best)=raw_best THEN 'highest_total_score' ELSE 'near_score_preference' END AS reason FROM rb LEFT JOIN np USING (job_id))"""


@query("near_score_preference", f"WITH {_NEAR.format(src='cand')} SELECT * FROM nr")
def _(t: Tables):
    return sel.near_score_preference(t("cand"), ["c3", "c1"])


@query("geometric_selection", f"WITH {_geo_cte()} SELECT * FROM geo")
def _(t: Tables):
    return sel.geometric_selection(_geo(t))


@query("select_best", f"""WITH {_geo_cte("WHERE mode='geometric_logo'")}, o AS (SELECT * FROM cand WHERE mode<>'geometric_logo'), {_NEAR.format(src='o')}, {_K1}
SELECT nr.job_id, raw_best, CASE WHEN m.mode='logo_color' AND k1.chosen IS NOT NULL THEN k1.chosen ELSE nr.chosen END AS chosen, CASE WHEN m.mode='logo_color' AND k1.chosen IS NOT NULL THEN 'highest_fidelity' ELSE nr.reason END AS reason
FROM nr JOIN (SELECT DISTINCT job_id, mode FROM o) m USING (job_id) LEFT JOIN k1 USING (job_id) UNION ALL SELECT * FROM geo""")
def _(t: Tables):
    geo, plain = _geo(t), t("cand")
    both = plain.where("mode <> 'geometric_logo'").unionByName(geo.where("mode = 'geometric_logo'"), allowMissingColumns=True)
    return sel.select_best(both, ["c3", "c1"])


@query("editability_preference", f"""WITH l AS (SELECT * FROM cand WHERE {_LIVE}), t AS (SELECT job_id, name AS tn, fidelity AS tf, path_count AS tp, edge_f1 AS te FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY {_KEY})=1),
e AS (SELECT l.*, tn, tp FROM l JOIN t USING (job_id) WHERE fidelity >= CASE WHEN tf>=78 THEN GREATEST(tf-2.5e0,78) ELSE tf-2.5e0 END AND edge_f1>=te-0.03e0 QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY path_count, ord)=1)
SELECT job_id, CASE WHEN name<>tn AND path_count<=0.5e0*GREATEST(1,tp) THEN name ELSE tn END AS chosen, CASE WHEN name<>tn AND path_count<=0.5e0*GREATEST(1,tp) THEN 'editability_preference' ELSE 'highest_fidelity' END AS reason FROM e""")
def _(t: Tables):
    return sel.editability_preference(t("cand"))


_FAMILY = "CASE WHEN engine='gradient' THEN 'gradient' WHEN engine='vtracer' THEN 'region' ELSE engine END"
_CODES_SQL = """SELECT *, CASE WHEN path_count%17=0 THEN 'seam_gap,broken' ELSE '' END AS hard, CASE WHEN path_count%19=0 THEN 'ssim' ELSE '' END AS miss FROM cand"""


def _views(t: Tables) -> DataFrame:
    t("cand").createOrReplaceTempView("cand")
    split = lambda c: F.filter(F.split(c, ","), lambda s: s != "")
    df = t.spark.sql(_CODES_SQL).withColumn("hard_fail_codes", split("hard")).withColumn("unmeasured_required", split("miss"))
    return sel.normalize_candidates(df)


@query("normalize_candidates", f"""SELECT job_id, ord, name, {_FAMILY} AS family, round(COALESCE(fidelity,0e0),6) AS fidelity, round(total_score,6) AS total_score, round(edge_f1,6) AS edge_f1, path_count, rendered_ok,
  CASE WHEN hard<>'' THEN 'broken,seam_gap' ELSE '' END AS hard_fail_codes, miss AS unmeasured_required FROM ({_CODES_SQL}) z""")
def _(t: Tables):
    v = _views(t).withColumn("hard_fail_codes", F.array_join("hard_fail_codes", ",")).withColumn("unmeasured_required", F.array_join("unmeasured_required", ","))
    return rounded(v)


_ELIG = f"""w AS (SELECT job_id, ord, name, {_FAMILY} AS family, COALESCE(fidelity,0e0) AS fidelity, total_score, edge_f1, path_count, rendered_ok, hard, miss FROM ({_CODES_SQL}) z),
el AS (SELECT * FROM w WHERE rendered_ok AND fidelity>=78 AND hard='' AND miss='')"""
_SKEY = "round_even(fidelity,4) DESC, round_even(edge_f1,5) DESC, path_count, round_even(total_score,4) DESC, name DESC"


@query("reject_reasons", f"""WITH {_ELIG} SELECT job_id, name, concat_ws(',', CASE WHEN NOT rendered_ok THEN 'render_failed' END, CASE WHEN fidelity<78 THEN 'fidelity_below_floor' END, CASE WHEN hard<>'' THEN 'broken,seam_gap' END, CASE WHEN miss<>'' THEN CONCAT('unmeasured:', miss) END) AS reasons FROM w""")
def _(t: Tables):
    return sel.reject_reasons(_views(t)).select("job_id", "name", F.array_join("reasons", ",").alias("reasons"))


@query("pareto_frontier", f"""WITH {_ELIG} SELECT job_id, name FROM el b WHERE NOT EXISTS (SELECT 1 FROM el a WHERE a.job_id=b.job_id AND a.fidelity>=b.fidelity AND a.edge_f1>=b.edge_f1 AND a.path_count<=b.path_count
  AND (a.fidelity>b.fidelity OR a.edge_f1>b.edge_f1 OR a.path_count<b.path_count))""")
def _(t: Tables):
    return sel.pareto_frontier(sel.eligible(_views(t)))


_WIN = f"""tp AS (SELECT job_id, name AS tn, fidelity AS tf, edge_f1 AS te, path_count AS tpc FROM el QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY {_SKEY})=1),
sm AS (SELECT el.job_id, name FROM el JOIN tp USING (job_id) WHERE fidelity>=GREATEST(78,tf-1.5e0) AND edge_f1>=te-0.02e0 AND path_count<=GREATEST(1,FLOOR(tpc*0.7e0)) QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY path_count, fidelity DESC, edge_f1 DESC, total_score DESC, name DESC)=1),
wn AS (SELECT tp.job_id, COALESCE(sm.name, tn) AS winner, CASE WHEN COALESCE(sm.name, tn)<>tn THEN 'safe_editability_preference' ELSE 'highest_quality' END AS reason FROM tp LEFT JOIN sm USING (job_id))"""


@query("safe_simpler_winner", f"WITH {_ELIG}, {_WIN} SELECT * FROM wn")
def _(t: Tables):
    return sel.safe_simpler_winner(sel.eligible(_views(t)))


@query("family_best", f"WITH {_ELIG} SELECT job_id, family, name FROM el QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id, family ORDER BY {_SKEY})=1")
def _(t: Tables):
    return sel.family_best(sel.eligible(_views(t)))


@query("shadow_compare", f"""WITH {_ELIG}, {_WIN}, {_K1} SELECT COALESCE(k1.job_id, wn.job_id) AS job_id, k1.chosen AS production, winner AS shadow,
  CASE WHEN k1.chosen=winner THEN 'agreement' WHEN winner IS NULL THEN 'shadow_no_winner' ELSE 'disagreement' END AS decision FROM k1 FULL OUTER JOIN wn ON k1.job_id=wn.job_id""")
def _(t: Tables):
    prod = sel.rank_candidates(t("cand")).select("job_id", F.col("chosen").alias("production"))
    return sel.shadow_compare(prod, sel.safe_simpler_winner(sel.eligible(_views(t))))


@query("best_refined", f"""WITH b AS (SELECT job_id, name, COALESCE(fidelity,0e0) AS f, rendered_ok, path_count, total_score, 0 AS ord FROM cand WHERE ord=1),
p AS (SELECT job_id, name, f, path_count, total_score, ord, TRUE AS base FROM b UNION ALL SELECT job_id, name, fidelity, path_count, total_score, ord, FALSE FROM cand WHERE ord>1 AND {_LIVE}),
w AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY round_even(f,1) DESC, path_count, total_score DESC, ord)=1)
SELECT b.job_id, CASE WHEN NOT rendered_ok OR b.f>=99 THEN b.name ELSE w.name END AS winner, CASE WHEN NOT rendered_ok OR b.f>=99 THEN FALSE ELSE NOT w.base END AS applied,
  round_even(b.f,2) AS base_fidelity, round_even(CASE WHEN NOT rendered_ok OR b.f>=99 THEN b.f ELSE w.f END,2) AS refined_fidelity FROM b JOIN w USING (job_id)""")
def _(t: Tables):
    c = t("cand")
    return sel.best_refined(c.where("ord = 1"), c.where("ord > 1"))


@query("candidate_report", """WITH a AS (SELECT job_id, name FROM cand WHERE path_count%5<>0), s AS (SELECT job_id, name, fidelity, total_score FROM cand WHERE rendered_ok)
SELECT COALESCE(a.job_id, s.job_id) AS job_id, COALESCE(a.name, s.name) AS name, round(fidelity,6) AS fidelity, round(total_score,6) AS total_score,
  CASE WHEN a.job_id IS NULL THEN 'late_variant' WHEN s.job_id IS NULL THEN 'failed' ELSE 'scored' END AS state FROM a FULL OUTER JOIN s ON a.job_id=s.job_id AND a.name=s.name""")
def _(t: Tables):
    c = t("cand")
    return rounded(sel.candidate_report(c.where("path_count % 5 <> 0"), c.where("rendered_ok")))
