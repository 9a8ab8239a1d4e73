"""Queries over feature rows, scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F


from mosaiq.operators import routing as rt
from mosaiq.plans.registry import Tables, query


def _sql(t: Tables, view: str, text: str):
    t(view).createOrReplaceTempView(view)
    return t.spark.sql(text)


_IQ = """SELECT image_id, (image_id*37)%1500+100 AS width, (image_id*53)%1200+100 AS height, (image_id*7)%150*1e0 AS blur_score, estimated_color_count, edge_density, has_gradient, image_id%3<>0 AS is_uniform_background FROM feat"""


@query("image_quality_score", f"""SELECT image_id, GREATEST(0, LEAST(100, 100 - CASE WHEN LEAST(width,height)<512 THEN 25 WHEN LEAST(width,height)<900 THEN 10 ELSE 0 END - CASE WHEN blur_score<40 THEN 30 WHEN blur_score<90 THEN 12 ELSE 0 END
 - CASE WHEN estimated_color_count>28 THEN 18 WHEN estimated_color_count>16 THEN 8 ELSE 0 END - CASE WHEN edge_density>0.18e0 THEN 12 ELSE 0 END - CASE WHEN has_gradient THEN 6 ELSE 0 END - CASE WHEN is_uniform_background THEN 0 ELSE 8 END)) AS image_quality FROM ({_IQ}) z""")
def _(t: Tables):
    return rt.image_quality_score(_sql(t, "feat", _IQ)).select("image_id", "image_quality")


_ROUTE = """SELECT image_id, estimated_color_count, flat_color_count, edge_density, (image_id*7)%150*1e0 AS blur_score, quality_score, 400+(image_id*31)%400 AS min_side, thin_ink_ratio,
 straight_edge_likelihood, corner_likelihood, has_gradient, image_id%4<>1 AS is_uniform_background, image_id%29=0 AS has_alpha_foreground, image_id%5<>2 AS has_black, image_id%7<>3 AS has_white, image_id%3=1 AS has_red,
 (image_id%45)/100e0 AS saturated_ratio, (100-image_id%45)/100e0 AS neutral_ratio, (image_id%31)/500e0 AS non_red_saturated_ratio, CAST(image_id%4 AS INT) AS vivid_hue_count, CAST(image_id%120 AS INT) AS foreground_color_count,
 (image_id%60)/1000e0 AS vivid_ratio, semantic_edge_density FROM feat"""

_ROUTE_ORACLE = f"""WITH s0 AS ({_ROUTE}),
s1 AS (SELECT *, vivid_hue_count>=3 AS vm, foreground_color_count>=90 AS rf, foreground_color_count>=28 AS cf, vivid_ratio>=0.02e0 AS ca,
 flat_color_count<=8 AND edge_density<=0.105e0 AND has_black AND has_white AND has_red AND non_red_saturated_ratio<=0.035e0 AS bwr FROM s0),
s2 AS (SELECT *, has_gradient OR (rf AND vivid_ratio>=0.08e0 AND is_uniform_background AND edge_density<=0.08e0) AS g0 FROM s1),
s3 AS (SELECT *, g0 AND NOT bwr AS g FROM s2),
s4 AS (SELECT *, flat_color_count<=10 AND NOT g AND edge_density<=0.13e0 AND blur_score>=45 AND (has_black OR has_white) AS fl0 FROM s3),
s5 AS (SELECT *, (flat_color_count<=8 AND NOT g AND edge_density<=0.105e0 AND has_black AND has_white AND has_red) OR (fl0 AND flat_color_count<=6 AND edge_density<=0.085e0 AND saturated_ratio<=0.35e0 AND has_black AND has_white) AS ge0 FROM s4),
s6 AS (SELECT *, NOT ge0 AND flat_color_count<=8 AND NOT g AND edge_density<=0.13e0 AND has_black AND has_white AND ((has_red AND non_red_saturated_ratio<=0.035e0) OR (saturated_ratio<=0.35e0 AND non_red_saturated_ratio<=0.045e0)) AND straight_edge_likelihood>=0.34e0 AND corner_likelihood>=0.28e0 AS rs FROM s5),
s7 AS (SELECT *, fl0 OR rs AS fl, ge0 OR rs AS ge FROM s6),
s8 AS (SELECT *, NOT g AND has_black AND has_white AND NOT has_red AND NOT has_alpha_foreground AND edge_density>=0.018e0 AND (flat_color_count<=4 OR (flat_color_count<=16 AND neutral_ratio>=0.82e0 AND saturated_ratio<=0.1e0)) AS la,
 flat_color_count<=3 AND NOT g AND has_black AND has_white AND NOT has_red AND edge_density<0.08e0 AND thin_ink_ratio<=0.55e0 AS sc, fl AND has_black AND has_white AND flat_color_count<=12 AND edge_density<=0.14e0 AS tl,
 flat_color_count>8 OR g OR vm OR rf OR saturated_ratio>0.38e0 OR non_red_saturated_ratio>0.045e0 OR (flat_color_count>=7 AND saturated_ratio>0.22e0 AND NOT bwr) AS cl,
 estimated_color_count>28 OR (g AND edge_density>0.11e0) OR (quality_score<45 AND estimated_color_count>16) AS cx,
 estimated_color_count>34 AND NOT has_alpha_foreground AND NOT fl AND (NOT is_uniform_background OR (g AND edge_density>0.11e0 AND straight_edge_likelihood<0.28e0)) AS p0,
 COALESCE(edge_density/GREATEST(semantic_edge_density,0.005e0)>=1.2e0 AND edge_density>=0.05e0 AND semantic_edge_density<0.12e0 AND NOT has_alpha_foreground AND NOT fl, FALSE) AS sp FROM s7),
s9 AS (SELECT *, cl AND NOT bwr AND (vm OR rf OR saturated_ratio>=0.18e0 OR flat_color_count>=10) AS rich FROM s8),
m AS (SELECT *, CASE WHEN sc AND NOT cf AND NOT ca THEN 'single_color' WHEN la AND NOT cf AND NOT ca THEN 'lineart' WHEN p0 OR sp THEN 'photo_poster' WHEN rich THEN 'logo_color' WHEN ge THEN 'geometric_logo' WHEN tl AND NOT cl THEN 'minimal_ai'
 WHEN flat_color_count<=12 AND NOT g AND edge_density<0.14e0 AND quality_score>=55 AND NOT cl AND (has_black OR has_white) THEN 'minimal_ai' ELSE 'logo_color' END AS md FROM s9)
SELECT image_id, md AS detected_type, md AS recommended_mode, g AND md<>'geometric_logo' AS gradient_flag, cl AND md<>'geometric_logo' AS likely_color_logo, ge AS likely_geometric_logo, tl AS likely_text_logo, la AS likely_line_art, sc AS likely_single_color,
 cx AS likely_photo_or_complex, sp AS semantic_photo_like, concat_ws(',', CASE WHEN min_side<512 THEN 'low_resolution' END, CASE WHEN blur_score<40 THEN 'blurry' END, CASE WHEN estimated_color_count>28 THEN 'many_colors' END, CASE WHEN g0 THEN 'gradient_detected' END,
 CASE WHEN NOT is_uniform_background AND md NOT IN ('minimal_ai','geometric_logo','single_color','lineart') THEN 'background_not_uniform' END, CASE WHEN md='photo_poster' THEN 'photo_like' END, CASE WHEN md='logo_color' AND NOT rich AND cx THEN 'complex_color' END) AS warnings FROM m"""


@query("route_mode", _ROUTE_ORACLE)
def _(t: Tables):
    return rt.route_mode(_sql(t, "feat", _ROUTE))


_VF = """SELECT image_id, CASE WHEN image_id%23=0 THEN 99 ELSE estimated_color_count END AS estimated_color_count, CASE WHEN image_id%29=0 THEN NULL ELSE flat_color_count END AS flat_color_count,
 CASE WHEN image_id%31=0 THEN 1e13 ELSE 50e0 END AS blur_score, edge_density, CASE WHEN image_id%37=0 THEN CAST('NaN' AS DOUBLE) ELSE quality_score*1e0 END AS quality_score, thin_ink_ratio, straight_edge_likelihood, corner_likelihood,
 CASE WHEN image_id%41=0 THEN NULL ELSE has_gradient END AS has_gradient, likely_geometric_logo, likely_text_logo, likely_color_logo, likely_photo_or_complex, likely_single_color, likely_line_art, semantic_photo_like, semantic_edge_density,
 CASE WHEN image_id%43=0 THEN 5e-1 ELSE edge_coherence END AS edge_coherence FROM feat"""


@query("validate_features", f"""WITH v AS ({_VF}) SELECT image_id, 'out_of_range:estimated_color_count' AS code FROM v WHERE estimated_color_count>48
UNION ALL SELECT image_id, 'missing_feature:flat_color_count' FROM v WHERE flat_color_count IS NULL UNION ALL SELECT image_id, 'out_of_range:blur_score' FROM v WHERE blur_score>1e12
UNION ALL SELECT image_id, 'nonfinite_or_invalid:quality_score' FROM v WHERE isnan(quality_score) UNION ALL SELECT image_id, 'missing_feature:has_gradient' FROM v WHERE has_gradient IS NULL
UNION ALL SELECT image_id, 'partial_optional_signal:hed' FROM v WHERE (semantic_edge_density IS NULL)<>(edge_coherence IS NULL)""")
def _(t: Tables):
    return rt.validate_features(_sql(t, "feat", _VF))


_SUPPORT = """sc AS (SELECT image_id, unnest([
 {'o':0,'m':'geometric_logo','s':0.1e0+0.4e0*CAST(likely_geometric_logo AS INT)+0.15e0*CAST(straight_edge_likelihood>=0.34e0 AS INT)+0.15e0*CAST(corner_likelihood>=0.28e0 AS INT)+0.1e0*CAST(flat_color_count<=8 AS INT)+0.1e0*CAST(NOT has_gradient AS INT)},
 {'o':1,'m':'minimal_ai','s':0.1e0+0.35e0*CAST(likely_text_logo AS INT)+0.15e0*CAST(flat_color_count<=12 AS INT)+0.1e0*CAST(NOT has_gradient AS INT)+0.1e0*CAST(quality_score>=55 AS INT)+0.1e0*CAST(NOT likely_color_logo AS INT)},
 {'o':2,'m':'logo_color','s':0.1e0+0.35e0*CAST(likely_color_logo AS INT)+0.15e0*CAST(has_gradient AS INT)+0.15e0*CAST(flat_color_count>8 AS INT)+0.1e0*CAST(likely_photo_or_complex AS INT)+0.05e0*CAST(quality_score<55 AS INT)},
 {'o':3,'m':'single_color','s':0.1e0+0.45e0*CAST(likely_single_color AS INT)+0.15e0*CAST(flat_color_count<=3 AS INT)+0.15e0*CAST(thin_ink_ratio<=0.55e0 AS INT)+0.1e0*CAST(edge_density<0.08e0 AS INT)},
 {'o':4,'m':'lineart','s':0.1e0+0.45e0*CAST(likely_line_art AS INT)+0.15e0*CAST(flat_color_count<=4 AS INT)+0.15e0*CAST(thin_ink_ratio>0.55e0 AS INT)+0.1e0*CAST(edge_density>=0.018e0 AS INT)},
 {'o':5,'m':'photo_poster','s':0.1e0+0.45e0*CAST(semantic_photo_like AS INT)+0.2e0*CAST(likely_photo_or_complex AS INT)+0.1e0*CAST(flat_color_count>28 AS INT)+0.1e0*CAST(edge_density>0.11e0 AS INT)+0.05e0*CAST(quality_score<45 AS INT)}]) AS e FROM feat),
sr AS (SELECT image_id, e.m AS mode, round(LEAST(1e0,e.s),6) AS score, e.o AS o FROM sc)"""


@query("mode_support_scores", f"""WITH {_SUPPORT}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, o) AS rank FROM sr)
SELECT a.image_id, a.mode, a.score, a.rank, round(a.score-MAX(b.score),6) AS margin FROM r a JOIN r b ON a.image_id=b.image_id AND a.mode<>b.mode GROUP BY a.image_id, a.mode, a.score, a.rank""")
def _(t: Tables):
    return rt.mode_support_scores(t("feat"))


_SUB = """SELECT job_id, ord, mode, path_count, path_count*((ord*13)%60) AS node_count, path_count%90 AS unique_colors, ord+3 AS estimated_color_count, path_count%11=0 AS has_bitmap, COALESCE(fidelity,0e0) AS edge_score,
 edge_f1*100 AS straight_edge_score, edge_f1*90 AS corner_cleanliness_score, edge_f1*80 AS axis_alignment_score, edge_f1*70 AS geometry_score FROM cand"""
_SUB_ORACLE = f"""s AS ({_SUB}), u AS (SELECT *, CASE WHEN mode='logo_color' THEN 120 ELSE 3 END AS lo, CASE WHEN mode='logo_color' THEN 2600 ELSE 600 END AS hi, mode IN ('geometric_logo','minimal_ai') AS fl FROM s),
q AS (SELECT *, CASE WHEN path_count<=0 THEN 0e0 WHEN path_count BETWEEN lo AND hi THEN 100e0 WHEN path_count<lo THEN round_even(GREATEST(45e0,100-(lo-path_count)/lo*55),2) ELSE round_even(GREATEST(0e0,100-(path_count-hi)/hi*60),2) END AS path_score,
 CASE WHEN unique_colors<=0 THEN 0e0 WHEN fl THEN CASE WHEN unique_colors<=GREATEST(6,estimated_color_count+1) THEN 100e0 ELSE GREATEST(40e0,100e0-(unique_colors-(estimated_color_count+1))*8) END
  ELSE CASE WHEN unique_colors BETWEEN 12 AND 64 THEN 100e0 WHEN unique_colors<12 THEN GREATEST(50e0,100e0-(12-unique_colors)*5) ELSE GREATEST(45e0,100e0-(unique_colors-64)*4) END END AS color_score,
 CASE WHEN path_count<=0 OR node_count<=0 THEN 0e0 WHEN fl THEN CASE WHEN node_count/path_count<=40 THEN 100e0 ELSE round_even(GREATEST(40e0,100-(node_count/path_count-40)*1.5e0),2) END WHEN node_count>=400 THEN 100e0 ELSE round_even(GREATEST(45e0,50+node_count/8e0),2) END AS detail_score,
 GREATEST(0e0, 100e0-CASE WHEN has_bitmap THEN 60 ELSE 0 END-CASE WHEN path_count=0 THEN 100 ELSE 0 END-CASE WHEN path_count>3000 THEN 20 ELSE 0 END-CASE WHEN fl AND unique_colors>8 THEN 15 ELSE 0 END) AS warning_score FROM u)"""


@query("candidate_subscores", f"WITH {_SUB_ORACLE} SELECT job_id, ord, path_score, color_score, detail_score, warning_score FROM q")
def _(t: Tables):
    return rt.candidate_subscores(_sql(t, "cand", _SUB)).select("job_id", "ord", "path_score", "color_score", "detail_score", "warning_score")


@query("weighted_total", f"""WITH {_SUB_ORACLE} SELECT job_id, ord, round(CASE mode WHEN 'geometric_logo' THEN color_score*0.16e0+edge_score*0.16e0+detail_score*0.1e0+path_score*0.08e0+warning_score*0.08e0+straight_edge_score*0.17e0+corner_cleanliness_score*0.15e0+axis_alignment_score*0.1e0
 WHEN 'minimal_ai' THEN color_score*0.25e0+edge_score*0.25e0+detail_score*0.1e0+path_score*0.15e0+warning_score*0.1e0+geometry_score*0.15e0 ELSE color_score*0.25e0+edge_score*0.3e0+detail_score*0.25e0+path_score*0.12e0+warning_score*0.08e0 END, 6) AS total FROM q""")
def _(t: Tables):
    return rt.weighted_total(rt.candidate_subscores(_sql(t, "cand", _SUB)), places=6).select("job_id", "ord", "total")


_MW = """SELECT *, CASE image_id%5 WHEN 0 THEN 'auto' ELSE 'manual' END AS trace_mode, CASE image_id%4 WHEN 0 THEN 'minimal_ai' WHEN 1 THEN 'logo_color' WHEN 2 THEN 'geometric_logo' ELSE 'centerline' END AS mode_used FROM feat"""


@query("mode_warning", f"""SELECT image_id, CASE WHEN trace_mode='auto' THEN NULL WHEN mode_used='minimal_ai' AND estimated_color_count>12 THEN 'many_colors_for_minimal' WHEN mode_used='logo_color' AND likely_geometric_logo THEN 'looks_geometric'
 WHEN mode_used='geometric_logo' AND likely_color_logo AND estimated_color_count>12 THEN 'many_colors_for_geometric' WHEN mode_used='centerline' THEN 'centerline_fallback' END AS mode_warning FROM ({_MW}) z""")
def _(t: Tables):
    return rt.mode_warning(_sql(t, "feat", _MW)).select("image_id", "mode_warning")


_QR = """SELECT job_id, ord, CASE path_count%5 WHEN 0 THEN 'photo_poster' WHEN 1 THEN 'lineart' ELSE mode END AS mode, CASE WHEN path_count%13=0 THEN path_count%5 ELSE path_count END AS path_count, path_count%70 AS unique_colors, path_count%41=0 AS has_bitmap, total_score, fidelity,
 CASE WHEN ord%2=0 THEN 1-(path_count%8)/100e0 END AS ink_recall, CASE WHEN ord%2=0 THEN 1-(path_count%6)/100e0 END AS ink_precision, path_count%9 AS component_delta, path_count%12 AS components FROM cand"""


@query("quality_report", f"""WITH z AS ({_QR}), b AS (SELECT *, mode IN ('geometric_logo','minimal_ai','lineart') AS fl, COALESCE(fidelity>=85,FALSE) AS gf, COALESCE(fidelity<78,FALSE) AS lf, ink_recall IS NOT NULL AS ms, COALESCE(ink_recall>=0.985e0,FALSE) AS sok,
 COALESCE(ink_precision<0.96e0,FALSE) AS stray, components>0 AND component_delta>GREATEST(2,FLOOR(components*0.5e0)) AS pcs FROM z),
w AS (SELECT *, ms AND (COALESCE(ink_recall<0.955e0,FALSE) OR stray OR pcs) AS broken, concat_ws(',', CASE WHEN has_bitmap THEN 'embedded_bitmap' END, CASE WHEN path_count=0 THEN 'no_paths' END, CASE WHEN mode='logo_color' AND path_count BETWEEN 1 AND 249 AND NOT gf THEN 'low_path_count' END,
 CASE WHEN mode='logo_color' AND unique_colors>64 THEN 'high_color_count' END, CASE WHEN mode<>'logo_color' AND NOT (fl AND unique_colors<=6 AND path_count>=10) AND path_count BETWEEN 1 AND 3 AND NOT gf AND NOT sok THEN 'very_low_path_count' END, CASE WHEN path_count>3000 THEN 'very_high_path_count' END,
 CASE WHEN fl AND unique_colors>8 THEN 'too_many_colors_for_flat' END, CASE WHEN lf THEN 'low_fidelity' END, CASE WHEN mode='photo_poster' THEN 'photo_product_limit' END, CASE WHEN COALESCE(ink_recall<0.985e0,FALSE) THEN 'missing_strokes' END, CASE WHEN ms AND stray THEN 'stray_marks' END, CASE WHEN ms AND pcs THEN 'fragmented_shapes' END) AS warnings FROM b)
SELECT job_id, ord, warnings, CASE WHEN path_count=0 THEN 'failed' WHEN has_bitmap OR broken OR mode='photo_poster' OR lf THEN 'needs_review' WHEN warnings='' AND (total_score>=80 OR COALESCE(fidelity>=90,FALSE)) THEN 'production_ready' WHEN warnings='' AND total_score>=70 THEN 'production_ready' ELSE 'needs_review' END AS status FROM w""")
def _(t: Tables):
    return rt.quality_report(_sql(t, "cand", _QR)).select("job_id", "ord", F.array_join("warnings", ",").alias("warnings"), "status")


_AG = """SELECT side, case_id, CASE category WHEN 'logos' THEN 'clean_logo' WHEN 'technical' THEN 'lineart' WHEN 'seals' THEN 'geometric' WHEN 'gradients' THEN 'photo' ELSE 'illustration' END AS image_class, CAST(path_count AS INT)%3 AS comp_delta, CAST(path_count AS INT)%2 AS hole_delta,
 (1-ssim)/10 AS seam_ratio, delta_e00 AS de00_p95, delta_e00*1.5e0 AS worst_face_de00, ssim, edge_f1, CASE WHEN case_id%2=0 THEN edge_f1-0.1e0 END AS min_component_iou, alpha_iou, 1-ssim AS alpha_mae, category='transparent' AS has_alpha, CASE WHEN case_id%3=0 THEN 0.999e0 END AS baseline_ssim,
 CASE WHEN case_id%3=0 THEN 0.0001e0 END AS baseline_seam_ratio, CASE WHEN case_id%4<>1 THEN ssim END AS white_ssim, CASE WHEN case_id%5<>1 THEN 1-edge_f1 END AS white_mae, edge_f1 AS black_ssim, 1-ssim AS black_mae, ssim AS checker_ssim, 1-ssim AS checker_mae FROM bench_case"""


def _lim(name: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v[name])}e0" for k, v in rt.GATE_THRESHOLDS.items())
    return f"(CASE image_class {cases} END)"


_BG = ", ".join(
    f"CASE WHEN has_alpha AND alpha_iou IS NOT NULL AND COALESCE({bg}_ssim,0e0)<{_lim('alpha_background_ssim_min')} THEN 'alpha_{bg}_ssim_below_min' END, CASE WHEN has_alpha AND alpha_iou IS NOT NULL AND COALESCE({bg}_mae,1e0)>{_lim('alpha_background_mae_max')} THEN 'alpha_{bg}_mae_above_max' END"
    for bg in ("white", "black", "checker")
)
_GATE = f"""g AS (SELECT side, case_id, concat_ws(',', CASE WHEN image_class IN ('clean_logo','lineart','geometric') AND comp_delta>0 THEN 'topology_component_delta' END, CASE WHEN image_class IN ('clean_logo','lineart','geometric') AND hole_delta>0 THEN 'topology_hole_delta' END,
 CASE WHEN seam_ratio>LEAST({_lim('seam_ratio')}, COALESCE(baseline_seam_ratio+0.0005e0, 9)) THEN 'seam_gap' END, CASE WHEN ssim<GREATEST({_lim('ssim_min')}, COALESCE(baseline_ssim-0.002e0, 0)) THEN 'ssim_below_min' END, CASE WHEN has_alpha AND alpha_iou<{_lim('alpha_iou_min')} THEN 'alpha_iou_below_min' END,
 CASE WHEN has_alpha AND alpha_mae>{_lim('alpha_mae_max')} THEN 'alpha_mae_above_max' END, {_BG}) AS hard_codes, concat_ws(',', CASE WHEN de00_p95>{_lim('de00_p95')} THEN 'color_de00_p95' END, CASE WHEN worst_face_de00>{_lim('worst_face_de00')} THEN 'worst_face_de00' END,
 CASE WHEN edge_f1<{_lim('edge_f1_min')} THEN 'edge_f1_below_min' END, CASE WHEN min_component_iou<{_lim('min_component_iou')} THEN 'component_iou_below_min' END) AS soft_codes, CASE WHEN has_alpha AND alpha_iou IS NULL THEN 'alpha_fidelity' ELSE '' END AS unmeasured FROM ({_AG}) z),
gv AS (SELECT *, CASE WHEN hard_codes<>'' THEN 'failed' WHEN unmeasured<>'' OR soft_codes<>'' THEN 'needs_review' ELSE 'production_ready' END AS verdict FROM g)"""


@query("artifact_gate", f"WITH {_GATE} SELECT * FROM gv")
def _(t: Tables):
    g = rt.artifact_gate(_sql(t, "bench_case", _AG))
    return g.select("side", "case_id", *[F.array_join(c, ",").alias(c) for c in ("hard_codes", "soft_codes", "unmeasured")], "verdict")


_QC = "SELECT side, case_id, repeat_index, ssim AS fidelity, CASE WHEN case_id%7=0 THEN NULL ELSE edge_f1 END AS edge_f1, delta_e00 AS mean_delta_e, (1-ssim)/5 AS banding_ratio FROM bench"


@query("quality_contract", f"SELECT side, case_id, repeat_index, COALESCE(fidelity>=0.98e0 AND edge_f1>=0.96e0 AND mean_delta_e<=2.8e0 AND banding_ratio<=0.008e0, FALSE) AS accepted FROM ({_QC}) z")
def _(t: Tables):
    return rt.quality_contract(_sql(t, "bench", _QC)).select("side", "case_id", "repeat_index", "accepted")


_FV = """SELECT job_id, ord, CASE WHEN path_count%7=0 THEN 'failed' WHEN path_count%3=0 THEN 'needs_review' ELSE 'production_ready' END AS verdict, CASE WHEN ord%2=0 THEN 'auto' ELSE 'manual' END AS requested_mode,
 CASE WHEN path_count%4=0 THEN 'needs_review' ELSE 'accepted' END AS decision, CASE WHEN path_count%11=0 THEN 'failed' WHEN path_count%5=0 THEN 'needs_review' ELSE 'production_ready' END AS quality_status, path_count%6=0 AS coded FROM cand"""


@query("final_verdict", f"""WITH z AS ({_FV}), l AS (SELECT *, requested_mode='auto' AND decision='needs_review' AS rv FROM z), a AS (SELECT *, CASE WHEN rv AND verdict='production_ready' THEN 'needs_review' ELSE verdict END AS artifact_verdict FROM l)
SELECT job_id, ord, artifact_verdict, concat_ws(',', CASE WHEN coded THEN 'analyzer_auto_review' ELSE 'seam' END, CASE WHEN rv AND NOT coded THEN 'analyzer_auto_review' END) AS soft_codes,
 CASE WHEN quality_status='failed' THEN 'failed' WHEN artifact_verdict IN ('failed','needs_review') OR quality_status='needs_review' THEN 'needs_review' ELSE 'production_ready' END AS final_verdict FROM a""")
def _(t: Tables):
    d = _sql(t, "cand", _FV).withColumn("soft_codes", F.array(F.when(F.col("coded"), "analyzer_auto_review").otherwise("seam")))
    return rt.final_verdict(d).select("job_id", "ord", "artifact_verdict", F.array_join("soft_codes", ",").alias("soft_codes"), "final_verdict")
