"""Fixture views over the driver's tables, shared by Spark and the SQL oracle.

``{R:n}`` is a one-column table ``v`` of 0..n-1 and ``{AT}`` the embedding
element access; both differ between engines.  Rasters are generated for every
supplier, so their size grows with the input table.
"""

from __future__ import annotations

import re

VIEWS = {
    "px": """
SELECT image_id, x, y, label,
  LEAST(255, GREATEST(0, CASE label WHEN 0 THEN 255 WHEN 1 THEN 230 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 40 END - (x*7+y*3+image_id)%5)) AS r,
  LEAST(255, GREATEST(0, CASE label WHEN 0 THEN 255 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 20 ELSE 170 END - (x*3+y*5+image_id)%5)) AS g,
  LEAST(255, GREATEST(0, CASE label WHEN 0 THEN 255 WHEN 1 THEN 40 WHEN 2 THEN 200 WHEN 3 THEN 20 ELSE 80 END - (x+y*11+image_id)%5)) AS b,
  CASE WHEN x=0 OR y=0 THEN 0 WHEN (x+y+image_id)%11=0 THEN 128 ELSE 255 END AS a
FROM (SELECT s.s_suppkey AS image_id, CAST(nx.v AS INT) AS x, CAST(ny.v AS INT) AS y,
  CASE WHEN (nx.v-12)*(nx.v-12)+(ny.v-12)*(ny.v-12) < (4+s.s_suppkey%5)*(4+s.s_suppkey%5) THEN 4
       ELSE CAST((FLOOR(nx.v/6e0)+FLOOR(ny.v/8e0)+s.s_suppkey)%4 AS INT) END AS label
  FROM supplier s CROSS JOIN {R:24} nx CROSS JOIN {R:24} ny) t""",
    "px_pair": """
SELECT p.image_id, p.x, p.y, p.label, p.r, p.g, p.b, p.a,
  CASE WHEN hit THEN 255-p.r ELSE p.r END AS rr, CASE WHEN hit THEN 255-p.g ELSE p.g END AS rg,
  CASE WHEN hit THEN 255-p.b ELSE p.b END AS rb, CASE WHEN p.image_id%7=0 THEN 255 ELSE p.a END AS ra
FROM (SELECT *, (x*5+y*7+image_id)%23=0 AS hit FROM px) p""",
    "px64_pair": """
SELECT s.s_suppkey AS image_id, CAST(nx.v AS INT) AS x, CAST(ny.v AS INT) AS y,
  (CAST(FLOOR(nx.v/8e0) AS BIGINT)*24+(nx.v%8)*3+CAST(FLOOR(ny.v/8e0) AS BIGINT)*5+s.s_suppkey)%256 AS v,
  CASE WHEN ((nx.v%8)*5+(ny.v%8)*7+s.s_suppkey)%23=0
       THEN 255-(CAST(FLOOR(nx.v/8e0) AS BIGINT)*24+(nx.v%8)*3+CAST(FLOOR(ny.v/8e0) AS BIGINT)*5+s.s_suppkey)%256
       ELSE (CAST(FLOOR(nx.v/8e0) AS BIGINT)*24+(nx.v%8)*3+CAST(FLOOR(ny.v/8e0) AS BIGINT)*5+s.s_suppkey)%256 END AS rv
FROM supplier s CROSS JOIN {R:64} nx CROSS JOIN {R:64} ny""",
    "cand": """
SELECT job_id, CONCAT('c', CAST(ord AS VARCHAR(9))) AS name, ord, engine, mode, fidelity, edge_f1, path_count, total_score, rendered_ok
FROM (SELECT l_orderkey AS job_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) AS ord,
  CASE l_returnflag WHEN 'R' THEN 'vtracer' WHEN 'A' THEN 'gradient' ELSE 'opencv_contour' END AS engine,
  CASE l_orderkey%3 WHEN 0 THEN 'logo_color' WHEN 1 THEN 'geometric_logo' ELSE 'minimal_ai' END AS mode,
  CASE WHEN l_tax=0 THEN NULL ELSE 50+l_quantity END AS fidelity, 1-l_discount AS edge_f1,
  CAST(FLOOR(l_extendedprice/100) AS INT) AS path_count, 60+l_tax*400 AS total_score, l_linestatus='O' AS rendered_ok FROM lineitem) t""",
    "bench": """
SELECT CASE WHEN (k-1)%6<3 THEN 'base' ELSE 'cur' END AS side, case_id, category, CAST((k-1)%3+1 AS INT) AS repeat_index,
  CONCAT(md5(CAST(CASE WHEN case_id%50=0 THEN case_id+k ELSE case_id END AS VARCHAR(20))), md5('artifact')) AS artifact_sha256,
  fidelity, ssim, edge_f1, alpha_iou, delta_e00, path_count, svg_bytes, render_ms, peak_rss_mb
FROM (SELECT *, part_id*1000+CAST(FLOOR((k-1)/6e0) AS BIGINT) AS case_id FROM (SELECT CAST(l_partkey AS BIGINT) AS part_id, CASE p_size%8 WHEN 0 THEN 'transparent' WHEN 1 THEN 'logos' WHEN 2 THEN 'seals' WHEN 3 THEN 'technical' WHEN 4 THEN 'signatures' WHEN 5 THEN 'gradients' WHEN 6 THEN 'low_resolution' ELSE 'multilingual' END AS category,
  ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS k,
  50+l_quantity AS fidelity, 1-l_discount/2 AS ssim, 1-l_tax/2 AS edge_f1, CASE WHEN l_returnflag='N' THEN NULL ELSE 1-l_discount END AS alpha_iou,
  l_discount*100 AS delta_e00, CAST(FLOOR(l_extendedprice/100) AS DOUBLE) AS path_count, CAST(FLOOR(l_extendedprice) AS DOUBLE) AS svg_bytes, l_extendedprice/10 AS render_ms, l_quantity*10 AS peak_rss_mb
  FROM lineitem JOIN part ON p_partkey=l_partkey) s) t""",
    "bench_case": """
SELECT side, case_id, category, MIN(fidelity) AS fidelity, MIN(ssim) AS ssim, MIN(edge_f1) AS edge_f1, MIN(alpha_iou) AS alpha_iou,
  MAX(delta_e00) AS delta_e00, MAX(path_count) AS path_count, MAX(svg_bytes) AS svg_bytes, MAX(render_ms) AS render_ms, MAX(peak_rss_mb) AS peak_rss_mb
FROM bench GROUP BY side, case_id, category""",
    "retry": """
SELECT case_id, repeat_index, CASE WHEN (case_id+repeat_index)%9=0 THEN 2 ELSE 1 END AS attempt_count,
  (case_id+repeat_index)%9=0 AS retried, CASE WHEN case_id%97=0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN (case_id+repeat_index)%9<>0 THEN NULL WHEN case_id%2=0 THEN 'TimeoutError' ELSE 'quality_threshold_failure' END AS retry_class
FROM bench WHERE side='cur'""",
    "job": """
SELECT o_orderkey AS job_id, o_custkey AS owner, o_orderdate AS updated_at, CAST(FLOOR(o_totalprice) AS BIGINT) AS bytes,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'failed' END AS state,
  o_orderkey%5 AS revision, o_orderkey%17=0 AS pinned, CONCAT(md5(CAST(o_orderkey AS VARCHAR(20))), md5(o_orderstatus)) AS sha256 FROM orders""",
    "attempt": """
SELECT event_id, event_type AS namespace, user_id AS key_id, ts, value FROM events""",
    "session": """
SELECT event_id AS session_id, user_id, ts AS created_at, ts + INTERVAL '1' HOUR AS expires_at,
  CASE WHEN event_id%4=0 THEN ts + INTERVAL '20' MINUTE ELSE NULL END AS revoked_at FROM events WHERE event_type='signup'""",
    "feedback": """
SELECT event_id, ts, CASE WHEN event_id%29=0 THEN '{broken' ELSE CONCAT('{"job_id":"', md5(CAST(user_id AS VARCHAR(20))), '","issue_type":"',
  CASE event_type WHEN 'view' THEN 'color_deviation' WHEN 'click' THEN 'edge_distortion' WHEN 'error' THEN 'missing_detail' WHEN 'signup' THEN 'other' ELSE 'refund' END,
  '","expected_color_hex":"#', SUBSTRING(md5(CAST(event_id AS VARCHAR(20))),1,6), '","actual_color_hex":"#', SUBSTRING(md5(CAST(event_id AS VARCHAR(20))),7,6), '"}') END AS line FROM events""",
    "feat": """
SELECT p_partkey AS image_id, p_size%40+1 AS estimated_color_count, p_size%16+1 AS flat_color_count, (p_partkey%200)/1000e0 AS edge_density,
  (p_partkey*13)%101 AS quality_score, (p_partkey%100)/100e0 AS thin_ink_ratio, (p_partkey%90)/90e0 AS straight_edge_likelihood, (p_partkey%70)/70e0 AS corner_likelihood,
  p_partkey%5=0 AS has_gradient, p_partkey%3=0 AS likely_geometric_logo, p_partkey%4=0 AS likely_text_logo, p_partkey%7<3 AS likely_color_logo, p_partkey%11=0 AS likely_photo_or_complex,
  p_partkey%13=0 AS likely_single_color, p_partkey%6=0 AS likely_line_art, p_partkey%17=0 AS semantic_photo_like,
  CASE WHEN p_partkey%2=0 THEN NULL ELSE (p_partkey%50)/100e0 END AS semantic_edge_density, CASE WHEN p_partkey%2=0 THEN NULL ELSE 5e-1 END AS edge_coherence FROM part""",
    "calib": """
SELECT l.doc_id AS case_id, CASE WHEN quality=1 THEN 'logo_color' ELSE 'lineart' END AS label,
  CASE WHEN (quality+toxic+l.doc_id)%4=0 THEN 'lineart' ELSE 'logo_color' END AS recommended_mode,
  CASE WHEN n_chars%3=0 THEN 'needs_review' ELSE 'accepted' END AS decision_status, (n_chars%1001)/1000e0 AS confidence,
  ((l.doc_id*37)%200-50)/100e0 AS runner_up_margin FROM labels l JOIN documents d ON d.doc_id=l.doc_id""",
    "manifest": """
SELECT 'base' AS side, doc_id AS case_id, md5(text) AS source_sha FROM documents WHERE doc_id%7<>0
UNION ALL SELECT 'cur', doc_id, CASE WHEN doc_id%11=0 THEN md5(source) ELSE md5(text) END FROM documents WHERE doc_id%5<>0""",
    "case_rec": """
SELECT doc_id AS case_id, lang AS category, CASE doc_id%5 WHEN 0 THEN 'holdout' WHEN 1 THEN 'qualification' ELSE 'calibration' END AS split,
  CONCAT(md5(text), md5('source')) AS source_sha256, CASE WHEN doc_id%19=0 THEN 'unknown' ELSE 'cc0' END AS license,
  CASE doc_id%4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' ELSE 'bmp' END AS source_format,
  n_chars AS file_bytes, doc_id%3000+1 AS width, n_chars%3000+1 AS height, doc_id%23=0 AS contains_public_pii FROM documents""",
    "curve": """
SELECT e.vec_id AS path_id, CAST(s.v AS INT) AS seq, s.v*4e0 AS x, 64*CAST({AT} AS DOUBLE) AS y, e.vec_id%2=0 AS closed
FROM embeddings e CROSS JOIN {R:64} s""",
    "markup": """
SELECT p_partkey AS doc_id, CONCAT(CASE WHEN p_partkey%31=0 THEN '<html>' ELSE '<svg xmlns="http://www.w3.org/2000/svg"' END,
  CASE WHEN p_partkey%31=0 THEN '' WHEN p_partkey%13=0 THEN '>' ELSE ' viewBox="0 0 24 24">' END,
  CASE WHEN p_partkey%5=0 THEN '<defs><linearGradient id="g1"/></defs><path fill="url(#g1)" d="M0 0 L9 9 Z"/>' ELSE '' END,
  CASE WHEN p_partkey%7=0 THEN '<image href="data:image/png;base64,AA"/>' ELSE '' END,
  CASE WHEN p_partkey%11=0 THEN '<rect onclick="x()"/>' ELSE '' END,
  CASE WHEN p_partkey%17=0 THEN '<use href="http://example.org/a"/>' ELSE '' END,
  CASE WHEN p_partkey%19=0 THEN '<path d="M NaN 0"/>' ELSE '' END,
  CASE WHEN p_partkey%23=0 THEN '<style>@import "x.css";</style>' ELSE '' END,
  CASE WHEN p_partkey%29=0 THEN CONCAT('<path d=', chr(39), 'M1 1 L2 2', chr(39), '/>') ELSE '' END,
  CASE WHEN p_partkey%37=0 THEN '<rect fill="url(#gone)"/>' ELSE '' END,
  CASE WHEN p_partkey%41=0 THEN '<meshGradient id="m"/><rect fill="url(#m)"/>' ELSE '' END,
  REPEAT(CONCAT('<path fill="#', SUBSTRING(md5(p_brand),1,6), '" d="M0 0 C1 1 2 2 3 3 L4 4 Z"/>'), CAST(p_size AS INT)),
  CASE WHEN p_partkey%31=0 THEN '</html>' ELSE '</svg>' END) AS text FROM part""",
}

_RANGE = re.compile(r"\{R:(\d+)\}")


def spark_text(name: str) -> str:
    # a range, whose rows Spark counts into its estimates: an exploded array keeps the estimate of one row, and tables of
    # pixels that seem as small as the file behind them are broadcast whole through the driver
    text = _RANGE.sub(lambda m: f"(SELECT CAST(id AS INT) AS v FROM range(0, {m[1]}, 1, 1))", VIEWS[name])
    return text.replace("{AT}", "element_at(e.embedding, s.v+1)")


def duck_text(name: str) -> str:
    text = _RANGE.sub(lambda m: f"(SELECT unnest(range({m[1]})) AS v)", VIEWS[name])
    return text.replace("{AT}", "e.embedding[s.v+1]")


def needed(sql: str) -> list[str]:
    """Fixture views that ``sql`` mentions, with their own inputs first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"(?i)\b(from|join)\s+{name}\b", text):
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found
