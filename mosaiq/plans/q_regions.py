"""Queries over region graphs, boundaries and ordered paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.functions import color as cl
from mosaiq.functions.columns import rounded
from mosaiq.operators import paths as pt, pixels as px, regions as rg, stencil as st
from mosaiq.plans import sqlkit as k
from mosaiq.plans.registry import Tables, query
from mosaiq.session import cut_lineage

_CC = k.components("cc", "px", "label", 4)


def regions_of(t: Tables) -> DataFrame:
    # read several times by the graph operators, so it is materialised once
    return cut_lineage(rg.components(t("px").select("image_id", "x", "y", "label")))


@query("connected_components", f"WITH RECURSIVE {_CC} SELECT image_id, x, y, label, region FROM cc")
def _(t: Tables):
    return rg.components(t("px").select("image_id", "x", "y", "label"))


@query("connected_components_8", f"WITH RECURSIVE {k.components('cc', 'px', 'label', 8)} SELECT image_id, x, y, label, region FROM cc")
def _(t: Tables):
    return rg.components(t("px").select("image_id", "x", "y", "label"), conn=8)


_STATS = "rs AS (SELECT image_id, region, label, COUNT(*) AS area, MIN(x) AS x0, MIN(y) AS y0, MAX(x) AS x1, MAX(y) AS y1, AVG(x) AS cx, AVG(y) AS cy FROM cc GROUP BY 1,2,3)"


@query("region_stats", f"""WITH RECURSIVE {_CC}, {_STATS} SELECT image_id, region, label, area, x0, y0, x1, y1, round_even(cx,1) AS cx, round_even(cy,1) AS cy, x0=0 OR y0=0 OR x1=23 OR y1=23 AS touches_canvas,
 ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY label, area DESC, round_even(cy,0), round_even(cx,0), region)-1 AS number FROM rs""")
def _(t: Tables):
    return rg.region_stats(rg.components(t("px").select("image_id", "x", "y", "label")))


_ADJ = """aj AS (SELECT image_id, LEAST(r,s) AS a, GREATEST(r,s) AS b, COUNT(*) AS boundary_length FROM (SELECT p.image_id, p.region AS r, q.region AS s FROM cc p JOIN cc q ON q.image_id=p.image_id AND q.x=p.x+1 AND q.y=p.y UNION ALL SELECT p.image_id, p.region, q.region FROM cc p JOIN cc q ON q.image_id=p.image_id AND q.x=p.x AND q.y=p.y+1) z WHERE r<>s GROUP BY 1,2,3)"""


@query("region_adjacency", f"WITH RECURSIVE {_CC}, {_ADJ} SELECT * FROM aj WHERE boundary_length>=6")
def _(t: Tables):
    return rg.region_adjacency(rg.components(t("px").select("image_id", "x", "y", "label")))


_JUN = """jw AS (SELECT p.image_id, p.x, p.y, list_sort(list_distinct([p.region,q.region,r.region,s.region])) AS inc FROM cc p JOIN cc q ON q.image_id=p.image_id AND q.x=p.x+1 AND q.y=p.y JOIN cc r ON r.image_id=p.image_id AND r.x=p.x AND r.y=p.y+1 JOIN cc s ON s.image_id=p.image_id AND s.x=p.x+1 AND s.y=p.y+1),
jn AS (SELECT image_id, x, y, inc FROM jw WHERE len(inc)>=3 QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, x//8, y//8 ORDER BY y, x)=1)"""


@query("junctions", f"WITH RECURSIVE {_CC}, {_JUN} SELECT image_id, x, y, array_to_string(inc, ',') AS incident, CASE WHEN len(inc)=3 THEN 'T' ELSE 'X' END AS junction_type FROM jn")
def _(t: Tables):
    j = rg.junctions(rg.components(t("px").select("image_id", "x", "y", "label")))
    return j.withColumn("incident", F.array_join(F.transform("incident", lambda v: v.cast("string")), ","))


_RISK = f"ar AS (SELECT a.*, EXISTS (SELECT 1 FROM jn j WHERE j.image_id=a.image_id AND list_contains(j.inc,a.a) AND list_contains(j.inc,a.b)) AS third_region_risk FROM aj a WHERE boundary_length>=6)"


@query("third_region_risk", f"WITH RECURSIVE {_CC}, {_ADJ}, {_JUN}, {_RISK} SELECT * FROM ar")
def _(t: Tables):
    rp = regions_of(t)
    return rg.third_region_risk(rg.region_adjacency(rp), rg.junctions(rp))


_PATHPX = "SELECT p.image_id, p.x, p.y, p.label AS region, CASE WHEN hit%29=0 THEN (p.label+1)%5 ELSE p.label END AS path FROM (SELECT *, x*5+y*7+image_id AS hit FROM px) p"


@query("match_regions_to_paths", f"""WITH z AS ({_PATHPX}), i AS (SELECT image_id, region, path, COUNT(*) AS i FROM z GROUP BY 1,2,3), v AS (SELECT image_id, region, path, i/(SUM(i) OVER (PARTITION BY image_id, region)+SUM(i) OVER (PARTITION BY image_id, path)-i) AS iou FROM i)
SELECT image_id, region, CASE WHEN iou>=0.5e0 THEN path END AS path, round(iou,6) AS iou FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, region ORDER BY iou DESC, path)=1""")
def _(t: Tables):
    t("px").createOrReplaceTempView("px")
    return rounded(rg.match_regions_to_paths(t.spark.sql(_PATHPX), "region", "path"))


_BOX = "SELECT i.image_id, v AS blob, CAST(v*5 AS INT) AS x, CAST((v*7+i.image_id)%20 AS INT) AS y, CAST(2+v%3 AS INT) AS w, CAST(2+v%2 AS INT) AS h FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN {L} z"
_BOX_D = _BOX.replace("{L}", "(SELECT CAST(unnest(range(5)) AS INT) AS v)")


@query("match_active_boundary", f"""WITH RECURSIVE {_CC}, {_ADJ}, {_JUN}, {_RISK}, bx AS ({_BOX_D}), n AS (SELECT b.image_id, b.blob, c.region, COUNT(*) AS n FROM bx b JOIN cc c ON c.image_id=b.image_id AND c.x BETWEEN b.x-GREATEST(6,(b.w+b.h)//4) AND b.x+b.w+GREATEST(6,(b.w+b.h)//4)-1 AND c.y BETWEEN b.y-GREATEST(6,(b.w+b.h)//4) AND b.y+b.h+GREATEST(6,(b.w+b.h)//4)-1 GROUP BY 1,2,3),
q AS (SELECT *, SUM(n) OVER w AS t, COUNT(*) OVER w AS k, ROW_NUMBER() OVER (PARTITION BY image_id, blob ORDER BY n DESC, region) AS r FROM n WINDOW w AS (PARTITION BY image_id, blob)),
s AS (SELECT image_id, blob, MAX(t) AS t, MAX(k) AS k, COUNT(*) FILTER (n>=0.15e0*t) AS m, MAX(CASE WHEN r=1 THEN region END) AS ra, MAX(CASE WHEN r=2 AND n>=0.15e0*t THEN region END) AS rb, MAX(CASE WHEN r=2 THEN n END) AS nb FROM q GROUP BY 1,2),
e AS (SELECT s.*, ar.third_region_risk AS risk FROM s LEFT JOIN ar ON ar.image_id=s.image_id AND ar.a=LEAST(ra,rb) AND ar.b=GREATEST(ra,rb) AND rb IS NOT NULL), f AS (SELECT *, CASE WHEN k<2 THEN 'not_enough_regions' WHEN m<2 THEN 'no_two_dominant_regions' WHEN risk IS NULL THEN 'not_adjacent' WHEN m>=3 OR risk THEN 'third_region_risk' END AS rejection_reason FROM e)
SELECT image_id, blob, ra, rb, rejection_reason, CASE WHEN rejection_reason IS NULL THEN round_even(nb/t,3) END AS match_score FROM f""")
def _(t: Tables):
    rp = regions_of(t)
    t("px").createOrReplaceTempView("px")
    boxes = t.spark.sql(_BOX.replace("{L}", "(SELECT explode(sequence(0,4)) AS v)"))
    return rg.match_active_boundary(boxes, rp, rg.third_region_risk(rg.region_adjacency(rp), rg.junctions(rp)))


# a raster with one-pixel fringes: every sixth column between labels becomes its own class
_THIN = "SELECT image_id, x, y, CASE WHEN x=12 AND label<>4 THEN 7 WHEN (x*5+y*3+image_id)%97=0 THEN 8 ELSE label END AS label FROM px"
_THIN_FILLS = {0: (255, 255, 255), 1: (230, 40, 40), 2: (30, 60, 200), 3: (20, 20, 20), 4: (40, 170, 80), 7: (150, 150, 160), 8: (26, 24, 24)}


def _thin(t: Tables) -> DataFrame:
    t("px").createOrReplaceTempView("px")
    return t.spark.sql(_THIN)


def _thin_fills(df: DataFrame) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), *[F.lit(v).alias(f"f{c}") for c, v in zip("rgb", p)]) for i, p in _THIN_FILLS.items()])).alias("s")
    return df.select("image_id").distinct().select("image_id", rows).select("image_id", "s.*")


_LINF = lambda v: f"{(v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4)!r}"
_LINROWS = "(SELECT * FROM (VALUES " + ",".join(f"({i},{_LINF(p[0])}::DOUBLE,{_LINF(p[1])}::DOUBLE,{_LINF(p[2])}::DOUBLE)" for i, p in _THIN_FILLS.items()) + ") q(l,r,g,b))"
_MICRO = f"""th AS ({_THIN}), {k.components('cc', 'th', 'label', 4)}, {_ADJ}, wd AS (SELECT c.image_id, c.region, ANY_VALUE(c.label) AS label, COUNT(*) AS area, bool_or(NOT EXISTS (SELECT 1 FROM cc q WHERE q.image_id=c.image_id AND ABS(q.x-c.x)+ABS(q.y-c.y)=1 AND q.region<>c.region)) AS wide FROM cc c GROUP BY 1,2),
inv AS (SELECT c.image_id||'|'||w.region AS image_id, c.x, c.y, 1 AS label FROM cc c JOIN wd w ON w.image_id=c.image_id AND NOT w.wide AND w.area<=86.4e0 AND c.region<>w.region), {k.components('ic', 'inv', 'label', 8)},
ho AS (SELECT image_id, COUNT(*) AS holes FROM (SELECT image_id, region FROM ic GROUP BY 1,2 HAVING NOT bool_or(x=0 OR y=0 OR x=23 OR y=23)) z GROUP BY 1),
bo AS (SELECT image_id, a AS region, b AS nb, boundary_length AS len FROM aj UNION ALL SELECT image_id, b, a, boundary_length FROM aj), nc AS (SELECT o.image_id, o.region, n.label AS nl, SUM(len) AS len, COUNT(*) AS parts, arg_max(o.nb, (len, -o.nb)) AS target FROM bo o JOIN wd n ON n.image_id=o.image_id AND n.region=o.nb GROUP BY 1,2,3),
kc AS (SELECT w.image_id, w.region, w.label, w.area, COUNT(*) AS k, SUM(len) AS total, MIN(nl) AS la, MAX(nl) AS lb FROM wd w JOIN nc USING (image_id, region) WHERE NOT w.wide AND w.area<=86.4e0 GROUP BY 1,2,3,4 HAVING COUNT(*)<=2),
mj AS (SELECT kc.*, a.len AS alen, a.parts AS ap, a.target AS at_, b.parts AS bp, b.target AS bt, f.r, f.g, f.b, fa.r AS ar, fa.g AS ag, fa.b AS ab, fb.r AS br, fb.g AS bg, fb.b AS bb FROM kc JOIN nc a ON a.image_id=kc.image_id AND a.region=kc.region AND a.nl=la JOIN nc b ON b.image_id=kc.image_id AND b.region=kc.region AND b.nl=lb
 JOIN {_LINROWS} f ON f.l=kc.label JOIN {_LINROWS} fa ON fa.l=la JOIN {_LINROWS} fb ON fb.l=lb),
mt AS (SELECT *, (ar-br)*(ar-br)+(ag-bg)*(ag-bg)+(ab-bb)*(ab-bb) AS den FROM mj), mu AS (SELECT *, CASE WHEN den<1e-9 THEN 0.5e0 ELSE LEAST(1e0,GREATEST(0e0,((r-br)*(ar-br)+(g-bg)*(ag-bg)+(b-bb)*(ab-bb))/den)) END AS t FROM mt),
mv AS (SELECT *, sqrt(power(r-(t*ar+(1-t)*br),2)+power(g-(t*ag+(1-t)*bg),2)+power(b-(t*ab+(1-t)*bb),2)) AS res, sqrt(power(r-ar,2)+power(g-ag,2)+power(b-ab,2)) AS dist FROM mu),
mc AS (SELECT image_id, region, label, area, CASE WHEN k=2 THEN 'fringe' ELSE 'island' END AS kind, CASE WHEN k=2 AND t<0.5e0 THEN bt ELSE at_ END AS target, CASE WHEN k=2 AND t<0.5e0 THEN lb ELSE la END AS target_label, (CASE WHEN k=2 AND t<0.5e0 THEN bp ELSE ap END)=1 AS accepted
 FROM mv WHERE NOT EXISTS (SELECT 1 FROM ho WHERE ho.image_id=mv.image_id||'|'||mv.region) AND ((k=2 AND res<=0.5e0) OR (k=1 AND dist<=0.3e0 AND alen/total>=0.8e0)))"""



def _micro(t: Tables):
    th = _thin(t)
    rp = cut_lineage(rg.components(th))
    return rp, rg.classify_micro_regions(rp, _thin_fills(th), blend_tol=0.5, island_tol=0.3)


@query("classify_micro_regions", f"WITH RECURSIVE {_MICRO} SELECT * FROM mc")
def _(t: Tables):
    return _micro(t)[1]


@query("apply_merges", f"""WITH RECURSIVE {_MICRO}, ac AS (SELECT image_id, region, target FROM mc WHERE accepted), lk AS (SELECT image_id, region AS u, target AS v FROM ac UNION SELECT image_id, target, region FROM ac),
rt(image_id, s, n) AS (SELECT image_id, region, region FROM wd UNION SELECT rt.image_id, rt.s, lk.v FROM rt JOIN lk ON lk.image_id=rt.image_id AND lk.u=rt.n), gr AS (SELECT image_id, n AS region, MIN(s) AS g FROM rt GROUP BY 1,2),
mb AS (SELECT gr.image_id, gr.region, gr.g, w.label, w.area, ac.region IS NULL AS free FROM gr JOIN wd w ON w.image_id=gr.image_id AND w.region=gr.region LEFT JOIN ac ON ac.image_id=gr.image_id AND ac.region=gr.region),
an AS (SELECT image_id, g, region AS anchor, label AS anchor_label FROM mb QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, g ORDER BY free DESC, area DESC, region)=1)
SELECT mb.image_id, mb.region, anchor, anchor_label FROM mb JOIN an ON an.image_id=mb.image_id AND an.g=mb.g""")
def _(t: Tables):
    rp, mc = _micro(t)
    stats = rp.groupBy("image_id", "region", "label").agg(F.count(F.lit(1)).alias("area"))
    return rg.apply_merges(stats, mc.where("accepted").select("image_id", "region", "target"))


_SPECK = "SELECT image_id, x, y, CASE WHEN hit THEN 130 ELSE r0 END AS r, CASE WHEN hit THEN 128 ELSE g0 END AS g, CASE WHEN hit THEN 126 ELSE b0 END AS b FROM (SELECT image_id, x, y, (x*5+y*7+image_id)%23=0 AS hit, CASE label WHEN 0 THEN 255 WHEN 1 THEN 230 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 40 END AS r0, CASE label WHEN 0 THEN 255 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 20 ELSE 170 END AS g0, CASE label WHEN 0 THEN 255 WHEN 1 THEN 40 WHEN 2 THEN 200 WHEN 3 THEN 20 ELSE 80 END AS b0 FROM px) z"


@query("remove_speckles", f"""WITH RECURSIVE q AS ({_SPECK}), qk AS (SELECT image_id, x, y, r*65536+g*256+b AS label FROM q), {k.components('cc', 'qk', 'label', 8)}, sm AS (SELECT image_id, region, label FROM cc GROUP BY 1,2,3 HAVING COUNT(*)<6), sp AS (SELECT cc.* FROM cc JOIN sm USING (image_id, region, label)),
ri AS (SELECT DISTINCT s.image_id, s.region, o.x, o.y FROM sp s JOIN cc o ON o.image_id=s.image_id AND ABS(o.x-s.x)<=1 AND ABS(o.y-s.y)<=1 AND (o.region<>s.region)), fi AS (SELECT ri.image_id, ri.region, CAST(FLOOR(median(r)) AS INT) AS nr, CAST(FLOOR(median(g)) AS INT) AS ng, CAST(FLOOR(median(b)) AS INT) AS nb FROM ri JOIN q ON q.image_id=ri.image_id AND q.x=ri.x AND q.y=ri.y GROUP BY 1,2)
SELECT q.image_id, q.x, q.y, COALESCE(nr,q.r) AS r, COALESCE(ng,q.g) AS g, COALESCE(nb,q.b) AS b FROM q LEFT JOIN (SELECT sp.image_id, sp.x, sp.y, nr, ng, nb FROM sp JOIN fi ON fi.image_id=sp.image_id AND fi.region=sp.region) n ON n.image_id=q.image_id AND n.x=q.x AND n.y=q.y""")
def _(t: Tables):
    t("px").createOrReplaceTempView("px")
    return rg.remove_speckles(t.spark.sql(_SPECK))


_ISLE_FILL = "CASE {l} WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {d} ELSE {e} END"


def _isle_fills(l: str) -> str:
    f = lambda *v: _ISLE_FILL.format(l=l, **dict(zip("abcde", v)))
    return f"{f(250,230,60,20,205)} AS r, {f(250,60,60,20,205)} AS g, {f(250,60,180,20,205)} AS b"


@query("absorb_islands", f"""WITH RECURSIVE {_CC}, ar AS (SELECT image_id, region, ANY_VALUE(label) AS label, COUNT(*) AS area FROM cc GROUP BY 1,2), fl AS (SELECT image_id, region, {_isle_fills('label')} FROM ar), sm AS (SELECT * FROM ar WHERE area BETWEEN 6 AND 1400),
ri AS (SELECT DISTINCT s.image_id, s.region, o.x, o.y, o.region AS nb FROM cc s JOIN sm ON sm.image_id=s.image_id AND sm.region=s.region JOIN cc o ON o.image_id=s.image_id AND ABS(o.x-s.x)<=1 AND ABS(o.y-s.y)<=1 AND o.region<>s.region), rn AS (SELECT image_id, region, nb, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY image_id, region) AS t FROM ri GROUP BY 1,2,3),
tp AS (SELECT * FROM rn QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, region ORDER BY n DESC, nb)=1), c AS (SELECT tp.image_id, tp.region, tp.nb FROM tp JOIN sm USING (image_id, region) JOIN ar b ON b.image_id=tp.image_id AND b.region=tp.nb WHERE t>=8 AND n/t>=0.3e0 AND b.area>=0.5e0*sm.area), {k.lab8('fz','fl',[('r','g','b','i')])}, {k.lab8('pz','px',[('r','g','b','m')])},
mm AS (SELECT c.image_id, c.region, AVG(ml8) AS ml8, AVG(ma8) AS ma8, AVG(mb8) AS mb8 FROM c JOIN cc USING (image_id, region) JOIN pz ON pz.image_id=cc.image_id AND pz.x=cc.x AND pz.y=cc.y GROUP BY 1,2)
SELECT c.image_id, c.region, c.nb AS neighbour FROM c JOIN fz i ON i.image_id=c.image_id AND i.region=c.region JOIN (SELECT image_id, region, il8 AS nl8, ia8 AS na8, ib8 AS nb8 FROM fz) n ON n.image_id=c.image_id AND n.region=c.nb JOIN mm ON mm.image_id=c.image_id AND mm.region=c.region WHERE {k.de76('i.i','n.n')} BETWEEN 3 AND 250 AND {k.de76('mm.m','i.i')}>=10""")
def _(t: Tables):
    rp = regions_of(t)
    labels = rp.select("image_id", "region", "label").distinct()
    labels.createOrReplaceTempView("region_labels")
    fills = t.spark.sql(f"SELECT image_id, region, {_isle_fills('label')} FROM region_labels")
    return rg.absorb_islands(rp.select("image_id", "x", "y", "region"), fills, t("px"), border=0.3, ratio=0.5, max_de=250.0)


@query("merge_tone_bands", f"""WITH RECURSIVE {_CC}, {_ADJ}, fl AS (SELECT image_id, region, ANY_VALUE(label)*12+100 AS r, ANY_VALUE(label)*9+100 AS g, 100 AS b FROM cc GROUP BY 1,2), {k.lab8('fz','fl',[('r','g','b','s')])}, pr AS (SELECT aj.image_id, aj.a, aj.b, {k.de76('p.s','q.s')} AS d, sqrt(power(p.sa8-128,2)+power(p.sb8-128,2)) AS ca, sqrt(power(q.sa8-128,2)+power(q.sb8-128,2)) AS cb,
 ABS(degrees(atan2(p.sb8-128e0,p.sa8-128e0))-degrees(atan2(q.sb8-128e0,q.sa8-128e0))) AS dh FROM aj JOIN fz p ON p.image_id=aj.image_id AND p.region=aj.a JOIN fz q ON q.image_id=aj.image_id AND q.region=aj.b WHERE boundary_length>=6),
ok AS (SELECT image_id, a, b FROM pr WHERE d<=45 AND CASE WHEN ca<=10 AND cb<=10 THEN TRUE WHEN ca<=10 OR cb<=10 THEN ca<=14 AND cb<=14 ELSE LEAST(dh%360,360-dh%360)<=30 END), lk AS (SELECT image_id, a AS u, b AS v FROM ok UNION SELECT image_id, b, a FROM ok),
rt(image_id, s, n) AS (SELECT image_id, region, region FROM fl UNION SELECT rt.image_id, rt.s, lk.v FROM rt JOIN lk ON lk.image_id=rt.image_id AND lk.u=rt.n) SELECT image_id, n AS region, MIN(s) AS cluster FROM rt GROUP BY 1,2""")
def _(t: Tables):
    rp = regions_of(t)
    fills = rp.select("image_id", "region", "label").distinct().select("image_id", "region", (F.col("label") * 12 + 100).alias("r"), (F.col("label") * 9 + 100).alias("g"), F.lit(100).alias("b"))
    return rg.merge_tone_bands(rg.region_adjacency(rp), fills, 6)


@query("aa_films")
def _(t: Tables):
    th = _thin(t)
    fills = _thin_fills(th)
    p = th.join(fills, ["image_id", "label"]).select("image_id", "x", "y", *[F.col(f"f{c}").alias(c) for c in "rgb"])
    return rg.aa_films(p, px.merge_near_colors(px.dominant_colors(p)))


@query("fragmented", f"""WITH RECURSIVE {k.components('cc', 'px', 'label', 4)}, s AS (SELECT image_id, region, label, COUNT(*) AS area FROM cc GROUP BY 1,2,3) SELECT image_id, label, COUNT(*) AS parts, round(median(area),6) AS median_area, COUNT(*)>=2 AND median(area)<=60 AS fragmented FROM s GROUP BY 1,2""")
def _(t: Tables):
    rp = rg.components(t("px").select("image_id", "x", "y", "label"))
    return rounded(rg.fragmented(rp.groupBy("image_id", "region", "label").agg(F.count(F.lit(1)).alias("area")), 2, 60.0))


@query("noise_pair_merge")
def _(t: Tables):
    c = t("px").groupBy("image_id", "label").agg(*[F.avg(v).alias(v) for v in "rgb"], F.count(F.lit(1)).alias("n"))
    lab = cl.with_lab8(c.select("image_id", "label", F.avg("r").over(px.Window.partitionBy("image_id", "label")).alias("r"), F.col("r").alias("g"), F.col("r").alias("b"), "n"), ("r", "g", "b"), "z")
    return rg.noise_pair_merge(lab.select("image_id", "label", F.col("zl8").alias("l8"), F.col("za8").alias("a8"), F.col("zb8").alias("b8"), F.lit(0.5).alias("energy"), (F.col("n") < 150).alias("fragmented")), 60.0)


@query("topology_signature", f"""WITH RECURSIVE {_CC}, c AS (SELECT image_id, COUNT(DISTINCT (label, region)) AS components FROM cc GROUP BY 1), iv AS (SELECT p.image_id||'|'||l.label AS image_id, p.x, p.y, 1 AS label FROM px p JOIN (SELECT DISTINCT image_id, label FROM px) l ON l.image_id=p.image_id AND l.label<>p.label), {k.components('hc', 'iv', 'label', 4)},
h AS (SELECT CAST(split_part(image_id,'|',1) AS BIGINT) AS image_id, COUNT(*) AS holes FROM (SELECT image_id, region FROM hc GROUP BY 1,2 HAVING NOT bool_or(x=0 OR y=0 OR x=23 OR y=23)) z GROUP BY 1) SELECT image_id, components, COALESCE(holes,0) AS holes FROM c LEFT JOIN h USING (image_id)""")
def _(t: Tables):
    return rg.topology_signature(t("px"))


def _sides_topology(side: str, src: str) -> str:
    """Components and holes of at least four pixels of one side."""
    return f"""{k.components('c' + side, src, 'label', 4)}, n{side} AS (SELECT image_id, COUNT(*) AS n FROM (SELECT image_id, label, region FROM c{side} GROUP BY 1,2,3 HAVING COUNT(*)>=4) z GROUP BY 1),
iv{side} AS (SELECT p.image_id||'|'||l.label AS image_id, p.x, p.y, 1 AS label FROM {src} p JOIN (SELECT DISTINCT image_id, label FROM {src}) l ON l.image_id=p.image_id AND l.label<>p.label), {k.components('part' + side, 'iv' + side, 'label', 4)},
h{side} AS (SELECT CAST(split_part(image_id,'|',1) AS BIGINT) AS image_id, COUNT(*) AS n FROM (SELECT image_id, region FROM part{side} GROUP BY 1,2 HAVING COUNT(*)>=4 AND NOT bool_or(x=0 OR y=0 OR x=23 OR y=23)) z GROUP BY 1)"""


@query("topology_delta", f"""WITH RECURSIVE rn AS (SELECT image_id, x, y, {k.nearest('rr','rg','rb')[0]} AS label FROM px_pair), {_sides_topology('s', 'px_pair')}, {_sides_topology('r', 'rn')}
SELECT ns.image_id, ABS(ns.n-nr.n) AS component_delta, ABS(COALESCE(hs.n,0)-COALESCE(hr.n,0)) AS hole_delta FROM ns JOIN nr USING (image_id) LEFT JOIN hs USING (image_id) LEFT JOIN hr USING (image_id)""")
def _(t: Tables):
    p = t("px_pair")
    from mosaiq.plans.q_pixels import palette

    r = px.nearest_center(p, palette(t, "px_pair"), "named_struct('r', rr, 'g', rg, 'b', rb)", "cls")
    # both sides of all images in one pass over region graphs
    side = lambda df, c, k: df.select((F.col("image_id") * 2 + k).alias("image_id"), "x", "y", F.col(c).alias("label"))
    both = cut_lineage(rg.topology_signature(side(p, "label", 0).unionByName(side(r, "cls", 1)), "label", 4))
    of = lambda k: both.where(F.col("image_id") % 2 == k).withColumn("image_id", F.floor(F.col("image_id") / 2))
    return rg.topology_delta(of(0), of(1))


_INK2 = "mo AS (SELECT image_id, x, y, 1 AS label FROM px_pair WHERE GREATEST(255-r,255-g,255-b)>60), mr AS (SELECT image_id, x, y, 1 AS label FROM px_pair WHERE GREATEST(255-rr,255-rg,255-rb)>60)"


@query("component_delta", f"""WITH RECURSIVE {_INK2}, {k.components('c1', 'mo', 'label', 8)}, {k.components('c2', 'mr', 'label', 8)}, a AS (SELECT image_id, COUNT(DISTINCT region) AS n FROM c1 GROUP BY 1), b AS (SELECT image_id, COUNT(DISTINCT region) AS n FROM c2 GROUP BY 1)
SELECT i.image_id, COALESCE(a.n,0) AS components_original, COALESCE(b.n,0) AS components_rendered, COALESCE(b.n,0)-COALESCE(a.n,0) AS component_delta FROM (SELECT DISTINCT image_id FROM px_pair) i LEFT JOIN a USING (image_id) LEFT JOIN b USING (image_id)""")
def _(t: Tables):
    return rg.component_delta(t("px_pair"), px.ink(), px.ink("r"))


_CLS = f"cp AS (SELECT image_id, x, y, label, {k.nearest('rr','rg','rb')[0]} AS t FROM px_pair)"
_PARTS = f"""{_CLS}, {k.components('cc', 'cp', 'label', 8)}, st AS (SELECT cc.image_id, cc.region, cc.label, COUNT(*) AS area, COUNT(*) FILTER (cp.t=cc.label) AS inter, MIN(cc.x) AS x0, MIN(cc.y) AS y0, MAX(cc.x) AS x1, MAX(cc.y) AS y1 FROM cc JOIN cp USING (image_id, x, y) GROUP BY 1,2,3 HAVING COUNT(*)>=20),
rr AS (SELECT image_id, region, label, COUNT(*) AS rr FROM (SELECT DISTINCT cc.image_id, cc.region, cc.label, q.x, q.y FROM cc JOIN cp q ON q.image_id=cc.image_id AND q.t=cc.label AND ABS(q.x-cc.x)<=4 AND ABS(q.y-cc.y)<=4) z GROUP BY 1,2,3), ps AS (SELECT st.*, inter/(area+COALESCE(rr,0)-inter) AS iou FROM st LEFT JOIN rr USING (image_id, region, label))"""


def _parts(t: Tables):
    from mosaiq.plans.q_pixels import palette

    p = px.nearest_center(t("px_pair"), palette(t, "px_pair"), "named_struct('r', rr, 'g', rg, 'b', rb)", "cls").select("image_id", "x", "y", "label", "cls")
    return p, rg.component_parts(p, "label", "cls", 20)


@query("component_iou", f"""WITH RECURSIVE {_PARTS} SELECT image_id, round_even(MIN(iou),4) AS component_min_iou, round_even(AVG(iou),4) AS component_mean_iou, COUNT(*) AS components_measured, arg_min(concat_ws(',', x0, y0, x1-x0+1, y1-y0+1), (iou, label, region)) AS worst_box FROM ps GROUP BY 1""")
def _(t: Tables):
    return rg.component_iou(_parts(t)[1])


# small parts of the noisier side, looked up in the other one
@query("weak_components", f"""WITH RECURSIVE {_CLS}, cq AS (SELECT image_id, x, y, t AS label, label AS t FROM cp), {k.components('cc', 'cq', 'label', 8)}, st AS (SELECT cc.image_id, cc.region, cc.label, COUNT(*) AS area, COUNT(*) FILTER (cq.t=cc.label) AS inter, MIN(cc.x) AS x0, MIN(cc.y) AS y0, MAX(cc.x) AS x1, MAX(cc.y) AS y1 FROM cc JOIN cq USING (image_id, x, y) GROUP BY 1,2,3),
rr AS (SELECT image_id, region, label, COUNT(*) AS rr FROM (SELECT DISTINCT cc.image_id, cc.region, cc.label, q.x, q.y FROM cc JOIN cq q ON q.image_id=cc.image_id AND q.t=cc.label AND ABS(q.x-cc.x)<=4 AND ABS(q.y-cc.y)<=4) z GROUP BY 1,2,3), ps AS (SELECT st.*, inter/(area+COALESCE(rr,0)-inter) AS iou FROM st LEFT JOIN rr USING (image_id, region, label)),
bx AS (SELECT *, GREATEST(8, FLOOR(GREATEST(x1-x0+1,y1-y0+1)*0.35e0)) AS pad FROM ps WHERE iou<0.88e0 AND GREATEST(x1-x0+1,y1-y0+1)<=24*0.18e0),
g AS (SELECT b.image_id, b.region, b.label, b.iou, COUNT(*) FILTER (p.label=b.label) AS ns, COUNT(*) FILTER (p.t=b.label) AS nt, AVG(p.x) FILTER (p.label=b.label) AS xs, AVG(p.y) FILTER (p.label=b.label) AS ys, AVG(p.x) FILTER (p.t=b.label) AS xt, AVG(p.y) FILTER (p.t=b.label) AS yt,
 sqrt(var_pop(p.x) FILTER (p.label=b.label)+var_pop(p.y) FILTER (p.label=b.label)) AS rs, sqrt(var_pop(p.x) FILTER (p.t=b.label)+var_pop(p.y) FILTER (p.t=b.label)) AS rt FROM bx b JOIN cq p ON p.image_id=b.image_id AND p.x BETWEEN b.x0-pad AND b.x1+pad AND p.y BETWEEN b.y0-pad AND b.y1+pad GROUP BY 1,2,3,4)
SELECT image_id, region, round_even(iou,4) AS iou, round_even(xs-xt,2) AS dx, round_even(ys-yt,2) AS dy, round_even(rs/GREATEST(rt,1e-6),4) AS scale FROM g WHERE ns>=0.4e0 AND nt>=0.4e0""")
def _(t: Tables):
    p, _ = _parts(t)
    return rounded(rg.weak_components(p, rg.component_parts(p, "cls", "label", 1), "cls", "label", 1), 4)


@query("worst_region_de", f"WITH {k.delta_e('z', 'px_pair')} SELECT image_id, round(MAX(m),5) AS worst_face_de00 FROM (SELECT image_id, label, AVG(de00) AS m FROM z GROUP BY 1,2) q GROUP BY 1")
def _(t: Tables):
    return rounded(px.worst_region_de(t("px_pair"), "label"), 5)


_CRACK = """pd AS (SELECT image_id, x, y, region AS id FROM cc UNION ALL SELECT i.image_id, x, y, -1 FROM (SELECT DISTINCT image_id FROM cc) i CROSS JOIN (SELECT unnest(range(-1,25)) AS x) a CROSS JOIN (SELECT unnest(range(-1,25)) AS y) b WHERE x IN (-1,24) OR y IN (-1,24)),
ck AS (SELECT p.image_id, q.x AS x0, q.y AS y0, q.x+1 AS x1, q.y AS y1, p.id AS left_id, q.id AS right_id FROM pd p JOIN pd q ON q.image_id=p.image_id AND q.x=p.x AND q.y=p.y+1 WHERE p.id<>q.id
 UNION ALL SELECT p.image_id, q.x, q.y, q.x, q.y+1, q.id, p.id FROM pd p JOIN pd q ON q.image_id=p.image_id AND q.x=p.x+1 AND q.y=p.y WHERE p.id<>q.id)"""


@query("crack_edges", f"WITH RECURSIVE {_CC}, {_CRACK} SELECT * FROM ck")
def _(t: Tables):
    return rg.crack_edges(rg.components(t("px").select("image_id", "x", "y", "label")))


_VERT = """cn AS (SELECT image_id, x0 AS x, y0 AS y, left_id AS l, right_id AS r FROM ck UNION ALL SELECT image_id, x1, y1, left_id, right_id FROM ck), vd AS (SELECT image_id, x, y, COUNT(*) AS degree FROM cn GROUP BY 1,2,3), vr AS (SELECT image_id, x, y, COUNT(DISTINCT id) AS regions FROM (SELECT image_id, x, y, l AS id FROM cn UNION ALL SELECT image_id, x, y, r FROM cn) z GROUP BY 1,2,3),
vx AS (SELECT vd.*, regions FROM vd JOIN vr USING (image_id, x, y) WHERE degree<>2 OR regions>=3)"""


@query("lattice_vertices", f"WITH RECURSIVE {_CC}, {_CRACK}, {_VERT} SELECT image_id, x, y, degree, regions FROM vx")
def _(t: Tables):
    return rg.lattice_vertices(rg.crack_edges(rg.components(t("px").select("image_id", "x", "y", "label"))))


_CHAIN = """en AS (SELECT image_id, (CAST(y0 AS BIGINT)*4294967296+x0)*2+CASE WHEN x0=x1 THEN 1 ELSE 0 END AS e, x0 AS x, y0 AS y FROM ck UNION ALL SELECT image_id, (CAST(y0 AS BIGINT)*4294967296+x0)*2+CASE WHEN x0=x1 THEN 1 ELSE 0 END, x1, y1 FROM ck), iv AS (SELECT en.* FROM en ANTI JOIN vx USING (image_id, x, y)), lk AS (SELECT a.image_id, a.e AS u, b.e AS v FROM iv a JOIN iv b ON a.image_id=b.image_id AND a.x=b.x AND a.y=b.y AND a.e<>b.e),
ch(image_id, s, n) AS (SELECT image_id, e, e FROM (SELECT DISTINCT image_id, e FROM en) z UNION SELECT ch.image_id, ch.s, lk.v FROM ch JOIN lk ON lk.image_id=ch.image_id AND lk.u=ch.n), cr AS (SELECT image_id, n AS e, MIN(s) AS chain FROM ch GROUP BY 1,2),
cs AS (SELECT cr.image_id, chain, COUNT(DISTINCT cr.e) AS edges, bool_and(vx.x IS NULL) AS is_loop FROM cr JOIN en ON en.image_id=cr.image_id AND en.e=cr.e LEFT JOIN vx ON vx.image_id=en.image_id AND vx.x=en.x AND vx.y=en.y GROUP BY 1,2)"""


@query("boundary_chains", f"WITH RECURSIVE {_CC}, {_CRACK}, {_VERT}, {_CHAIN} SELECT image_id, chain, edges, is_loop FROM cs")
def _(t: Tables):
    ck = cut_lineage(rg.crack_edges(rg.components(t("px").select("image_id", "x", "y", "label"))))
    return rg.boundary_chains(ck, rg.lattice_vertices(ck))


@query("euler_check", f"""WITH RECURSIVE {_CC}, {_CRACK}, {_VERT}, {_CHAIN}, cl(image_id, s, n) AS (SELECT image_id, CAST(y AS BIGINT)*4294967296+x, CAST(y AS BIGINT)*4294967296+x FROM (SELECT DISTINCT image_id, x, y FROM cn) z UNION SELECT cl.image_id, cl.s, w.v FROM cl JOIN (SELECT image_id, CAST(y0 AS BIGINT)*4294967296+x0 AS u, CAST(y1 AS BIGINT)*4294967296+x1 AS v FROM ck UNION ALL SELECT image_id, CAST(y1 AS BIGINT)*4294967296+x1, CAST(y0 AS BIGINT)*4294967296+x0 FROM ck) w ON w.image_id=cl.image_id AND w.u=cl.n),
cq AS (SELECT image_id, COUNT(DISTINCT r) AS c FROM (SELECT image_id, n, MIN(s) AS r FROM cl GROUP BY 1,2) z GROUP BY 1), ee AS (SELECT image_id, COUNT(*) AS e, COUNT(*) FILTER (is_loop) AS loops FROM cs GROUP BY 1), vv AS (SELECT image_id, COUNT(*) AS v FROM vx GROUP BY 1), ff AS (SELECT image_id, COUNT(DISTINCT region)+1 AS f FROM cc GROUP BY 1)
SELECT ff.image_id, COALESCE(v,0)+loops AS v, e, f, c, COALESCE(v,0)+loops-e+f=c+1 AS euler_ok FROM ff JOIN ee USING (image_id) JOIN cq USING (image_id) LEFT JOIN vv USING (image_id)""")
def _(t: Tables):
    rp = regions_of(t)
    ck = cut_lineage(rg.crack_edges(rp))
    v = rg.lattice_vertices(ck)
    return rg.euler_check(rp, ck, v, rg.boundary_chains(ck, v))


_STEEP, _FAR = 30, 20
"""Rises of an outline at which a twin gets a wrong origin, and heights beyond which a vertex gets no finite place."""


@query("validate_half_edges", f"""WITH c AS (SELECT path_id, seq, y, ABS(COALESCE(LEAD(y) OVER w, FIRST_VALUE(y) OVER w)-y)>{_STEEP} AS steep FROM curve WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id AS graph_id, CONCAT('h', seq) AS subject, 'twin_missing' AS code FROM c WHERE path_id%11=0 AND seq=5 UNION ALL SELECT path_id, CONCAT('t', seq), 'twin_missing' FROM c WHERE FALSE
UNION ALL SELECT path_id, CONCAT('h', seq), 'twin_same_direction' FROM c WHERE path_id%13=0 AND seq=7 AND path_id%11<>0 UNION ALL SELECT path_id, CONCAT('t', seq), 'twin_same_direction' FROM c WHERE path_id%13=0 AND seq=7 AND path_id%11<>0
UNION ALL SELECT path_id, CONCAT('h', seq), 'next_previous_mismatch' FROM c WHERE path_id%17=0 AND seq=9 UNION ALL SELECT path_id, CONCAT('h', seq+1), 'previous_next_mismatch' FROM c WHERE path_id%17=0 AND seq=9
UNION ALL SELECT path_id, 'f', 'outer_cycle_missing' FROM c WHERE path_id%19=0 AND seq=0
UNION ALL SELECT path_id, CONCAT('h', seq), 'twin_endpoints_not_swapped' FROM c WHERE steep AND NOT (path_id%11=0 AND seq=5) UNION ALL SELECT path_id, CONCAT('t', seq), 'twin_endpoints_not_swapped' FROM c WHERE steep
UNION ALL SELECT path_id, CONCAT('v', seq), 'nonfinite_coordinate' FROM c WHERE ABS(y)>{_FAR}""")
def _(t: Tables):
    # outlines as rings of half-edges with their own coordinates; some of the rules are broken on purpose
    ring = pt.with_neighbours(t("curve").withColumn("closed", F.lit(True)))
    c = cut_lineage(ring.select(F.col("path_id").alias("graph_id"), "seq", "x", "y", (F.abs(F.col("ny") - F.col("y")) > _STEEP).alias("steep")))
    nxt = F.pmod(F.col("seq") + 1, F.lit(64))
    prv = F.pmod(F.col("seq") + 63, F.lit(64))
    name = lambda p, s: F.concat(F.lit(p), s.cast("string"))
    s = F.col("seq")
    bad_dir = F.expr("graph_id%13=0 AND seq=7 AND graph_id%11<>0")
    h = c.select(
        "graph_id", name("h", s).alias("id"), F.when(F.expr("graph_id%11=0 AND seq=5"), F.lit("gone")).otherwise(name("t", s)).alias("twin_id"), s.alias("curve_id"), F.lit(False).alias("reversed"),
        name("v", s).alias("origin"), name("v", nxt).alias("dest"), F.when(F.expr("graph_id%17=0 AND seq=9"), F.lit("h0")).otherwise(name("h", nxt)).alias("next_id"), name("h", prv).alias("prev_id"),
    )
    w = c.select(
        "graph_id", name("t", s).alias("id"), name("h", s).alias("twin_id"), s.alias("curve_id"), (~bad_dir).alias("reversed"), F.when(F.col("steep"), name("v", s)).otherwise(name("v", nxt)).alias("origin"), name("v", s).alias("dest"), name("t", prv).alias("next_id"), name("t", nxt).alias("prev_id"),
    )
    g = c.where("seq = 0")
    faces = g.select("graph_id", F.lit("f").alias("id"), F.lit(True).alias("visible"), F.lit(False).alias("is_exterior"), F.when(F.expr("graph_id%19<>0"), F.lit("c")).alias("outer_cycle_id"))
    cycles = g.select("graph_id", F.lit("c").alias("id"), F.lit("f").alias("face_id"), F.lit(True).alias("is_outer"), F.lit(False).alias("is_inner_of_face"))
    verts = c.select("graph_id", name("v", s).alias("id"), "x", F.when(F.abs("y") > _FAR, F.lit(float("inf"))).otherwise(F.col("y")).alias("y"))
    return rg.validate_half_edges(h.unionByName(w), faces, cycles, verts)


# -- paths -----------------------------------------------------------------------------------

_NB = """rings AS (SELECT path_id, closed, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys FROM curve GROUP BY path_id, closed),
nb AS (SELECT path_id, CAST(i AS INT) AS seq, xs[i+1] AS x, ys[i+1] AS y, closed, CASE WHEN closed OR i>={k} THEN xs[(i+64-{k})%64+1] END AS px, CASE WHEN closed OR i>={k} THEN ys[(i+64-{k})%64+1] END AS py,
 CASE WHEN closed OR i<64-{k} THEN xs[(i+{k})%64+1] END AS nx, CASE WHEN closed OR i<64-{k} THEN ys[(i+{k})%64+1] END AS ny FROM rings, range(0,64) r(i)),
tn AS (SELECT *, COALESCE(degrees(acos(GREATEST(-1,LEAST(1,((x-px)*(nx-x)+(y-py)*(ny-y))/(sqrt(power(x-px,2)+power(y-py,2))*sqrt(power(nx-x,2)+power(ny-y,2))))))),0) AS turn FROM nb)"""
_NB1, _NB2 = _NB.replace("{k}", "1"), _NB.replace("{k}", "2")


@query("turn_angle", f"WITH {_NB2} SELECT path_id, seq, round(turn,5) AS turn FROM tn")
def _(t: Tables):
    return rounded(pt.turn_angle(t("curve"), 2).select("path_id", "seq", "turn"), 5)


@query("dedupe_points", """WITH RECURSIVE r(path_id, seq, kx, ky, kept) AS (SELECT path_id, seq, x, y, TRUE FROM curve WHERE seq=0
 UNION ALL SELECT c.path_id, c.seq, CASE WHEN sqrt(power(c.x-r.kx,2)+power(c.y-r.ky,2))>30 THEN c.x ELSE r.kx END, CASE WHEN sqrt(power(c.x-r.kx,2)+power(c.y-r.ky,2))>30 THEN c.y ELSE r.ky END, sqrt(power(c.x-r.kx,2)+power(c.y-r.ky,2))>30 FROM r JOIN curve c ON c.path_id=r.path_id AND c.seq=r.seq+1),
k AS (SELECT path_id, seq AS source_seq, kx AS x, ky AS y, ROW_NUMBER() OVER w-1 AS seq, COUNT(*) OVER (PARTITION BY path_id) AS n, first_value(kx) OVER w AS fx, first_value(ky) OVER w AS fy FROM r WHERE kept WINDOW w AS (PARTITION BY path_id ORDER BY seq))
SELECT k.path_id, CAST(k.seq AS INT) AS seq, round(k.x,6) AS x, round(k.y,6) AS y, c.closed, k.source_seq FROM k JOIN curve c ON c.path_id=k.path_id AND c.seq=k.source_seq WHERE NOT (n>1 AND k.seq=n-1 AND sqrt(power(k.x-fx,2)+power(k.y-fy,2))<=30)""")
def _(t: Tables):
    return rounded(pt.dedupe_points(t("curve"), 30.0))


@query("merge_collinear", f"WITH {_NB1} SELECT path_id, seq, round(x,6) AS x, round(y,6) AS y, closed FROM tn WHERE turn>=60 OR (NOT closed AND seq IN (0,63))")
def _(t: Tables):
    return rounded(pt.merge_collinear(t("curve"), 60.0))


_MOD180 = lambda e: f"(({e})-180*FLOOR(({e})/180))"
_AXIS = f"""ag AS (SELECT *, CASE WHEN nx IS NOT NULL THEN {_MOD180('degrees(atan2(ny-y,nx-x))')} END AS a FROM nb), ln AS (SELECT path_id, seq, CASE WHEN closed THEN (seq+1)%64 ELSE seq+1 END AS nq, COALESCE(LEAST(a,180-a)<={{tol}},FALSE) AS h, COALESCE(ABS(a-90)<={{tol}},FALSE) AS v FROM ag),
lh AS (SELECT path_id, seq AS u, nq AS w FROM ln WHERE h UNION SELECT path_id, nq, seq FROM ln WHERE h), lv AS (SELECT path_id, seq AS u, nq AS w FROM ln WHERE v UNION SELECT path_id, nq, seq FROM ln WHERE v),
rh(path_id, s, n) AS (SELECT path_id, seq, seq FROM curve UNION SELECT rh.path_id, rh.s, lh.w FROM rh JOIN lh ON lh.path_id=rh.path_id AND lh.u=rh.n), rv(path_id, s, n) AS (SELECT path_id, seq, seq FROM curve UNION SELECT rv.path_id, rv.s, lv.w FROM rv JOIN lv ON lv.path_id=rv.path_id AND lv.u=rv.n),
gh AS (SELECT path_id, n AS seq, MIN(s) AS g FROM rh GROUP BY 1,2), gv AS (SELECT path_id, n AS seq, MIN(s) AS g FROM rv GROUP BY 1,2)"""


@query("snap_axis_groups", f"""WITH RECURSIVE {_NB1}, {_AXIS.replace('{tol}', '20')} SELECT c.path_id, c.seq, round(AVG(c.x) OVER (PARTITION BY c.path_id, gv.g),5) AS x, round(AVG(c.y) OVER (PARTITION BY c.path_id, gh.g),5) AS y, c.closed FROM curve c JOIN gh ON gh.path_id=c.path_id AND gh.seq=c.seq JOIN gv ON gv.path_id=c.path_id AND gv.seq=c.seq""")
def _(t: Tables):
    return rounded(pt.snap_axis_groups(t("curve"), 20.0), 5)


@query("snap_diagonal", f"""WITH {_NB1}, sg AS (SELECT *, {_MOD180('degrees(atan2(ny-y,nx-x))')} AS a FROM nb WHERE nx IS NOT NULL), sn AS (SELECT *, CASE WHEN LEAST(ABS(a-45),180-ABS(a-45))<=20 THEN 45e0 WHEN LEAST(ABS(a-135),180-ABS(a-135))<=20 THEN 135e0 END AS tt FROM sg),
pj AS (SELECT *, CASE WHEN tt IS NULL THEN x ELSE (x+nx)/2+((x-(x+nx)/2)*cos(radians(tt))+(y-(y+ny)/2)*sin(radians(tt)))*cos(radians(tt)) END AS ax, CASE WHEN tt IS NULL THEN y ELSE (y+ny)/2+((x-(x+nx)/2)*cos(radians(tt))+(y-(y+ny)/2)*sin(radians(tt)))*sin(radians(tt)) END AS ay,
 CASE WHEN tt IS NULL THEN nx ELSE (x+nx)/2+((nx-(x+nx)/2)*cos(radians(tt))+(ny-(y+ny)/2)*sin(radians(tt)))*cos(radians(tt)) END AS bx, CASE WHEN tt IS NULL THEN ny ELSE (y+ny)/2+((nx-(x+nx)/2)*cos(radians(tt))+(ny-(y+ny)/2)*sin(radians(tt)))*sin(radians(tt)) END AS by_ FROM sn),
vt AS (SELECT path_id, seq, ax AS x, ay AS y FROM pj UNION ALL SELECT path_id, (seq+1)%64, bx, by_ FROM pj), mn AS (SELECT path_id, seq, AVG(x) AS x, AVG(y) AS y FROM vt GROUP BY 1,2) SELECT c.path_id, c.seq, round(COALESCE(mn.x,c.x),5) AS x, round(COALESCE(mn.y,c.y),5) AS y, c.closed FROM curve c LEFT JOIN mn ON mn.path_id=c.path_id AND mn.seq=c.seq""")
def _(t: Tables):
    return rounded(pt.snap_diagonal(t("curve"), 20.0), 5)


_NEAR_AXIS = "(LEAST({0},180-{0})<=25 OR ABS({0}-90)<=25)"


@query("corner_intersections", f"""WITH {_NB1}, z AS (SELECT *, {_MOD180('degrees(atan2(y-py,x-px))')} AS a1, {_MOD180('degrees(atan2(ny-y,nx-x))')} AS a2, (px-x)*(y-ny)-(py-y)*(x-nx) AS den, px*y-py*x AS p, x*ny-y*nx AS q FROM nb),
i AS (SELECT *, (p*(x-nx)-(px-x)*q)/den AS ix, (p*(y-ny)-(py-y)*q)/den AS iy FROM z),
o AS (SELECT *, COALESCE({_NEAR_AXIS.format('a1')} AND {_NEAR_AXIS.format('a2')} AND ABS(den)>=1e-9 AND sqrt(power(ix-x,2)+power(iy-y,2))<GREATEST(sqrt(power(x-px,2)+power(y-py,2)), sqrt(power(nx-x,2)+power(ny-y,2))), FALSE) AS ok FROM i)
SELECT path_id, seq, round(CASE WHEN ok THEN ix ELSE x END,6) AS x, round(CASE WHEN ok THEN iy ELSE y END,6) AS y, closed FROM o""")
def _(t: Tables):
    return rounded(pt.corner_intersections(t("curve"), 25.0))


@query("run_stats", f"""WITH RECURSIVE op AS (SELECT path_id, seq, x, y FROM curve), s AS (SELECT a.path_id, sqrt(power(b.x-a.x,2)+power(b.y-a.y,2)) AS l, {_MOD180('degrees(atan2(b.y-a.y,b.x-a.x))')} AS a FROM op a JOIN op b ON b.path_id=a.path_id AND b.seq=a.seq+1), sa AS (SELECT path_id, COUNT(*) AS seg, COUNT(*) FILTER (l<2.5e0) AS short, SUM(l) AS tl, COALESCE(SUM(l) FILTER (LEAST(a,180-a)<=6 OR ABS(a-45)<=6 OR ABS(a-90)<=6 OR ABS(a-135)<=6),0) AS al FROM s WHERE l>=1e-9 GROUP BY 1),
v AS (SELECT b.path_id, degrees(acos(GREATEST(-1,LEAST(1,((b.x-a.x)*(c.x-b.x)+(b.y-a.y)*(c.y-b.y))/(sqrt(power(b.x-a.x,2)+power(b.y-a.y,2))*sqrt(power(c.x-b.x,2)+power(c.y-b.y,2))))))) AS t FROM op a JOIN op b ON b.path_id=a.path_id AND b.seq=a.seq+1 JOIN op c ON c.path_id=b.path_id AND c.seq=b.seq+1),
va AS (SELECT path_id, COUNT(*) AS verts, COUNT(*) FILTER (t BETWEEN 25 AND 150) AS corner_v, COUNT(*) FILTER (t>=3 AND t<25) AS facet_v, COUNT(*) FILTER (t>150) AS dirty_v FROM v GROUP BY 1)
SELECT *, round_even((straight_edge_score+axis_alignment_score+corner_cleanliness_score)/3e0,4) AS geometry_score FROM (SELECT path_id, seg, short, verts, corner_v, facet_v, dirty_v, round(tl,5) AS total_len, round(al,5) AS aligned_len, round(GREATEST(0e0,1-0.7e0*facet_v/verts-0.5e0*short/seg),4) AS straight_edge_score, round(LEAST(1e0,al/tl),4) AS axis_alignment_score, round(GREATEST(0e0,1-(dirty_v/verts+short/seg)),4) AS corner_cleanliness_score FROM sa JOIN va USING (path_id)) z""")
def _(t: Tables):
    return rounded(pt.run_stats(t("curve")), 5)


def _taubin_sql() -> str:
    parts = [f"{_NB2}, bx AS (SELECT path_id, LEAST(MAX(x)-MIN(x),MAX(y)-MIN(y))>=22 AS ok FROM curve GROUP BY 1), t0 AS (SELECT tn.path_id, tn.seq, tn.closed, tn.x AS ox, tn.y AS oy, tn.x, tn.y, ok AND turn<=50 AND (closed OR seq NOT IN (0,63)) AS mv FROM tn JOIN bx USING (path_id))"]
    for i in range(10):
        f = "0.33e0" if i % 2 == 0 else "(-0.34e0)"
        w = "OVER (PARTITION BY path_id ORDER BY seq)"
        end = "OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        e = lambda v: f"CASE WHEN mv THEN {v}+((COALESCE(LAG({v}) {w}, CASE WHEN closed THEN last_value({v}) {end} END, {v})+COALESCE(LEAD({v}) {w}, CASE WHEN closed THEN first_value({v}) {end} END, {v}))*0.5e0-{v})*{f} ELSE {v} END AS {v}"  # noqa: E731, B023
        parts.append(f"t{i + 1} AS (SELECT path_id, seq, closed, ox, oy, mv, {e('x')}, {e('y')} FROM t{i})")
    return "WITH " + ", ".join(parts) + """, df AS (SELECT *, sqrt(power(x-ox,2)+power(y-oy,2)) AS d FROM t10) SELECT path_id, seq, round(ox+(x-ox)*CASE WHEN d>1.1e0 THEN 1.1e0/d ELSE 1 END,5) AS x, round(oy+(y-oy)*CASE WHEN d>1.1e0 THEN 1.1e0/d ELSE 1 END,5) AS y, closed, d>0.05e0 AS moved FROM df"""


@query("taubin_smooth", _taubin_sql())
def _(t: Tables):
    return rounded(pt.taubin_smooth(t("curve")), 5)


_SEGS = "SELECT path_id, CAST(FLOOR(seq/4e0) AS INT) AS seq, 'C' AS kind, MAX(CASE WHEN seq%4=0 THEN x END) AS c1x, MAX(CASE WHEN seq%4=0 THEN y END) AS c1y, MAX(CASE WHEN seq%4=1 THEN x END) AS c2x, MAX(CASE WHEN seq%4=1 THEN y/8 END) AS c2y, MAX(CASE WHEN seq%4=2 THEN x END) AS ex, MAX(CASE WHEN seq%4=2 THEN y/8 END) AS ey, closed FROM curve GROUP BY path_id, CAST(FLOOR(seq/4e0) AS INT), closed"
_JOINT = f"""sg AS ({_SEGS}), jt AS (SELECT a.*, b.c1x AS nx, b.c1y AS ny FROM sg a JOIN sg b ON b.path_id=a.path_id AND b.seq=CASE WHEN a.closed THEN (a.seq+1)%16 ELSE a.seq+1 END), ja AS (SELECT *, degrees(acos(GREATEST(-1,LEAST(1,((ex-c2x)*(nx-ex)+(ey-c2y)*(ny-ey))/(sqrt(power(ex-c2x,2)+power(ey-c2y,2))*sqrt(power(nx-ex,2)+power(ny-ey,2))))))) AS turn FROM jt)"""


def _segs(t: Tables) -> DataFrame:
    t("curve").createOrReplaceTempView("curve")
    return t.spark.sql(_SEGS)


@query("curve_kinks", f"WITH {_JOINT} SELECT path_id, COUNT(*) FILTER (turn>1.5e0 AND turn<=25) AS kinks, COUNT(*) AS joints FROM ja GROUP BY 1")
def _(t: Tables):
    return pt.curve_kinks(_segs(t))


@query("fair_joints", f"""WITH {_JOINT}, kk AS (SELECT *, sqrt(power(ex-c2x,2)+power(ey-c2y,2)) AS li, sqrt(power(nx-ex,2)+power(ny-ey,2)) AS lo FROM ja WHERE turn>1.5e0 AND turn<=25), bs AS (SELECT *, (ex-c2x)/li+(nx-ex)/lo AS bx, (ey-c2y)/li+(ny-ey)/lo AS by_ FROM kk), bn AS (SELECT *, sqrt(bx*bx+by_*by_) AS nb FROM bs)
SELECT s.path_id, s.seq, round(COALESCE(p.ex+p.bx/p.nb*p.lo, s.c1x),5) AS c1x, round(COALESCE(p.ey+p.by_/p.nb*p.lo, s.c1y),5) AS c1y, round(COALESCE(q.ex-q.bx/q.nb*q.li, s.c2x),5) AS c2x, round(COALESCE(q.ey-q.by_/q.nb*q.li, s.c2y),5) AS c2y FROM sg s LEFT JOIN bn q ON q.path_id=s.path_id AND q.seq=s.seq LEFT JOIN bn p ON p.path_id=s.path_id AND (p.seq+1)%16=s.seq""")
def _(t: Tables):
    return rounded(pt.fair_joints(_segs(t)).select("path_id", "seq", "c1x", "c1y", "c2x", "c2y"), 5)


@query("circle_fit", """WITH m AS (SELECT path_id, AVG(x) AS mx, AVG(y) AS my, COUNT(*) AS n FROM curve GROUP BY 1), d AS (SELECT path_id, mx, my, n, x-mx AS u, y-my AS v, x, y FROM curve JOIN m USING (path_id)), s AS (SELECT path_id, mx, my, n, SUM(u*u) AS uu, SUM(u*v) AS uv, SUM(v*v) AS vv, SUM(u*(u*u+v*v)) AS uz, SUM(v*(u*u+v*v)) AS vz FROM d GROUP BY 1,2,3,4),
f AS (SELECT *, (uz*vv-vz*uv)/(uu*vv-uv*uv)/2 AS a, (vz*uu-uz*uv)/(uu*vv-uv*uv)/2 AS b FROM s), c AS (SELECT path_id, mx+a AS cx, my+b AS cy, sqrt(a*a+b*b+(uu+vv)/n) AS radius FROM f) SELECT c.path_id, round(cx,4) AS cx, round(cy,4) AS cy, round(radius,4) AS radius, round(MAX(ABS(sqrt(power(x-cx,2)+power(y-cy,2))-radius)),4) AS residual FROM c JOIN curve USING (path_id) GROUP BY c.path_id, cx, cy, radius""")
def _(t: Tables):
    return rounded(pt.circle_fit(t("curve")), 4)


_RING = "rg AS (SELECT a.path_id, a.x, a.y, b.x AS nx, b.y AS ny FROM curve a JOIN curve b ON b.path_id=a.path_id AND b.seq=(a.seq+1)%64)"


@query("signed_area", f"WITH {_RING}, s AS (SELECT path_id, SUM(x*ny-nx*y)/2 AS a FROM rg GROUP BY 1) SELECT path_id, round(a,4) AS signed_area, CASE WHEN a>0 THEN 'positive' WHEN a<0 THEN 'negative' ELSE 'degenerate' END AS orientation FROM s")
def _(t: Tables):
    return rounded(pt.signed_area(t("curve")), 4)


@query("circularity", f"""WITH {_RING}, s AS (SELECT path_id, ABS(SUM(x*ny-nx*y)/2) AS area, SUM(sqrt(power(nx-x,2)+power(ny-y,2))) AS p, (MAX(x)-MIN(x))*(MAX(y)-MIN(y)) AS box FROM rg GROUP BY 1) SELECT path_id, round(area,4) AS area, round(p,4) AS perimeter, round(4*pi()*area/(p*p),4) AS circularity, round(area/box,4) AS box_fill, round(p*p/(4*pi()*area),4) AS elongation FROM s""")
def _(t: Tables):
    return rounded(pt.circularity(t("curve")), 4)
