"""Queries over pixel rasters: colour, alpha, palettes and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.functions import color as cl
from mosaiq.functions.columns import finite, is_digest, keep_rows, rounded
from mosaiq.functions.text import markup_structure, redact, sensitive_scan
from mosaiq.operators import pixels as px, regions as rg, routing as rt, stencil as st
from mosaiq.plans import sqlkit as k
from mosaiq.session import cut_lineage
from mosaiq.plans.registry import Tables, query

BYTE = "CAST(LEAST(255,GREATEST(0,round_even({},0))) AS INT)"


def _carried(px_rows: DataFrame) -> DataFrame:
    """Pixels with the size of their image, as a reader gives them."""
    return px_rows.withColumn("width", F.lit(24)).withColumn("height", F.lit(24))


CHECK = "CASE WHEN (CAST(FLOOR(x/4e0) AS INT)+CAST(FLOOR(y/4e0) AS INT))%2=1 THEN 96 ELSE 238 END"


def _over(c: str, a: str, bg: str) -> str:
    return BYTE.format(f"{c}*({a}/255e0)+({bg})*(1-{a}/255e0)")


def palette(t: Tables, view: str = "px") -> DataFrame:
    items = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("rgb", p)]) for p in k.PALETTE])
    return t(view).select("image_id").distinct().select("image_id", items.alias("centers"))


# -- scalar functions ------------------------------------------------------------

@query("composite", f"""SELECT image_id, x, y, {_over('r','a','255')} AS white_r, {_over('g','a','0')} AS black_g, {_over('b','a','200')} AS tint_b, {_over('r','a',CHECK)} AS checker_r FROM px""")
def _(t: Tables):
    over = lambda c, bg: cl.alpha_over(c, "a", bg)
    return t("px").select("image_id", "x", "y", over("r", F.lit(255)).alias("white_r"), over("g", F.lit(0)).alias("black_g"), over("b", F.lit(200)).alias("tint_b"), over("r", cl.checker(cell=4)).alias("checker_r"))


_UN = lambda c: f"CASE WHEN a>0 THEN LEAST(255,GREATEST(0,round_even(round_even({c}*a/255e0,0)*255e0/a,0))) ELSE 0 END"


@query("premultiply", f"""WITH e AS (SELECT image_id, a, (ABS(r-{_UN('r')})+ABS(g-{_UN('g')})+ABS(b-{_UN('b')}))/3e0/255e0 AS e FROM px)
SELECT image_id, round(COALESCE(AVG(e) FILTER (a/255e0>0.02e0),0),6) AS roundtrip_mae, round(COALESCE(MAX(e) FILTER (a/255e0>0.02e0),0),6) AS roundtrip_max FROM e GROUP BY image_id""")
def _(t: Tables):
    return rounded(px.roundtrip_error(t("px")))


def _mb_select(name: str, bg: str) -> str:
    return f"SELECT image_id, '{name}' AS background, x, y, {_over('r','a',bg)} AS sr, {_over('g','a',bg)} AS sg, {_over('b','a',bg)} AS sb, {_over('rr','ra',bg)} AS tr, {_over('rg','ra',bg)} AS tg, {_over('rb','ra',bg)} AS tb FROM px_pair"


_MB_CTE = f"""mb AS ({_mb_select('white','255')} UNION ALL {_mb_select('black','0')} UNION ALL {_mb_select('checker',CHECK)}),
me AS (SELECT image_id, background, unnest([ABS(sr-tr)/255e0, ABS(sg-tg)/255e0, ABS(sb-tb)/255e0]) AS e FROM mb)"""


@query("multibackground", f"""WITH {_MB_CTE}, m2 AS (SELECT CONCAT(image_id,'|',background) AS image_id, x, y, {k.gray('sr','sg','sb')} AS p, {k.gray('tr','tg','tb')} AS q FROM mb), {k.ssim('sm','m2','p','q',24)}
SELECT me.image_id, me.background, round(AVG(e),6) AS rgb_mae, round(quantile_cont(e,0.95),6) AS rgb_p95, round(MAX(ssim),6) AS ssim FROM me JOIN sm ON sm.image_id=CONCAT(me.image_id,'|',me.background) GROUP BY 1,2""")
def _(t: Tables):
    return rounded(px.multibackground(t("px_pair"), 4))


@query("luma", "SELECT image_id, x, y, round(r*0.299e0+g*0.587e0+b*0.114e0,6) AS luma601, round(r*0.2126e0+g*0.7152e0+b*0.0722e0,6) AS luma709 FROM px")
def _(t: Tables):
    return rounded(t("px").select("image_id", "x", "y", cl.luma601().alias("luma601"), cl.luma709().alias("luma709")))


_LIN = lambda c: f"CASE WHEN {c}/255e0<=0.04045e0 THEN {c}/255e0/12.92e0 ELSE power(({c}/255e0+0.055e0)/1.055e0,2.4e0) END"


@query("blend_residual", f"""WITH l AS (SELECT image_id, x, y, {_LIN('r')} AS r, {_LIN('g')} AS g, {_LIN('b')} AS b, {_LIN('rr')} AS p, {_LIN('rg')} AS q, {_LIN('rb')} AS s, {_LIN('230')} AS w0, {_LIN('40')} AS w1 FROM px_pair),
d AS (SELECT *, p-w0 AS d0, q-w1 AS d1, s-w1 AS d2, (p-w0)*(p-w0)+(q-w1)*(q-w1)+(s-w1)*(s-w1) AS den FROM l),
t AS (SELECT *, CASE WHEN den<1e-9 THEN 0.5e0 ELSE LEAST(1e0,GREATEST(0e0,((r-w0)*d0+(g-w1)*d1+(b-w1)*d2)/den)) END AS t FROM d)
SELECT image_id, x, y, round(r,6) AS linear_r, round(t,6) AS t, round(CASE WHEN den<1e-9 THEN sqrt((r-p)*(r-p)+(g-q)*(g-q)+(b-s)*(b-s)) ELSE sqrt(power(r-(t*p+(1-t)*w0),2)+power(g-(t*q+(1-t)*w1),2)+power(b-(t*s+(1-t)*w1),2)) END,6) AS residual FROM t""")
def _(t: Tables):
    d = t("px_pair").select("image_id", "x", "y", *[cl.srgb_to_linear(c).alias(f"l{c}") for c in ("r", "g", "b", "rr", "rg", "rb")], *[cl.srgb_to_linear(F.lit(v)).alias(f"w{i}") for i, v in enumerate((230, 40, 40))])
    res, mix = cl.blend_residual(("lr", "lg", "lb"), ("lrr", "lrg", "lrb"), ("w0", "w1", "w2"))
    return rounded(d.select("image_id", "x", "y", F.col("lr").alias("linear_r"), mix.alias("t"), res.alias("residual")))


@query("rgb_to_lab", f"WITH {k.lab8('z','px',[('r','g','b','s')])} SELECT image_id, x, y, sl8, sa8, sb8, round(sl8*100e0/255e0,6) AS lab_l FROM z")
def _(t: Tables):
    return rounded(cl.with_lab(t("px"), ("r", "g", "b"), "s").select("image_id", "x", "y", "sl8", "sa8", "sb8", F.col("sL").alias("lab_l")))


@query("delta_e76", f"WITH {k.lab8('z','px_pair',[('r','g','b','s'),('rr','rg','rb','t')])} SELECT image_id, x, y, round({k.de76('s','t')},6) AS de76 FROM z")
def _(t: Tables):
    d = cl.with_lab8(cl.with_lab8(t("px_pair"), ("r", "g", "b"), "s"), ("rr", "rg", "rb"), "t")
    return rounded(d.select("image_id", "x", "y", cl.delta_e76_lab8("s", "t").alias("de76")))


@query("ciede2000", f"WITH {k.delta_e('z','px_pair')} SELECT image_id, x, y, round(de00,5) AS de00 FROM z")
def _(t: Tables):
    return rounded(px.with_delta_e(t("px_pair")).select("image_id", "x", "y", "de00"), 5)


_MX, _MN = "GREATEST(r,g,b)", "LEAST(r,g,b)"
_HUE = f"CASE WHEN {_MX}={_MN} THEN 0e0 ELSE (CASE WHEN {_MX}=r THEN (g-b)/({_MX}-{_MN})*60e0 WHEN {_MX}=g THEN (b-r)/({_MX}-{_MN})*60e0+120 ELSE (r-g)/({_MX}-{_MN})*60e0+240 END) END"
_BUCKET = f"CAST(FLOOR(FLOOR(CASE WHEN {_HUE}<0 THEN {_HUE}+360 ELSE {_HUE} END)/30) AS INT)"


@query("hue_bucket", f"SELECT image_id, x, y, {_MX}-{_MN} AS saturation, {_MX}-{_MN}>=55 AND {_MX}>=55 AS vivid, {_BUCKET} AS bucket FROM px")
def _(t: Tables):
    return t("px").select("image_id", "x", "y", cl.saturation().alias("saturation"), cl.is_vivid().alias("vivid"), cl.hue_bucket30().alias("bucket"))


@query("ink_mask", "SELECT image_id, x, y, GREATEST(255-r,255-g,255-b)>60 AS by_channel, sqrt(power(r-255,2)+power(g-255,2)+power(b-255,2))>60 AS by_distance FROM px")
def _(t: Tables):
    white = (F.lit(255), F.lit(255), F.lit(255))
    return t("px").select("image_id", "x", "y", px.ink().alias("by_channel"), px.ink_euclid(bg=white).alias("by_distance"))


_FILLS = """SELECT image_id, x, y, r, g, b, CASE (x+y)%7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'White' WHEN 3 THEN CONCAT('rgb( ', CAST(r AS VARCHAR(9)), ' , ', CAST(g+100 AS VARCHAR(9)), ',', CAST(b AS VARCHAR(9)), ')') WHEN 4 THEN '#f0A' WHEN 5 THEN 'url(#g)' ELSE '#1E2f3a' END AS fill FROM px"""


@query("parse_hex", f"""WITH f AS ({_FILLS}) SELECT image_id, x, y, CASE (x+y)%7 WHEN 0 THEN 0 WHEN 2 THEN 255 WHEN 3 THEN r WHEN 4 THEN 255 WHEN 6 THEN 30 END AS fr, CASE (x+y)%7 WHEN 0 THEN 0 WHEN 2 THEN 255 WHEN 3 THEN LEAST(255,g+100) WHEN 4 THEN 0 WHEN 6 THEN 47 END AS fg,
 CASE (x+y)%7 WHEN 0 THEN 0 WHEN 2 THEN 255 WHEN 3 THEN b WHEN 4 THEN 170 WHEN 6 THEN 58 END AS fb, printf('#%02x%02x%02x', r, g, b) AS hex FROM f""")
def _(t: Tables):
    t("px").createOrReplaceTempView("px")
    f = t.spark.sql(_FILLS).withColumn("p", cl.parse_fill("fill"))
    return f.select("image_id", "x", "y", F.col("p.r").alias("fr"), F.col("p.g").alias("fg"), F.col("p.b").alias("fb"), cl.to_hex().alias("hex"))


@query("same_tone_family", f"""WITH {k.lab8('z','px_pair',[('r','g','b','s'),('rr','rg','rb','t')])}, h AS (SELECT *, {k.de76('s','t')} AS d, sqrt(power(sa8-128,2)+power(sb8-128,2)) AS ca, sqrt(power(ta8-128,2)+power(tb8-128,2)) AS cb, ABS(degrees(atan2(sb8-128e0,sa8-128e0))-degrees(atan2(tb8-128e0,ta8-128e0))) AS dh FROM z)
SELECT image_id, x, y, d<=45 AND CASE WHEN ca<=10 AND cb<=10 THEN TRUE WHEN ca<=10 OR cb<=10 THEN ca<=14 AND cb<=14 ELSE LEAST(dh%360,360-dh%360)<=30 END AS same_family FROM h""")
def _(t: Tables):
    d = cl.with_lab8(cl.with_lab8(t("px_pair"), ("r", "g", "b"), "s"), ("rr", "rg", "rb"), "t")
    return d.select("image_id", "x", "y", cl.same_tone_family("s", "t").alias("same_family"))


def _mix_sql() -> str:
    anchors = k.PALETTE[:4]
    c = ("r", "g", "b")
    tests = []
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = anchors[i], anchors[j]
            ab = [q - p for p, q in zip(a, b)]
            den = sum(v * v for v in ab)
            tt = "(" + "+".join(f"({c[n]}-{a[n]})*({ab[n]})" for n in range(3)) + f")/{den}e0"
            tests.append(f"({tt} BETWEEN 0.04e0 AND 0.96e0 AND sqrt(" + "+".join(f"power({c[n]}-({a[n]}+{tt}*({ab[n]})),2)" for n in range(3)) + ")<=26)")
            for m in range(j + 1, 4):
                v = [q - p for p, q in zip(a, anchors[m])]
                uu, uv, vv = (sum(p * q for p, q in zip(s, w)) for s, w in ((ab, ab), (ab, v), (v, v)))
                det = uu * vv - uv * uv
                wu, wv = ("(" + "+".join(f"({c[n]}-{a[n]})*({s[n]})" for n in range(3)) + ")" for s in (ab, v))
                ss, t2 = f"(({vv}e0*{wu}-({uv}e0)*{wv})/{det}e0)", f"(({uu}e0*{wv}-({uv}e0)*{wu})/{det}e0)"
                tests.append(f"({ss}>=-0.02e0 AND {t2}>=-0.02e0 AND {ss}+{t2}<=1.02e0 AND sqrt(" + "+".join(f"power({c[n]}-({a[n]}+{ss}*({ab[n]})+{t2}*({v[n]})),2)" for n in range(3)) + ")<=26)")
    return " OR ".join(tests)


@query("mixture_of", f"SELECT image_id, x, y, ({_mix_sql()}) AS is_mixture FROM px")
def _(t: Tables):
    anchors = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("rgb", p)]) for p in k.PALETTE[:4]])
    pix = t("px")
    return px.mixture_of(pix, pix.select("image_id").distinct().withColumn("anchors", anchors), 26.0).select("image_id", "x", "y", "is_mixture")


@query("nearest_center", f"SELECT image_id, x, y, CAST({k.nearest('r','g','b')[0]} AS INT) AS center, round(CAST({k.nearest('r','g','b')[1]} AS DOUBLE),6) AS center_d2 FROM px")
def _(t: Tables):
    return rounded(px.nearest_center(t("px"), palette(t)).select("image_id", "x", "y", "center", "center_d2"))


@query("stride_sample", "SELECT image_id, x, y FROM px WHERE (y*24+x)%5=0")
def _(t: Tables):
    return px.stride_sample(_carried(t("px")), 100).select("image_id", "x", "y")


@query("area_downsample", "SELECT image_id, CAST(FLOOR(x/4e0) AS INT) AS x, CAST(FLOOR(y/4e0) AS INT) AS y, round(AVG(r),6) AS r, round(AVG(b),6) AS b FROM px GROUP BY 1,2,3")
def _(t: Tables):
    return rounded(st.area_downsample(t("px"), 4, ["r", "b"]))


@query("redact", r"""SELECT doc_id, regexp_replace(regexp_replace(CONCAT('/srv/data/f.txt 0xAF09 ', text), '(?:[A-Za-z]:)?(?:[\\/][\w.\-~+]+){2,}', '<redacted-path>', 'g'), '0x[0-9a-fA-F]+', '<addr>', 'g') AS message FROM documents""")
def _(t: Tables):
    return t("documents").withColumn("m", F.concat(F.lit("/srv/data/f.txt 0xAF09 "), "text")).select("doc_id", redact("m").alias("message"))


_SENS = """SELECT doc_id, CASE WHEN doc_id%11=0 THEN CONCAT(text, ' /home/u/x ') ELSE text END AS text, CASE WHEN doc_id%13=0 THEN CONCAT('C:', chr(92), 'dir', chr(92), 'f') WHEN doc_id%17=0 THEN 'Traceback (most recent call last): x' ELSE source END AS note FROM documents"""
_SPAT = [("posix_path", r"(?:^|[^A-Za-z0-9_.-])/(?:home|tmp|var|Users|private|opt|workspace|runner)(?:/[^\s\"'']+)+"), ("windows_path", r"\b[A-Za-z]:[\\/](?:[^\s\"'']+[\\/])*[^\s\"'']+"),
         ("secret", r"(?i)(authorization\s*:|bearer\s+[A-Za-z0-9._~+/-]{8,}|github_pat_|ghp_[A-Za-z0-9]{10,}|token[=:\s]+[A-Za-z0-9._~+/-]{8,})"), ("traceback", r"Traceback \(most recent call last\):")]


@query("sensitive_scan", f"WITH s AS ({_SENS}), l AS (SELECT doc_id, 'text' AS field, text AS v FROM s UNION ALL SELECT doc_id, 'note', note FROM s) " + " UNION ALL ".join(f"SELECT doc_id, field, '{n}' AS code FROM l WHERE regexp_matches(v, '{p}')" for n, p in _SPAT))
def _(t: Tables):
    t("documents").createOrReplaceTempView("documents")
    return sensitive_scan(t.spark.sql(_SENS.replace("chr(92)", "char(92)")), "doc_id", ["text", "note"])


_FIN = "SELECT side, case_id, repeat_index, CASE WHEN case_id%7=0 THEN NULL WHEN case_id%11=0 THEN CAST('NaN' AS DOUBLE) WHEN case_id%13=0 THEN CAST('Infinity' AS DOUBLE) ELSE ssim END AS v, CASE WHEN case_id%5=0 THEN upper(artifact_sha256) ELSE artifact_sha256 END AS sha FROM bench"


@query("finite_number", f"SELECT side, case_id, repeat_index, COALESCE(isfinite(v),FALSE) AS is_finite, case_id%5<>0 OR regexp_full_match(sha,'[0-9a-f]{{64}}') AS valid_digest FROM ({_FIN}) z")
def _(t: Tables):
    t("bench").createOrReplaceTempView("bench")
    return t.spark.sql(_FIN).select("side", "case_id", "repeat_index", finite("v").alias("is_finite"), is_digest("sha").alias("valid_digest"))


@query("recover_rgba", f"""WITH c AS (SELECT image_id, x, y, a, {_over('r','a','255')} AS w FROM px) SELECT image_id, x, y, CASE WHEN a>0 THEN {BYTE.format('(w-255e0*(1-a/255e0))/(a/255e0)')} ELSE 0 END AS r FROM c""")
def _(t: Tables):
    c = t("px").select("image_id", "x", "y", "a", cl.alpha_over("r", "a", F.lit(255)).alias("w"))
    return c.select("image_id", "x", "y", cl.recover_straight("w").alias("r"))


# -- aggregates ----------------------------------------------------------------------

_DOM = """dc AS (SELECT image_id, FLOOR(r/16e0) AS kr, FLOOR(g/16e0) AS kg, FLOOR(b/16e0) AS kb, CAST(FLOOR(AVG(r)+0.5e0) AS INT) AS r, CAST(FLOOR(AVG(g)+0.5e0) AS INT) AS g, CAST(FLOOR(AVG(b)+0.5e0) AS INT) AS b, COUNT(*) AS n FROM px GROUP BY 1,2,3,4),
dd AS (SELECT image_id, r, g, b, n, round_even(n/SUM(n) OVER (PARTITION BY image_id),4) AS ratio, n/SUM(n) OVER (PARTITION BY image_id) AS raw FROM dc), dom AS (SELECT image_id, r, g, b, n, ratio FROM dd WHERE raw>=0.002e0)"""


@query("dominant_colors", f"WITH {_DOM} SELECT * FROM dom")
def _(t: Tables):
    return px.dominant_colors(t("px"))


@query("merge_near_colors")
def _(t: Tables):
    return px.merge_near_colors(px.dominant_colors(t("px")))


@query("consolidate_palette")
def _(t: Tables):
    w = px.dominant_colors(t("px")).select("image_id", "r", "g", "b", F.col("n").alias("weight"))
    return px.consolidate_palette(w, 4, 12.0, [(0, 0, 0), (255, 255, 255), (255, 0, 0)])


_PG = f"pg AS (SELECT image_id, x, y, {k.gray()} AS v FROM px)"


@query("distinct_color_ratio", f"""WITH RECURSIVE {_PG}, {k.edges('ed','pg','v',70,160)}, n AS (SELECT image_id, COUNT(DISTINCT (FLOOR(r/8e0),FLOOR(g/8e0),FLOOR(b/8e0)))/COUNT(*) AS d, COUNT(*) AS n FROM px GROUP BY 1), e AS (SELECT image_id, COUNT(*) AS e FROM ed GROUP BY 1)
SELECT image_id, round(d,6) AS distinct_color_ratio, d>0.095e0 AND 1-round_even(COALESCE(e,0)/n,4)>0.68e0 AS gradient_like FROM n LEFT JOIN e USING (image_id)""")
def _(t: Tables):
    p = t("px").withColumn("v", cl.gray())
    return rounded(px.gradient_like(p, rg.edge_density(p, "v")))


_CORNER = lambda n: f"WHERE (x<{n} OR x>={24 - n}) AND (y<{n} OR y>={24 - n})"


@query("background", f"""WITH c AS (SELECT * FROM px {_CORNER(8)}), m AS (SELECT image_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM c GROUP BY 1), u AS (SELECT c.image_id, mr, mg, mb, AVG(CASE WHEN sqrt(power(r-mr,2)+power(g-mg,2)+power(b-mb,2))<18 THEN 1e0 ELSE 0 END) AS u, AVG(CASE WHEN a<245 THEN 1e0 ELSE 0 END) AS tr FROM c JOIN m USING (image_id) GROUP BY ALL)
SELECT image_id, CAST(FLOOR(mr) AS INT) AS background_r, CAST(FLOOR(mg) AS INT) AS background_g, CAST(FLOOR(mb) AS INT) AS background_b, CASE WHEN tr>0.45e0 THEN 'transparent' WHEN (mr+mg+mb)/3>235 THEN 'white' WHEN (mr+mg+mb)/3<25 THEN 'black' ELSE 'colored' END AS background_type,
 round_even(u,4) AS background_uniformity, round_even(tr,4) AS transparent_corner_ratio, u>0.82e0 OR tr>0.45e0 AS is_uniform_background FROM u""")
def _(t: Tables):
    return px.background(_carried(t("px")))


_RED = "r>=165 AND g<=115 AND b<=115 AND r>g*1.28e0 AND r>b*1.28e0 AND ABS(g-b)<=45"


@query("palette_stats", f"""WITH {_DOM} SELECT image_id, round_even(COALESCE(SUM(ratio) FILTER ({_MX}-{_MN}>=55),0),4) AS saturated_ratio, round_even(COALESCE(SUM(ratio) FILTER ({_MX}-{_MN}<=30),0),4) AS neutral_ratio, round_even(COALESCE(SUM(ratio) FILTER ({_RED}),0),4) AS red_like_ratio,
 round_even(COALESCE(SUM(ratio) FILTER (NOT ({_RED}) AND {_MX}-{_MN}>=55),0),4) AS non_red_saturated_ratio, bool_or({_MX}<=45) AS has_black, bool_or({_MN}>=218) AS has_white, bool_or(r>=165 AND g<=105 AND b<=105 AND r>g*1.35e0 AND ABS(g-b)<=45) AS has_red,
 COUNT(DISTINCT CASE WHEN {_MX}-{_MN}>=55 AND {_MX}>=55 THEN {_BUCKET} END) AS vivid_hue_count FROM dom GROUP BY image_id""")
def _(t: Tables):
    return px.palette_stats(px.dominant_colors(t("px")))


@query("foreground_stats", f"""WITH c AS (SELECT image_id, a, CAST(FLOOR(r*(a/255e0)+(1-a/255e0)*255) AS INT) AS r, CAST(FLOOR(g*(a/255e0)+(1-a/255e0)*255) AS INT) AS g, CAST(FLOOR(b*(a/255e0)+(1-a/255e0)*255) AS INT) AS b FROM px), f AS (SELECT *, sqrt(power(r-255,2)+power(g-255,2)+power(b-255,2))>40 AND a>40 AS fg, {_MX}-{_MN} AS s FROM c)
SELECT image_id, CASE WHEN COUNT(*) FILTER (fg AND s>=35)<20 THEN 0 ELSE COUNT(DISTINCT CASE WHEN fg AND s>=35 THEN (FLOOR(r/16e0),FLOOR(g/16e0),FLOOR(b/16e0)) END) END AS chromatic_color_count, round_even(COUNT(*) FILTER (fg AND s>=60)/GREATEST(1,COUNT(*) FILTER (fg)),4) AS vivid_ratio FROM f GROUP BY image_id""")
def _(t: Tables):
    return px.foreground_stats(t("px"))


@query("transparency_flags", "SELECT image_id, bool_or(a<250) AS has_transparency, AVG(CASE WHEN a>12 THEN 1e0 ELSE 0 END)>0.005e0 AND AVG(CASE WHEN a<245 THEN 1e0 ELSE 0 END)>0.005e0 AS alpha_foreground FROM px GROUP BY image_id")
def _(t: Tables):
    return px.transparency_flags(t("px"))


@query("color_metrics", f"WITH {k.delta_e('z','px_pair')} SELECT image_id, round(AVG(de00),5) AS de00_mean, round(MAX(de00),5) AS de00_max, round(quantile_cont(de00,0.5),5) AS de00_p50, round(quantile_cont(de00,0.95),5) AS de00_p95, round(quantile_cont(de00,0.99),5) AS de00_p99 FROM z GROUP BY image_id")
def _(t: Tables):
    return rounded(px.color_metrics(t("px_pair")), 5)


@query("pixel_error", f"""WITH {k.delta_e('z','px_pair')} SELECT image_id, round(AVG((ABS(r-rr)+ABS(g-rg)+ABS(b-rb))/3e0),6) AS mae, round(sqrt(AVG((power(r-rr,2)+power(g-rg,2)+power(b-rb,2))/3e0)),6) AS rmse, round(AVG(CASE WHEN GREATEST(ABS(r-rr),ABS(g-rg),ABS(b-rb))>18 THEN 1e0 ELSE 0 END),6) AS changed_pixel_ratio,
 round(AVG(CASE WHEN de76>18 THEN 1e0 ELSE 0 END),6) AS high_error_ratio, round(AVG(de76),6) AS mean_delta_e FROM z GROUP BY image_id""")
def _(t: Tables):
    return rounded(px.pixel_error(t("px_pair")))


_ALPHA = """am AS (SELECT image_id, CASE WHEN SUM(GREATEST(a,ra))>0 THEN SUM(LEAST(a,ra))/SUM(GREATEST(a,ra)) ELSE 1e0 END AS alpha_iou, CASE WHEN COUNT(*) FILTER (a>=1 OR ra>=1)>0 THEN COUNT(*) FILTER (a>=1 AND ra>=1)/COUNT(*) FILTER (a>=1 OR ra>=1) ELSE 1e0 END AS alpha_binary_iou,
 AVG(ABS(a-ra)/255e0) AS alpha_mae, quantile_cont(ABS(a-ra)/255e0,0.95) AS alpha_p95, MAX(ABS(a-ra)/255e0) AS alpha_max, AVG(a)/255e0 AS source_coverage, AVG(ra)/255e0 AS render_coverage, bool_or(a<255) AS has_alpha FROM px_pair GROUP BY image_id)"""


@query("alpha_metrics", f"WITH {_ALPHA} SELECT image_id, " + ", ".join(f"round({c},6) AS {c}" for c in ("alpha_iou", "alpha_binary_iou", "alpha_mae", "alpha_p95", "alpha_max", "source_coverage", "render_coverage")) + " FROM am")
def _(t: Tables):
    return rounded(px.alpha_metrics(t("px_pair")))


@query("alpha_profile", """SELECT image_id, bool_or(a<255) AS has_alpha, round(AVG(a)/255e0,6) AS soft_coverage, round(AVG(CASE WHEN a>=1 THEN 1e0 ELSE 0 END),6) AS binary_coverage, round(AVG(CASE WHEN a=0 THEN 1e0 ELSE 0 END),6) AS fully_transparent_ratio,
 round(AVG(CASE WHEN a>0 AND a<255 THEN 1e0 ELSE 0 END),6) AS partial_alpha_ratio, round(AVG(CASE WHEN a=255 THEN 1e0 ELSE 0 END),6) AS fully_opaque_ratio FROM px GROUP BY image_id""")
def _(t: Tables):
    return rounded(px.alpha_profile(t("px")))


@query("alpha_diagnosis", f"""WITH {_ALPHA} SELECT image_id, has_alpha, round(alpha_iou,6) AS alpha_iou, round(alpha_mae,6) AS alpha_mae, CASE WHEN NOT has_alpha THEN 'not_applicable_opaque_source' WHEN alpha_iou>=0.98e0 AND alpha_mae<=0.02e0 THEN 'alpha_preserved'
 WHEN render_coverage>=0.995e0 AND ABS(alpha_iou-source_coverage)<=1e-4 THEN 'opaque_canvas_collapse' WHEN render_coverage-source_coverage>=0.1e0 THEN 'alpha_overcoverage' ELSE 'alpha_shape_regression' END AS diagnosis FROM am""")
def _(t: Tables):
    return rounded(px.alpha_diagnosis(t("px_pair")))


@query("halo_metrics", f"""WITH {k.sobel('sb','px_pair','a',24)}, e AS (SELECT p.image_id, (ABS(r-rr)+ABS(g-rg)+ABS(b-rb))/3e0/255e0*GREATEST(a/255e0,0.05e0) AS e FROM px_pair p JOIN sb USING (image_id,x,y) WHERE sqrt(gx*gx+gy*gy)>1 AND a>2), g AS (SELECT image_id, AVG(e) AS m, quantile_cont(e,0.95) AS p, COUNT(*) AS n FROM e GROUP BY 1)
SELECT i.image_id, round(m,6) AS halo_rgb_mae, round(p,6) AS halo_rgb_p95, COALESCE(n,0) AS halo_sample_count FROM (SELECT DISTINCT image_id FROM px_pair) i LEFT JOIN g USING (image_id)""")
def _(t: Tables):
    return rounded(px.halo_metrics(t("px_pair")))


@query("seam_ratio", f"""WITH m AS (SELECT *, CASE WHEN GREATEST(255-r,255-g,255-b)>40 THEN 1 ELSE 0 END AS m FROM px_pair), {k.square('e','m',['m'],1,'MIN','_ero')}, f AS (SELECT *, GREATEST(255-r,255-g,255-b)>12 AS fg, LEAST(rr,rg,rb)>244 AS wh, GREATEST(255-rr,255-rg,255-rb)<=12 AS lk FROM e)
SELECT image_id, round(CASE WHEN COUNT(*) FILTER (fg)>0 THEN COUNT(*) FILTER (fg AND wh)/COUNT(*) FILTER (fg) ELSE 0 END,6) AS seam_ratio, round(CASE WHEN SUM(m_ero)>0 THEN COUNT(*) FILTER (m_ero=1 AND lk)/SUM(m_ero) ELSE 0 END,6) AS eroded_seam_ratio FROM f GROUP BY image_id""")
def _(t: Tables):
    return rounded(px.seam_ratio(t("px_pair")))


@query("ink_metrics", f"""WITH m AS (SELECT image_id, x, y, CASE WHEN GREATEST(255-r,255-g,255-b)>60 THEN 1 ELSE 0 END AS o, CASE WHEN GREATEST(255-rr,255-rg,255-rb)>60 THEN 1 ELSE 0 END AS q FROM px_pair), {k.square('e','m',['o','q'],1,'MAX','_dil')}
SELECT image_id, CAST(SUM(o) AS BIGINT) AS ink_pixels, CASE WHEN SUM(o)>=30 THEN round_even(SUM(o*q_dil)/SUM(o),4) END AS ink_recall, CASE WHEN SUM(o)>=30 THEN round_even(SUM(q*o_dil)/GREATEST(1,SUM(q)),4) END AS ink_precision FROM e GROUP BY image_id""")
def _(t: Tables):
    return px.ink_metrics(t("px_pair"))


@query("halo_ratio", f"""WITH RECURSIVE rq AS (SELECT image_id, x, y, rr AS r, rg AS g, rb AS b, {k.gray('rr','rg','rb')} AS v FROM px_pair), {k.edges('ed','rq','v',60,150)}, m AS (SELECT p.image_id, p.x, p.y, {k.nearest('r','g','b')[1]} AS d2, CASE WHEN ed.x IS NULL THEN 0 ELSE 1 END AS e FROM rq p LEFT JOIN ed ON ed.image_id=p.image_id AND ed.x=p.x AND ed.y=p.y), {k.square('w','m',['e'],2,'MAX','_dil')}
SELECT image_id, round_even(AVG(CASE WHEN sqrt(d2)>40 AND e_dil=0 THEN 1e0 ELSE 0 END),5) AS halo_ratio FROM w GROUP BY image_id""")
def _(t: Tables):
    p = t("px_pair").select("image_id", "x", "y", F.col("rr").alias("r"), F.col("rg").alias("g"), F.col("rb").alias("b")).withColumn("v", cl.gray())
    return px.halo_ratio(p, palette(t), rg.edge_mask(p, "v", 60, 150))


@query("palette_agreement", f"""WITH c AS (SELECT image_id, {k.nearest('r','g','b')[0]} AS s, {k.nearest('rr','rg','rb')[0]} AS t FROM px_pair), l AS (SELECT image_id, c, COUNT(*) FILTER (s=c OR t=c) AS u, COUNT(*) FILTER (s=c AND t=c) AS i FROM c CROSS JOIN (SELECT unnest(range(5)) AS c) q GROUP BY 1,2)
SELECT a.image_id, round(a.agree,6) AS palette_agree, round(MIN(CASE WHEN u>=20 THEN i/u END),6) AS min_component_iou, round(AVG(CASE WHEN u>=20 THEN i/u END),6) AS mean_component_iou FROM (SELECT image_id, AVG(CASE WHEN s=t THEN 1e0 ELSE 0 END) AS agree FROM c GROUP BY 1) a JOIN l USING (image_id) GROUP BY a.image_id, a.agree""")
def _(t: Tables):
    return rounded(px.palette_agreement(t("px_pair"), palette(t)))


_POST = f"""th AS (SELECT image_id, list_sort(list_distinct([quantile_disc(v,0.25),quantile_disc(v,0.5),quantile_disc(v,0.75)])) AS th FROM (SELECT image_id, {k.gray()} AS v FROM px) z GROUP BY 1)"""


@query("posterize_thresholds", f"WITH {_POST} SELECT image_id, array_to_string(th, ',') AS thresholds FROM th")
def _(t: Tables):
    return px.posterize_thresholds(t("px"), 3).withColumn("thresholds", F.array_join(F.transform("thresholds", lambda v: v.cast("string")), ","))


@query("band_colors", f"""WITH {_POST}, b AS (SELECT p.image_id, len(list_filter(th, lambda v: v < r*0.2126e0+g*0.7152e0+b*0.0722e0)) AS band, len(th) AS k, r, g, b FROM px p JOIN th USING (image_id))
SELECT image_id, CAST(band AS INT) AS band, CAST(FLOOR(AVG(r)+0.5e0) AS INT) AS r, CAST(FLOOR(AVG(g)+0.5e0) AS INT) AS g, CAST(FLOOR(AVG(b)+0.5e0) AS INT) AS b, COUNT(*) AS n, bool_and(k=band) AS is_background FROM b GROUP BY image_id, band""")
def _(t: Tables):
    return px.band_colors(t("px"), px.posterize_thresholds(t("px"), 3))


_FILL_ROWS = "SELECT i.image_id, l AS path, CASE l WHEN 0 THEN 250 WHEN 1 THEN 200 WHEN 2 THEN 60 WHEN 3 THEN 20 ELSE 240 END AS fr, CASE l WHEN 0 THEN 250 WHEN 1 THEN 60 WHEN 2 THEN 60 WHEN 3 THEN 20 ELSE 0 END AS fg, CASE l WHEN 0 THEN 250 WHEN 1 THEN 60 WHEN 2 THEN 180 WHEN 3 THEN 20 ELSE 240 END AS fb FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN {L} z"


def _fills(t: Tables) -> DataFrame:
    t("px").createOrReplaceTempView("px")
    return t.spark.sql(_FILL_ROWS.replace("{L}", "(SELECT explode(sequence(0,4)) AS l)"))


_FILL_D = _FILL_ROWS.replace("{L}", "(SELECT CAST(unnest(range(5)) AS INT) AS l)")
_INNER = "it AS (SELECT p.* FROM px p WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.image_id=p.image_id AND ABS(q.x-p.x)+ABS(q.y-p.y)=1 AND q.label<>p.label))"


@query("recolor_by_path", f"""WITH {_INNER}, m AS (SELECT image_id, label AS path, COUNT(*) AS n, CAST(round_even(AVG(r),0) AS INT) AS nr, CAST(round_even(AVG(g),0) AS INT) AS ng, CAST(round_even(AVG(b),0) AS INT) AS nb FROM it GROUP BY 1,2), f AS ({_FILL_D}), j AS (SELECT * FROM m JOIN f USING (image_id, path)), {k.lab8('z','j',[('fr','fg','fb','o'),('nr','ng','nb','w')])}, s AS (SELECT *, {k.de76('o','w')} AS sh FROM z)
SELECT image_id, path, n, round(sh,6) AS shift, sh BETWEEN 0.5e0 AND 30 AS applied, CASE WHEN sh BETWEEN 0.5e0 AND 30 THEN nr ELSE fr END AS r, CASE WHEN sh BETWEEN 0.5e0 AND 30 THEN ng ELSE fg END AS g, CASE WHEN sh BETWEEN 0.5e0 AND 30 THEN nb ELSE fb END AS b FROM s""")
def _(t: Tables):
    return rounded(px.recolor_by_path(t("px"), "label", _fills(t)))


@query("recolor_by_group", f"""WITH f AS ({_FILL_D}), m AS (SELECT p.image_id, fr, fg, fb, COUNT(*) AS n, CAST(FLOOR(median(r)) AS INT) AS mr, CAST(FLOOR(median(g)) AS INT) AS mg, CAST(FLOOR(median(b)) AS INT) AS mb FROM px p JOIN f ON f.image_id=p.image_id AND f.path=p.label GROUP BY 1,2,3,4), {k.lab8('z','m',[('fr','fg','fb','o'),('mr','mg','mb','w')])}, s AS (SELECT *, {k.de76('o','w')} AS sh FROM z)
SELECT image_id, fr, fg, fb, n, round(sh,6) AS shift, CASE WHEN sh BETWEEN 0.5e0 AND 30 THEN mr ELSE fr END AS r, CASE WHEN sh BETWEEN 0.5e0 AND 30 THEN mg ELSE fg END AS g, CASE WHEN sh BETWEEN 0.5e0 AND 30 THEN mb ELSE fb END AS b FROM s""")
def _(t: Tables):
    return rounded(px.recolor_by_group(t("px"), "label", _fills(t)))


@query("snap_shrinking_palette")
def _(t: Tables):
    return px.snap_shrinking_palette(px.recolor_by_group(t("px"), "label", _fills(t)))


@query("fit_linear_gradient", f"""WITH q AS (SELECT image_id, label, x, y, LEAST(255,r+x) AS r, GREATEST(0,g-y) AS g, b FROM px), c AS (SELECT image_id, label, COUNT(*) AS n, var_pop(x)*COUNT(*) AS cxx, covar_pop(x,y)*COUNT(*) AS cxy, var_pop(y)*COUNT(*) AS cyy, AVG(x) AS cx, AVG(y) AS cy,
 {", ".join(f"covar_pop(x,{v})*COUNT(*) AS kx_{v}, covar_pop(y,{v})*COUNT(*) AS ky_{v}, AVG({v}) AS m_{v}" for v in "rgb")} FROM q GROUP BY 1,2 HAVING COUNT(*)>=40),
p AS (SELECT *, {", ".join(f"(kx_{v}*cyy-ky_{v}*cxy)/(cxx*cyy-cxy*cxy) AS gx_{v}, (ky_{v}*cxx-kx_{v}*cxy)/(cxx*cyy-cxy*cxy) AS gy_{v}" for v in "rgb")} FROM c)
SELECT image_id, label, n, {", ".join(f"round(gx_{v},4) AS gx_{v}, round(gy_{v},4) AS gy_{v}, round(m_{v}-gx_{v}*cx-gy_{v}*cy,4) AS c0_{v}" for v in "rgb")} FROM p""")
def _(t: Tables):
    q = t("px").withColumn("r", F.least(F.lit(255), F.col("r") + F.col("x"))).withColumn("g", F.greatest(F.lit(0), F.col("g") - F.col("y")))
    out = px.fit_linear_gradient(q, "label", 40, min_gain=-1e9)
    return rounded(out.select("image_id", "label", "n", *[f"{p}_{c}" for p in ("gx", "gy", "c0") for c in "rgb"]), 4)


@query("gradient_stops")
def _(t: Tables):
    q = t("px").withColumn("r", F.least(F.lit(255), F.col("r") + F.col("x") * 3)).withColumn("g", F.greatest(F.lit(0), F.col("g") - F.col("y") * 3))
    return rounded(px.fit_linear_gradient(q, "label", 40).select("image_id", "label", "gain_de", "x1", "y1", "x2", "y2"), 3)


@query("kmeans_palette")
def _(t: Tables):
    c = px.kmeans_palette(t("px"), 5)
    return rounded(c.select("image_id", F.posexplode("centers").alias("idx", "c")).select("image_id", "idx", "c.r", "c.g", "c.b"))


@query("recenter_by_median", "SELECT image_id, label, round(median(r),6) AS mr, round(median(g),6) AS mg, round(median(b),6) AS mb, COUNT(*) AS n FROM px GROUP BY 1,2")
def _(t: Tables):
    return rounded(px.recenter_by_median(t("px")))


@query("augment_centers")
def _(t: Tables):
    lab = cl.with_lab8(t("px"), ("r", "g", "b"), "z").select("image_id", "x", "y", F.col("zl8").alias("l8"), F.col("za8").alias("a8"), F.col("zb8").alias("b8"))
    lab = st.gradient(lab, "l8").withColumn("energy", F.col("grad") / 8.0)
    start = lab.groupBy("image_id").agg(F.array(F.struct(F.avg("l8").alias("r"), F.avg("a8").alias("g"), F.avg("b8").alias("b"))).alias("centers"))
    c = rg.augment_centers(lab, start, min_component=40)
    return rounded(c.select("image_id", F.posexplode("centers").alias("idx", "c")).select("image_id", "idx", "c.r", "c.g", "c.b"))


_RD = f"""h AS (SELECT image_id, FLOOR(r/64e0)*64 AS r, FLOOR(g/64e0)*64 AS g, FLOOR(b/64e0)*64 AS b FROM px), hc AS (SELECT image_id, r, g, b, COUNT(*) AS n FROM h GROUP BY 1,2,3,4), tk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS rk, SUM(n) OVER (PARTITION BY image_id) AS t FROM hc),
xt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS xk FROM tk WHERE rk>3 AND n>=20 AND n/t>=0.0004e0 AND {_MX}-{_MN}>=60)"""


@query("reduce_to_dominant", f"WITH {_RD} SELECT image_id, CAST(rk-1 AS INT) AS idx, round(r,6) AS r, round(g,6) AS g, round(b,6) AS b FROM tk WHERE rk<=3 UNION ALL SELECT image_id, CAST(2+xk AS INT), round(r,6), round(g,6), round(b,6) FROM xt WHERE xk<=3")
def _(t: Tables):
    q = t("px").select("image_id", *[(F.floor(F.col(c) / 64) * 64).alias(c) for c in "rgb"])
    c = px.reduce_to_dominant(q, 3, min_count=20)
    return rounded(c.select("image_id", F.posexplode("centers").alias("idx", "c")).select("image_id", "idx", "c.r", "c.g", "c.b"))


@query("auto_color_count", "SELECT image_id, GREATEST(16, LEAST(CASE WHEN e>=18 THEN 96 ELSE 64 END, e+10+CASE WHEN e>=18 THEN 32 ELSE 0 END+CASE WHEN e>=22 THEN 16 ELSE 0 END)) AS color_budget FROM (SELECT image_id, estimated_color_count AS e FROM feat) z")
def _(t: Tables):
    return px.auto_color_count(t("feat")).select("image_id", "color_budget")


# -- neighbourhoods -----------------------------------------------------------------------

@query("dilate_erode", """WITH m AS (SELECT image_id, x, y, CASE WHEN label=1 THEN 1 ELSE 0 END AS m FROM px),
r AS (SELECT image_id, x, y, MAX(m) OVER w AS hi, MIN(m) OVER w AS lo FROM m WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT image_id, x, y, MAX(hi) OVER w AS m_dil, MIN(lo) OVER w AS m_ero FROM r WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(t: Tables):
    m = t("px").select("image_id", "x", "y", (F.col("label") == 1).cast("int").alias("m"))
    return st.dilate_erode(m, ["m"], 2).select("image_id", "x", "y", "m_dil", "m_ero")


@query("interior", f"WITH {_INNER} SELECT image_id, x, y FROM it")
def _(t: Tables):
    return st.interior(t("px")).where("interior").select("image_id", "x", "y")


@query("sobel", f"WITH {_PG}, {k.sobel('s','pg','v',24)} SELECT image_id, x, y, round(gx,6) AS gx, round(gy,6) AS gy, round(sqrt(gx*gx+gy*gy),6) AS grad FROM s")
def _(t: Tables):
    g = st.gradient(t("px").select("image_id", "x", "y", cl.gray().alias("v")), "v")
    return rounded(g.select("image_id", "x", "y", F.col("gx").cast("double").alias("gx"), F.col("gy").cast("double").alias("gy"), "grad"))


@query("blur_score", f"""WITH {_PG}, l AS (SELECT p.image_id, p.x, p.y, SUM(q.v)-4*ANY_VALUE(p.v) AS l FROM pg p CROSS JOIN (VALUES (-1,0),(1,0),(0,-1),(0,1)) k(dx,dy) JOIN pg q ON q.image_id=p.image_id AND q.x=CASE WHEN p.x+dx<0 THEN 1 WHEN p.x+dx>23 THEN 22 ELSE p.x+dx END AND q.y=CASE WHEN p.y+dy<0 THEN 1 WHEN p.y+dy>23 THEN 22 ELSE p.y+dy END GROUP BY 1,2,3)
SELECT image_id, round_even(var_pop(l),2) AS blur_score FROM l GROUP BY image_id""")
def _(t: Tables):
    return st.blur_score(t("px").select("image_id", "x", "y", cl.gray().alias("v")), "v")


@query("edge_candidates", f"WITH {_PG}, {k.edge_candidates('c','pg','v',70,160)} SELECT image_id, x, y, st FROM c WHERE st>0")
def _(t: Tables):
    c = st.edge_candidates(t("px").select("image_id", "x", "y", cl.gray().alias("v")), {"st": "v"}, 70, 160)
    return keep_rows(c, F.col("st") > 0).select("image_id", "x", "y", "st")


@query("edge_mask", f"WITH RECURSIVE {_PG}, {k.edges('ed','pg','v',70,160)} SELECT image_id, x, y FROM ed")
def _(t: Tables):
    return rg.edge_mask(t("px").select("image_id", "x", "y", cl.gray().alias("v")), "v", 70, 160)


@query("edge_density", f"WITH RECURSIVE {_PG}, {k.edges('ed','pg','v',70,160)} SELECT p.image_id, round_even(COUNT(ed.x)/COUNT(*),4) AS edge_density FROM pg p LEFT JOIN ed ON ed.image_id=p.image_id AND ed.x=p.x AND ed.y=p.y GROUP BY 1")
def _(t: Tables):
    return rg.edge_density(t("px").select("image_id", "x", "y", cl.gray().alias("v")), "v")


@query("gaussian_blur", f"WITH {_PG}, {k.blur('z','pg',['v'],1.5,24)} SELECT image_id, x, y, round(v_blur,5) AS v_blur FROM z")
def _(t: Tables):
    return rounded(st.gaussian_blur(_carried(t("px").select("image_id", "x", "y", cl.gray().alias("v"))), ["v"], 1.5).select("image_id", "x", "y", "v_blur"), 5)


_PAIRG = f"gp AS (SELECT image_id, x, y, {k.gray()} AS p, {k.gray('rr','rg','rb')} AS q FROM px_pair)"


def _gray_pair(t: Tables) -> DataFrame:
    return t("px_pair").select("image_id", "x", "y", cl.gray().alias("p"), cl.gray("rr", "rg", "rb").alias("q"))


@query("ssim", f"WITH {_PAIRG}, {k.ssim('s','gp','p','q',24)} SELECT image_id, round(ssim,6) AS ssim FROM s")
def _(t: Tables):
    return rounded(st.ssim(_carried(_gray_pair(t)), "p", "q"))


@query("ms_ssim", f"""WITH {k.ssim('f','px64_pair','v','rv',64)}, hf AS (SELECT image_id, CAST(FLOOR(x/2e0) AS INT) AS x, CAST(FLOOR(y/2e0) AS INT) AS y, FLOOR(AVG(v)+0.5e0) AS v, FLOOR(AVG(rv)+0.5e0) AS rv FROM px64_pair GROUP BY 1,2,3), {k.ssim('h','hf','v','rv',32)} SELECT image_id, round(0.6e0*f.ssim+0.4e0*h.ssim,6) AS ms_ssim FROM f JOIN h USING (image_id)""")
def _(t: Tables):
    return rounded(st.ms_ssim(t("px64_pair"), "v", "rv"))


_EF1 = f"""{_PAIRG}, {k.edges('e1','gp','p',80,160)}, {k.edges('e2','gp','q',80,160)}, em AS (SELECT g.image_id, g.x, g.y, CASE WHEN e1.x IS NULL THEN 0 ELSE 1 END AS ea, CASE WHEN e2.x IS NULL THEN 0 ELSE 1 END AS eb FROM gp g LEFT JOIN e1 ON e1.image_id=g.image_id AND e1.x=g.x AND e1.y=g.y LEFT JOIN e2 ON e2.image_id=g.image_id AND e2.x=g.x AND e2.y=g.y),
{k.square('ew','em',['ea','eb'],2,'MAX','_dil')}, ep AS (SELECT image_id, SUM(ea) AS na, SUM(eb) AS nb, SUM(ea*eb_dil)/NULLIF(SUM(ea),0) AS p, SUM(eb*ea_dil)/NULLIF(SUM(eb),0) AS r FROM ew GROUP BY 1),
ef AS (SELECT image_id, CASE WHEN na=0 AND nb=0 THEN 1e0 WHEN na=0 OR nb=0 THEN 0e0 WHEN p+r<1e-9 THEN 0e0 ELSE 2*p*r/(p+r) END AS edge_f1 FROM ep)"""


@query("edge_f1", f"WITH RECURSIVE {_EF1} SELECT image_id, round(edge_f1,6) AS edge_f1 FROM ef")
def _(t: Tables):
    return rounded(rg.edge_f1(_gray_pair(t), "p", "q"))


@query("fidelity_score", f"""WITH RECURSIVE {_EF1}, {k.ssim('ss','gp','p','q',24)}, {k.delta_e('z','px_pair')}, de AS (SELECT image_id, AVG(de76) AS m FROM z GROUP BY 1)
SELECT image_id, round(ss.ssim*100,2) AS ssim_score, round(GREATEST(0,100-m*5),2) AS color_score, round(edge_f1*100,2) AS edge_score, round(0.4e0*round(ss.ssim*100,2)+0.35e0*round(GREATEST(0,100-m*5),2)+0.25e0*round(edge_f1*100,2),6) AS fidelity_score FROM ss JOIN de USING (image_id) JOIN ef USING (image_id)""")
def _(t: Tables):
    g, pair = _gray_pair(t), t("px_pair")
    return rounded(px.fidelity_score(st.ms_ssim(g, "p", "q"), px.pixel_error(pair), rg.edge_f1(g, "p", "q")))


@query("boundary_offsets", f"""WITH RECURSIVE {_PAIRG}, {k.edges('e1','gp','p',80,160)}, {k.edges('e2','gp','q',80,160)}, d AS (SELECT a.image_id, a.x, a.y, MIN(sqrt(power(a.x-b.x,2)+power(a.y-b.y,2))) AS d FROM e1 a JOIN e2 b USING (image_id) GROUP BY 1,2,3 UNION ALL SELECT a.image_id, a.x, a.y, MIN(sqrt(power(a.x-b.x,2)+power(a.y-b.y,2))) FROM e2 a JOIN e1 b USING (image_id) GROUP BY 1,2,3)
SELECT image_id, round(AVG(d),6) AS chamfer_mean, round(MAX(d),6) AS hausdorff_max, round(quantile_cont(d,0.95),6) AS hausdorff_p95 FROM d GROUP BY 1""")
def _(t: Tables):
    g = _gray_pair(t)
    return rounded(rg.boundary_offsets(rg.edge_mask(g, "p", 80, 160), rg.edge_mask(g, "q", 80, 160), band=8))


@query("thin_ink_ratio", f"""WITH m AS (SELECT image_id, x, y, CASE WHEN GREATEST(255-r,255-g,255-b)>40 THEN 1 ELSE 0 END AS m FROM px), {k.square('e','m',['m'],1,'MIN','_ero')} SELECT image_id, round(CASE WHEN SUM(m)<30 THEN 0 ELSE (SUM(m)-SUM(m_ero))/SUM(m) END,6) AS thin_ink_ratio FROM e GROUP BY 1""")
def _(t: Tables):
    return rounded(st.thin_ink_ratio(t("px").withColumn("i", px.ink(tol=40)), "i"))


_MIRROR = f"""cn AS (SELECT * FROM px {_CORNER(8)}), bg AS (SELECT image_id, median(r) AS br, median(g) AS bg, median(b) AS bb FROM cn GROUP BY 1), fg AS (SELECT p.*, sqrt(power(r-br,2)+power(g-bg,2)+power(b-bb,2))>40 AS f FROM px p JOIN bg USING (image_id)), en AS (SELECT image_id FROM fg GROUP BY 1 HAVING COUNT(*) FILTER (f)>=200),
mm AS (SELECT a.image_id, s.s, COUNT(*) AS n, AVG(GREATEST(ABS(a.r-b.r),ABS(a.g-b.g),ABS(a.b-b.b))) AS sc, AVG(CASE WHEN GREATEST(ABS(a.r-b.r),ABS(a.g-b.g),ABS(a.b-b.b))>30 THEN 1e0 ELSE 0 END) AS hi FROM fg a JOIN en USING (image_id) CROSS JOIN (SELECT unnest(range(-8,9)) AS s) s JOIN fg b ON b.image_id=a.image_id AND b.y=a.y AND b.x=23-a.x+s.s WHERE a.f OR b.f GROUP BY 1,2 HAVING COUNT(*)>=200)"""


@query("mirror_score", f"WITH {_MIRROR} SELECT image_id, CAST(s AS INT) AS shift, round(sc,6) AS mean_diff, round(hi,6) AS high_ratio FROM mm QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY sc, s)=1")
def _(t: Tables):
    return rounded(px.mirror_score(t("px")))


@query("symmetrize", f"""WITH {_MIRROR}, b AS (SELECT image_id, s, sc, hi FROM mm QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY sc, s)=1), ok AS (SELECT image_id, s FROM b WHERE sc<=150 AND hi<=0.8e0)
SELECT p.image_id, p.x, p.y, CASE WHEN q.x IS NULL THEN p.r ELSE CAST(FLOOR((p.r+q.r)/2) AS INT) END AS r, CASE WHEN q.x IS NULL THEN p.g ELSE CAST(FLOOR((p.g+q.g)/2) AS INT) END AS g, CASE WHEN q.x IS NULL THEN p.b ELSE CAST(FLOOR((p.b+q.b)/2) AS INT) END AS b FROM px p LEFT JOIN ok USING (image_id) LEFT JOIN px q ON q.image_id=p.image_id AND q.y=p.y AND q.x=23-p.x+ok.s""")
def _(t: Tables):
    p = t("px")
    return px.symmetrize(p, px.mirror_score(p), mean_tol=150.0, hi_tol=0.8)


_FLAT_ROWS = """e AS (SELECT image_id, x, y, sqrt(gx*gx+gy*gy)/8e0 AS e FROM sb), n AS (SELECT p.image_id, p.x, p.y, AVG(q.e) AS energy FROM e p JOIN e q ON q.image_id=p.image_id AND ABS(q.x-p.x)<=7 AND ABS(q.y-p.y)<=7 GROUP BY 1,2,3),
fl AS (SELECT v.*, chroma<=12 AND energy<=1 AS flat FROM v JOIN n USING (image_id, x, y)), sf AS (SELECT p.image_id, p.x, p.y, p.l, p.chroma, bool_and(q.flat) AS safe FROM fl p JOIN fl q ON q.image_id=p.image_id AND ABS(q.x-p.x)<=6 AND ABS(q.y-p.y)<=6 GROUP BY 1,2,3,4,5),
us AS (SELECT image_id, AVG(CASE WHEN safe THEN 1 ELSE 0 END)>0.03e0 AS u FROM sf GROUP BY 1)"""


@query("smooth_flat_zone", f"""WITH gr AS (SELECT image_id, x, y, 128+CAST(FLOOR(x/12e0) AS INT) AS r, 128+CAST(FLOOR(x/12e0) AS INT) AS g, CASE WHEN image_id%3=0 THEN b ELSE 128+CAST(FLOOR(x/12e0) AS INT) END AS b FROM px), {k.lab8('lb', 'gr', [('r', 'g', 'b', 'z')])},
v AS (SELECT image_id, x, y, CAST(zl8 AS DOUBLE) AS l, sqrt(power(za8-128,2)+power(zb8-128,2)) AS chroma FROM lb), {k.sobel('sb', 'v', 'l', 24)}, {_FLAT_ROWS}, {k.blur('bl', 'v', ['l'], 0.3 * ((15 - 1) * 0.5 - 1) + 0.8, 24)}
SELECT sf.image_id, sf.x, sf.y, round(chroma,6) AS chroma, round(CASE WHEN u AND safe THEN l_blur ELSE l END,6) AS l, u AND safe AS smoothed FROM sf JOIN us USING (image_id) JOIN bl USING (image_id, x, y)""")
def _(t: Tables):
    grey = F.lit(128) + F.floor(F.col("x") / 12).cast("int")
    p = t("px").select("image_id", "x", "y", grey.alias("r"), grey.alias("g"), F.when(F.col("image_id") % 3 == 0, F.col("b")).otherwise(grey).alias("b"))
    lab = cl.with_lab8(p, ("r", "g", "b"), "z").select("image_id", "x", "y", F.col("zl8").cast("double").alias("l"), F.hypot(F.col("za8") - 128.0, F.col("zb8") - 128.0).alias("chroma"))
    return rounded(st.smooth_flat_zone(lab, "l", "chroma", ["l"]))


# -- markup -------------------------------------------------------------------------------

@query("markup_structure", """SELECT doc_id, CAST(len(regexp_extract_all(text,'<path\\b')) AS INT) AS path_count, CAST(len(regexp_extract_all(text,'(M|C|L|Z)[0-9 ]')) + len(regexp_extract_all(text,'Z"')) + CASE WHEN doc_id%19=0 THEN 1 ELSE 0 END AS INT) AS node_count,
 CASE WHEN doc_id%5=0 THEN 1 ELSE 0 END AS linear_gradient_count, 0 AS radial_gradient_count, CASE WHEN doc_id%41=0 THEN 1 ELSE 0 END AS mesh_gradient_count, CASE WHEN doc_id%5=0 THEN 1 ELSE 0 END + CASE WHEN doc_id%41=0 THEN 1 ELSE 0 END AS gradient_count, CASE WHEN doc_id%5=0 THEN 1 ELSE 0 END + CASE WHEN doc_id%41=0 THEN 1 ELSE 0 END AS gradient_reference_count,
 concat_ws(',', CASE WHEN doc_id%31=0 THEN 'root_not_svg' END, CASE WHEN doc_id%31=0 OR doc_id%13=0 THEN 'viewbox_missing' END, CASE WHEN doc_id%7=0 THEN 'embedded_raster' END, CASE WHEN doc_id%11=0 THEN 'event_handler' END, CASE WHEN doc_id%17=0 THEN 'external_reference' END, CASE WHEN doc_id%23=0 THEN 'unsafe_css' END, CASE WHEN doc_id%7=0 THEN 'unsafe_uri' END, CASE WHEN doc_id%19=0 THEN 'nonfinite_geometry' END) AS codes FROM markup""")
def _(t: Tables):
    return markup_structure(t("markup"), "doc_id")


@query("quality_features", None)
def _(t: Tables):
    """Measured analyzer features end to end: pixels -> features -> route."""
    p = t("px").withColumn("v", cl.gray())
    dom = px.dominant_colors(p)
    n = dom.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("estimated_color_count"))
    edges = cut_lineage(rg.edge_density(p, "v"))
    smooth = px.gradient_like(p, edges).select("image_id", F.col("gradient_like").alias("has_gradient"))
    f = (
        n.withColumn("flat_color_count", F.col("estimated_color_count")).join(edges, "image_id").join(smooth, "image_id").join(st.blur_score(p, "v"), "image_id")
        .join(px.palette_stats(dom), "image_id").join(px.foreground_stats(p).withColumnRenamed("chromatic_color_count", "foreground_color_count"), "image_id")
        .join(px.background(p).select("image_id", "is_uniform_background"), "image_id").join(px.transparency_flags(p).withColumnRenamed("alpha_foreground", "has_alpha_foreground"), "image_id")
        .join(st.thin_ink_ratio(p.withColumn("i", px.ink(tol=40)), "i"), "image_id").join(st.image_size(p).select("image_id", F.col("_w").alias("width"), F.col("_h").alias("height"), F.least("_w", "_h").alias("min_side")), "image_id")
        .withColumn("straight_edge_likelihood", F.lit(0.0)).withColumn("corner_likelihood", F.lit(0.0)).withColumn("semantic_edge_density", F.lit(None).cast("double"))
    )
    f = rt.image_quality_score(f).withColumnRenamed("image_quality", "quality_score")
    return rt.route_mode(f).select("image_id", "recommended_mode", "warnings")
