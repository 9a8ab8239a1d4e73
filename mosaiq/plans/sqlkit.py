"""SQL fragments for the oracles: each returns CTE text ``name AS (...)``.

They state the definitions directly (clamped neighbour joins, closures, kernel
sums) rather than mirroring the window plans used on the Spark side.
"""

from __future__ import annotations

import math

GRAY = "CAST(floor({r}*0.299e0+{g}*0.587e0+{b}*0.114e0+0.5e0) AS INT)"
PALETTE = [(255, 255, 255), (230, 40, 40), (30, 60, 200), (20, 20, 20), (40, 170, 80)]


def gray(r: str = "r", g: str = "g", b: str = "b") -> str:
    return GRAY.format(r=r, g=g, b=b)


def lab8(name: str, src: str, sets: list[tuple[str, str, str, str]]) -> str:
    """Adds ``{p}l8, {p}a8, {p}b8`` for each (r, g, b, prefix)."""
    lin = lambda c: f"CASE WHEN {c}/255e0<=0.04045e0 THEN {c}/255e0/12.92e0 ELSE power(({c}/255e0+0.055e0)/1.055e0,2.4e0) END"
    root = lambda t: f"CASE WHEN {t}>0.008856e0 THEN cbrt({t}) ELSE {t}*7.787e0+16e0/116e0 END"
    a = ", ".join(f"{lin(c)} AS {p}_n{i}" for r, g, b, p in sets for i, c in enumerate((r, g, b)))
    m = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
    t = ", ".join(f"({p}_n0*{k[0]}e0+{p}_n1*{k[1]}e0+{p}_n2*{k[2]}e0)/{k[3]}e0 AS {p}_t{i}" for *_, p in sets for i, k in enumerate(m))
    f = ", ".join(f"{root(f'{p}_t{i}')} AS {p}_f{i}" for *_, p in sets for i in range(3))
    clip = lambda e: f"CAST(LEAST(255,GREATEST(0,floor({e}+0.5e0))) AS INT)"
    out = ", ".join(
        f"{clip(f'(CASE WHEN {p}_t1>0.008856e0 THEN {p}_f1*116e0-16e0 ELSE {p}_t1*903.3e0 END)*2.55e0')} AS {p}l8, {clip(f'({p}_f0-{p}_f1)*500e0+128e0')} AS {p}a8, {clip(f'({p}_f1-{p}_f2)*200e0+128e0')} AS {p}b8"
        for *_, p in sets
    )
    return f"""{name}_1 AS (SELECT *, {a} FROM {src}), {name}_2 AS (SELECT *, {t} FROM {name}_1), {name}_3 AS (SELECT *, {f} FROM {name}_2), {name} AS (SELECT *, {out} FROM {name}_3)"""


def de76(p: str, q: str) -> str:
    return f"sqrt(power({p}l8-{q}l8,2)+power({p}a8-{q}a8,2)+power({p}b8-{q}b8,2))"


def delta_e(name: str, src: str) -> str:
    """Pair pixels with de76 and de00."""
    chain = lab8(f"{name}_l", src, [("r", "g", "b", "s"), ("rr", "rg", "rb", "t")])
    return chain + f""",
{name}_a AS (SELECT *, {de76('s', 't')} AS de76, sl8*100e0/255e0 AS L1, sa8-128e0 AS A1, sb8-128e0 AS B1, tl8*100e0/255e0 AS L2, ta8-128e0 AS A2, tb8-128e0 AS B2 FROM {name}_l),
{name}_b AS (SELECT *, 1+0.5e0*(1-sqrt(power((sqrt(A1*A1+B1*B1)+sqrt(A2*A2+B2*B2))/2,7)/(power((sqrt(A1*A1+B1*B1)+sqrt(A2*A2+B2*B2))/2,7)+6103515625e0+1e-12))) AS g_ FROM {name}_a),
{name}_c AS (SELECT *, sqrt(g_*A1*g_*A1+B1*B1) AS c1, sqrt(g_*A2*g_*A2+B2*B2) AS c2, CASE WHEN degrees(atan2(B1,g_*A1))<0 THEN degrees(atan2(B1,g_*A1))+360 ELSE degrees(atan2(B1,g_*A1)) END AS h1, CASE WHEN degrees(atan2(B2,g_*A2))<0 THEN degrees(atan2(B2,g_*A2))+360 ELSE degrees(atan2(B2,g_*A2)) END AS h2 FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN h2-h1>180 THEN h2-h1-360 WHEN h2-h1<-180 THEN h2-h1+360 ELSE h2-h1 END AS dh, (L1+L2)/2 AS lb, (c1+c2)/2 AS cb, CASE WHEN c1*c2=0 THEN h1+h2 WHEN ABS(h1-h2)>180 THEN (h1+h2+360)/2 ELSE (h1+h2)/2 END AS hb FROM {name}_c),
{name}_e AS (SELECT *, (L2-L1)/(1+0.015e0*(lb-50)*(lb-50)/sqrt(20+(lb-50)*(lb-50))) AS e1, (c2-c1)/(1+0.045e0*cb) AS e2,
 2*sqrt(c1*c2)*sin(radians(dh)/2)/(1+0.015e0*cb*(1-0.17e0*cos(radians(hb-30))+0.24e0*cos(radians(2*hb))+0.32e0*cos(radians(3*hb+6))-0.2e0*cos(radians(4*hb-63)))) AS e3,
 -2*sqrt(power(cb,7)/(power(cb,7)+6103515625e0+1e-12))*sin(radians(60*exp(-power((hb-275)/25,2)))) AS rt FROM {name}_d),
{name} AS (SELECT *, sqrt(GREATEST(0e0, e1*e1+e2*e2+e3*e3+rt*e2*e3)) AS de00 FROM {name}_e)"""


def components(name: str, src: str, label: str = "label", conn: int = 4) -> str:
    """Pixels of ``src`` with ``region`` (needs WITH RECURSIVE)."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (conn == 8 or not (dx and dy))]
    before = " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM {name}_p b WHERE b.image_id=a.image_id AND b.x=a.x{dx:+d} AND b.y=a.y{dy:+d} AND b.label=a.label)" for dx, dy in steps if (dy, dx) < (0, 0)
    )
    values = ",".join(f"({dx},{dy})" for dx, dy in steps)
    return f"""{name}_p AS (SELECT image_id, x, y, {label} AS label FROM {src}),
{name}_c(image_id, s, x, y, label) AS (SELECT image_id, CAST(y AS BIGINT)*4294967296+x, x, y, label FROM {name}_p a WHERE {before}
 UNION SELECT c.image_id, c.s, p.x, p.y, p.label FROM {name}_c c CROSS JOIN (VALUES {values}) o(dx,dy) JOIN {name}_p p ON p.image_id=c.image_id AND p.x=c.x+o.dx AND p.y=c.y+o.dy AND p.label=c.label),
{name} AS (SELECT image_id, x, y, label, MIN(s) AS region FROM {name}_c GROUP BY image_id, x, y, label)"""


def square(name: str, src: str, cols: list[str], r: int, fn: str, suffix: str) -> str:
    """``src`` with the square-neighbourhood max/min of 0/1 columns."""
    aggs = ", ".join(f"{fn}(q.{c}) AS {c}{suffix}" for c in cols)
    return f"""{name} AS (SELECT p.*, n.* EXCLUDE (image_id, x, y) FROM {src} p JOIN (SELECT p.image_id, p.x, p.y, {aggs} FROM {src} p CROSS JOIN (SELECT unnest(range(-{r},{r}+1)) AS dx) a CROSS JOIN (SELECT unnest(range(-{r},{r}+1)) AS dy) b
 JOIN {src} q ON q.image_id=p.image_id AND q.x=p.x+dx AND q.y=p.y+dy GROUP BY p.image_id, p.x, p.y) n ON n.image_id=p.image_id AND n.x=p.x AND n.y=p.y)"""


_SOBEL = "(VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)) k(dx,dy,wx,wy)"


def sobel(name: str, src: str, v: str, size: int, clamp: bool = False) -> str:
    """(image_id, x, y, gx, gy) with mirrored (or clamped) border on size x size rasters."""
    m = size - 1
    fold = (lambda c, d: f"LEAST({m},GREATEST(0,{c}+{d}))") if clamp else (lambda c, d: f"CASE WHEN {c}+{d}<0 THEN 1 WHEN {c}+{d}>{m} THEN {m - 1} ELSE {c}+{d} END")
    return f"""{name} AS (SELECT p.image_id, p.x, p.y, CAST(SUM(k.wx*q.{v}) AS DOUBLE) AS gx, CAST(SUM(k.wy*q.{v}) AS DOUBLE) AS gy FROM {src} p CROSS JOIN {_SOBEL}
 JOIN {src} q ON q.image_id=p.image_id AND q.x={fold('p.x', 'k.dx')} AND q.y={fold('p.y', 'k.dy')} GROUP BY p.image_id, p.x, p.y)"""


def edge_candidates(name: str, src: str, v: str, lo: float, hi: float, size: int = 24) -> str:
    """(image_id, x, y, st) with st 0 none, 1 weak, 2 strong."""
    return sobel(f"{name}_s", src, v, size, clamp=True) + f""",
{name}_m AS (SELECT *, ABS(gx)+ABS(gy) AS m, CASE WHEN ABS(gy)*32768<ABS(gx)*13573 THEN 0 WHEN ABS(gy)*32768>ABS(gx)*13573+ABS(gx)*65536 THEN 1 WHEN (gx<0)<>(gy<0) THEN 2 ELSE 3 END AS d FROM {name}_s),
{name}_n AS (SELECT p.*, COALESCE(a.m,0) AS ma, COALESCE(b.m,0) AS mb FROM {name}_m p
 LEFT JOIN {name}_m a ON a.image_id=p.image_id AND a.x=p.x+CASE p.d WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END AND a.y=p.y+CASE p.d WHEN 0 THEN 0 ELSE -1 END
 LEFT JOIN {name}_m b ON b.image_id=p.image_id AND b.x=p.x+CASE p.d WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END AND b.y=p.y+CASE p.d WHEN 0 THEN 0 ELSE 1 END),
{name} AS (SELECT image_id, x, y, CASE WHEN m>ma AND (CASE WHEN d<2 THEN m>=mb ELSE m>mb END) THEN CASE WHEN m>{hi} THEN 2 WHEN m>{lo} THEN 1 ELSE 0 END ELSE 0 END AS st FROM {name}_n)"""


def edges(name: str, src: str, v: str, lo: float, hi: float, size: int = 24) -> str:
    """(image_id, x, y) of edge pixels after hysteresis."""
    return (
        edge_candidates(f"{name}_k", src, v, lo, hi, size) + f", {name}_w AS (SELECT *, 1 AS label FROM {name}_k WHERE st>0), "
        + components(f"{name}_g", f"{name}_w", "label", 8)
        + f""", {name} AS (SELECT g.image_id, g.x, g.y FROM {name}_g g WHERE (g.image_id, g.region) IN (SELECT h.image_id, h.region FROM {name}_g h JOIN {name}_k k USING (image_id, x, y) WHERE k.st=2))"""
    )


def blur(name: str, src: str, values: list[str], sigma: float, size: int) -> str:
    """(image_id, x, y, {v}_blur): separable Gaussian, border mirrored with the edge repeated."""
    r = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    kernel = "(VALUES " + ",".join(f"({k - r},{x / total!r})" for k, x in enumerate(w)) + ") k(d,w)"
    fold = lambda c: f"CASE WHEN {c}+k.d<0 THEN -({c}+k.d)-1 WHEN {c}+k.d>={size} THEN {2 * size - 1}-({c}+k.d) ELSE {c}+k.d END"
    h = ", ".join(f"SUM(CAST(k.w AS DOUBLE)*q.{v}) AS {v}" for v in values)
    o = ", ".join(f"SUM(CAST(k.w AS DOUBLE)*q.{v}) AS {v}_blur" for v in values)
    return f"""{name}_h AS (SELECT p.image_id, p.x, p.y, {h} FROM {src} p CROSS JOIN {kernel} JOIN {src} q ON q.image_id=p.image_id AND q.y=p.y AND q.x={fold('p.x')} GROUP BY p.image_id, p.x, p.y),
{name} AS (SELECT p.image_id, p.x, p.y, {o} FROM {name}_h p CROSS JOIN {kernel} JOIN {name}_h q ON q.image_id=p.image_id AND q.x=p.x AND q.y={fold('p.y')} GROUP BY p.image_id, p.x, p.y)"""


def ssim(name: str, src: str, a: str, b: str, size: int) -> str:
    """(image_id, ssim)."""
    c1, c2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2
    return (
        f"{name}_i AS (SELECT image_id, x, y, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, CAST({a} AS DOUBLE)*{a} AS aa, CAST({b} AS DOUBLE)*{b} AS bb, CAST({a} AS DOUBLE)*{b} AS ab FROM {src}), "
        + blur(f"{name}_g", f"{name}_i", ["a", "b", "aa", "bb", "ab"], 1.5, size)
        + f""", {name} AS (SELECT image_id, LEAST(1e0,GREATEST(0e0,AVG((2*a_blur*b_blur+{c1}e0)*(2*(ab_blur-a_blur*b_blur)+{c2}e0)/((a_blur*a_blur+b_blur*b_blur+{c1}e0)*(aa_blur-a_blur*a_blur+bb_blur-b_blur*b_blur+{c2}e0))))) AS ssim FROM {name}_g GROUP BY image_id)"""
    )


def nearest(r: str, g: str, b: str, palette: list[tuple[int, int, int]] = PALETTE) -> tuple[str, str]:
    """(index, squared distance) expressions of the nearest palette colour, lowest index on ties."""
    d = [f"(({r}-{p[0]})*({r}-{p[0]})+({g}-{p[1]})*({g}-{p[1]})+({b}-{p[2]})*({b}-{p[2]}))" for p in palette]
    low = f"LEAST({','.join(d)})"
    index = "CASE " + " ".join(f"WHEN {x}={low} THEN {i}" for i, x in enumerate(d)) + " END"
    return index, low
