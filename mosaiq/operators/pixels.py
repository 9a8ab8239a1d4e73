"""Aggregates over pixel tables keyed by image_id.

Pixels: image_id, x, y, r, g, b, a; pairs add rr, rg, rb, ra (rendered).
Palettes travel as bounded arrays of (r, g, b) per image.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.functions import color as cl
from mosaiq.operators import stencil as st
from mosaiq.operators.ordered import exact_percentiles, map_whole_groups, new_groups
from mosaiq.session import cut_lineage, meet

IMG = "image_id"


def _mean_abs(pairs: list[tuple[str, str]]) -> Column:
    return sum((F.abs(F.col(p) - F.col(q)) for p, q in pairs), F.lit(0.0)) / len(pairs)


RGB_PAIR = [("r", "rr"), ("g", "rg"), ("b", "rb")]


def dist(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def rgb(prefix: str = "") -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}r"), F.col(f"{prefix}g"), F.col(f"{prefix}b")


# -- alpha and background ------------------------------------------------------

def roundtrip_error(px: DataFrame) -> DataFrame:
    """Mean and maximum error of premultiply -> unpremultiply where alpha > .02."""
    back = px.select(IMG, "a", "r", "g", "b", *[cl.unpremultiply(cl.premultiply(c)).alias(f"q{c}") for c in "rgb"])
    err = F.when(F.col("a") / 255.0 > 0.02, _mean_abs([(c, f"q{c}") for c in "rgb"]) / 255.0)
    return back.groupBy(IMG).agg(
        F.coalesce(F.avg(err), F.lit(0.0)).alias("roundtrip_mae"), F.coalesce(F.max(err), F.lit(0.0)).alias("roundtrip_max")
    )


def composite_pair(pair: DataFrame, cell: int) -> DataFrame:
    """Both sides over white, black and checker: one row per pixel and background."""
    grounds = F.explode(F.array(*map(F.lit, ("white", "black", "checker")))).alias("background")
    df = pair.select("*", grounds)
    bg = F.when(F.col("background") == "white", 255).when(F.col("background") == "black", 0).otherwise(cl.checker(cell=cell))
    df = df.withColumn("_bg", bg)
    over = lambda c, a: cl.alpha_over(c, a, F.col("_bg"))
    return df.select(
        IMG, "background", "x", "y", *[over(c, "a").alias(f"s{c}") for c in "rgb"], *[over(f"r{c}", "ra").alias(f"t{c}") for c in "rgb"]
    )


def multibackground(pair: DataFrame, cell: int = 4, with_ssim: bool = True) -> DataFrame:
    """MAE, p95 of channel error and similarity per image and background."""
    df = composite_pair(pair, cell)
    chans = df.select(IMG, "background", F.explode(F.array(*[F.abs(F.col(f"s{c}") - F.col(f"t{c}")) / 255.0 for c in "rgb"])).alias("e"))
    out = chans.groupBy(IMG, "background").agg(F.avg("e").alias("rgb_mae"))
    # channel errors have at most 256 distinct values, so the exact percentile buffer is bounded
    out = out.join(chans.groupBy(IMG, "background").agg(F.percentile("e", F.lit(0.95)).alias("rgb_p95")), [IMG, "background"])
    if with_ssim:
        key = F.concat_ws("|", F.col(IMG).cast("string"), "background")
        grey = df.select(key.alias(IMG), "x", "y", cl.gray("sr", "sg", "sb").alias("p"), cl.gray("tr", "tg", "tb").alias("q"))
        sim = st.ssim(grey, "p", "q")
        out = out.withColumn("_k", key).join(sim.withColumnRenamed(IMG, "_k"), "_k").drop("_k")
    return out


def alpha_metrics(pair: DataFrame) -> DataFrame:
    """Soft and binary IoU, MAE, p95, max and coverages of the alpha planes."""
    s, t = F.col("a"), F.col("ra")
    d = F.abs(s - t) / 255.0
    union = F.count_if((s >= 1) | (t >= 1))
    return pair.groupBy(IMG).agg(
        F.when(F.sum(F.greatest(s, t)) > 0, F.sum(F.least(s, t)) / F.sum(F.greatest(s, t))).otherwise(1.0).alias("alpha_iou"),
        F.when(union > 0, F.count_if((s >= 1) & (t >= 1)) / union).otherwise(1.0).alias("alpha_binary_iou"),
        F.avg(d).alias("alpha_mae"), F.percentile(d, F.lit(0.95)).alias("alpha_p95"), F.max(d).alias("alpha_max"),
        (F.avg(s) / 255.0).alias("source_coverage"), (F.avg(t) / 255.0).alias("render_coverage"),
    )


def alpha_profile(px: DataFrame, a: str = "a") -> DataFrame:
    c = F.col(a)
    return px.groupBy(IMG).agg(
        F.bool_or(c < 255).alias("has_alpha"), (F.avg(c) / 255.0).alias("soft_coverage"),
        (F.count_if(c >= 1) / F.count(c)).alias("binary_coverage"), (F.count_if(c == 0) / F.count(c)).alias("fully_transparent_ratio"),
        (F.count_if((c > 0) & (c < 255)) / F.count(c)).alias("partial_alpha_ratio"), (F.count_if(c == 255) / F.count(c)).alias("fully_opaque_ratio"),
    )


def alpha_diagnosis(pair: DataFrame) -> DataFrame:
    """What happened to the alpha plane of a render."""
    m = alpha_metrics(pair).join(alpha_profile(pair).select(IMG, "has_alpha"), IMG)
    c = F.col
    label = (
        F.when(~c("has_alpha"), "not_applicable_opaque_source")
        .when((c("alpha_iou") >= 0.98) & (c("alpha_mae") <= 0.02), "alpha_preserved")
        .when((c("render_coverage") >= 0.995) & (F.abs(c("alpha_iou") - c("source_coverage")) <= 1e-4), "opaque_canvas_collapse")
        .when(c("render_coverage") - c("source_coverage") >= 0.10, "alpha_overcoverage")
        .otherwise("alpha_shape_regression")
    )
    return m.select(IMG, "has_alpha", "alpha_iou", "alpha_mae", label.alias("diagnosis"))


def halo_metrics(pair: DataFrame) -> DataFrame:
    """Weighted colour error on the alpha boundary; null without boundary pixels."""
    df = st.gradient(pair, "a").where((F.col("grad") > 1.0) & (F.col("a") > 2))
    err = _mean_abs(RGB_PAIR) / 255.0 * F.greatest(F.col("a") / 255.0, F.lit(0.05))
    df = df.select(IMG, err.alias("e"))
    n = df.groupBy(IMG).agg(F.avg("e").alias("halo_rgb_mae"), F.count("e").alias("halo_sample_count"))
    n = n.join(exact_percentiles(df, [IMG], "e", {"halo_rgb_p95": 0.95}), IMG)
    return pair.select(IMG).distinct().join(n, IMG, "left").select(
        IMG, "halo_rgb_mae", "halo_rgb_p95", F.coalesce("halo_sample_count", F.lit(0)).alias("halo_sample_count")
    )


def transparency_flags(px: DataFrame) -> DataFrame:
    a, n = F.col("a"), F.count("a")
    return px.groupBy(IMG).agg(
        F.bool_or(a < 250).alias("has_transparency"),
        ((F.count_if(a > 12) / n > 0.005) & (F.count_if(a < 245) / n > 0.005)).alias("alpha_foreground"),
    )


def corner_patches(px: DataFrame, fraction: float, minimum: int = 8) -> DataFrame:
    """Pixels of the four corner patches (with _w, _h)."""
    return st.sized(px).where(_in_corner(fraction, minimum))


def _in_corner(fraction: float = 1 / 12, minimum: int = 8) -> Column:
    pw, ph = F.greatest(F.lit(minimum), F.floor(F.col("_w") * fraction)), F.greatest(F.lit(minimum), F.floor(F.col("_h") * fraction))
    edge_x = (F.col("x") < pw) | (F.col("x") >= F.col("_w") - pw)
    edge_y = (F.col("y") < ph) | (F.col("y") >= F.col("_h") - ph)
    return edge_x & edge_y


def corner_color(px: DataFrame, fraction: float = 1 / 12, minimum: int = 8) -> DataFrame:
    """Median corner colour per image (8-bit values keep the buffers bounded)."""
    return corner_patches(px, fraction, minimum).groupBy(IMG).agg(*[F.median(c).alias(f"bg{c}") for c in "rgb"])


def background(px: DataFrame) -> DataFrame:
    """Background colour, type and uniformity from the corner patches."""
    corners = corner_patches(px, 0.08)
    bg = corners.groupBy(IMG).agg(*[F.median(c).alias(f"bg{c}") for c in "rgb"])
    near = dist(rgb(), rgb("bg")) < 18
    n = F.count(F.lit(1))
    g = st.with_known(corners, bg, [IMG]).groupBy(IMG).agg(
        *[F.first(f"bg{c}").alias(f"bg{c}") for c in "rgb"],
        (F.count_if(near) / n).alias("uniformity"), (F.count_if(F.col("a") < 245) / n).alias("transparent"),
    )
    light = (F.col("bgr") + F.col("bgg") + F.col("bgb")) / 3
    return g.select(
        IMG, *[F.floor(f"bg{c}").cast("int").alias(f"background_{c}") for c in "rgb"],
        F.when(F.col("transparent") > 0.45, "transparent").when(light > 235, "white").when(light < 25, "black").otherwise("colored").alias("background_type"),
        F.bround("uniformity", 4).alias("background_uniformity"), F.bround("transparent", 4).alias("transparent_corner_ratio"),
        ((F.col("uniformity") > 0.82) | (F.col("transparent") > 0.45)).alias("is_uniform_background"),
    )


# -- palettes --------------------------------------------------------------------

def dominant_colors(px: DataFrame, min_ratio: float = 0.002, bucket: int = 16) -> DataFrame:
    """Mean colour and share of each occupied colour bucket (uniform buckets)."""
    cell = [F.floor(F.col(c) / bucket).alias(f"_k{c}") for c in "rgb"]
    g = px.groupBy(IMG, *cell).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"))
    total = px.groupBy(IMG).agg(F.count(F.lit(1)).alias("_t"))
    g = g.join(total, IMG).withColumn("ratio", F.col("n") / F.col("_t")).where(F.col("ratio") >= min_ratio)
    return g.select(IMG, "r", "g", "b", "n", F.bround("ratio", 4).alias("ratio"))


def _d2(a: str, b: str) -> str:
    return f"(({a}.r-{b}.r)*({a}.r-{b}.r)+({a}.g-{b}.g)*({a}.g-{b}.g)+({a}.b-{b}.b)*({a}.b-{b}.b))"


def merge_near_colors(colors: DataFrame, threshold: float = 22) -> DataFrame:
    """Greedy first-fit merge in share order with weighted means.

    One image has at most 1/min_ratio colours, so its sorted list is bounded.
    """
    ordered = colors.groupBy(IMG).agg(
        F.expr("transform(array_sort(collect_list(struct(-ratio AS k, r, g, b, ratio))), s -> struct(double(s.r) AS r, double(s.g) AS g, double(s.b) AS b, double(s.ratio) AS ratio))").alias("cs")
    )
    mean = lambda c: f"bround((it.{c}*it.ratio+x.{c}*x.ratio)/(it.ratio+x.ratio))"
    fold = f"""aggregate(cs, cast(array() as array<struct<r:double,g:double,b:double,ratio:double>>), (acc, x) ->
      CASE WHEN exists(acc, it -> {_d2('it', 'x')} <= {threshold * threshold})
      THEN transform(acc, (it, i) -> CASE WHEN i = array_position(transform(acc, it -> {_d2('it', 'x')} <= {threshold * threshold}), true) - 1
        THEN named_struct('r', {mean('r')}, 'g', {mean('g')}, 'b', {mean('b')}, 'ratio', bround(it.ratio+x.ratio, 4)) ELSE it END)
      ELSE concat(acc, array(x)) END)"""
    out = ordered.select(IMG, F.posexplode(F.expr(fold)).alias("pos", "c"))
    return out.select(IMG, F.col("pos").alias("ord"), *[F.col(f"c.{k}").cast("int").alias(k) for k in "rgb"], F.col("c.ratio").alias("ratio"))


def consolidate_palette(
    weights: DataFrame, max_colors: int, merge_tol: float = 12.0, canonical: list[tuple[int, int, int]] | None = None, snap_tol: float = 42.0
) -> DataFrame:
    """Map each fill (image_id, r, g, b, weight) to its final palette colour fr, fg, fb.

    Fills are clustered in weight order around first representatives, the
    heaviest clusters kept, snapped to canonical colours, and every fill goes to
    the nearest kept one.  A document's palette is a bounded list.
    """
    lst = "array<struct<r:double,g:double,b:double,w:double>>"
    t2 = merge_tol * merge_tol
    ordered = weights.groupBy(IMG).agg(
        F.expr("transform(array_sort(collect_list(struct(-weight AS k, r, g, b, weight))), s -> struct(double(s.r) AS r, double(s.g) AS g, double(s.b) AS b, double(s.weight) AS w))").alias("cs")
    )
    fold = f"""aggregate(cs, cast(array() as {lst}), (acc, x) -> CASE WHEN exists(acc, it -> {_d2('it', 'x')} <= {t2})
      THEN transform(acc, (it, i) -> CASE WHEN i = array_position(transform(acc, it -> {_d2('it', 'x')} <= {t2}), true) - 1 THEN named_struct('r', it.r, 'g', it.g, 'b', it.b, 'w', it.w + x.w) ELSE it END)
      ELSE concat(acc, array(x)) END)"""
    kept = ordered.withColumn("cl", F.expr(fold)).withColumn(
        "kept", F.expr(f"slice(array_sort(transform(cl, (c, i) -> struct(-c.w AS k, i AS i, c AS c))), 1, {max_colors})")
    )
    if canonical:
        options = "array(" + ",".join(f"named_struct('r', {r}d, 'g', {g}d, 'b', {b}d)" for r, g, b in canonical) + ")"
        best = f"array_min(transform({options}, (o, j) -> struct({_d2('o', 'c.c')} AS d, j AS j, o AS o)))"
        final = f"CASE WHEN {best}.d <= {snap_tol * snap_tol} THEN named_struct('r', {best}.o.r, 'g', {best}.o.g, 'b', {best}.o.b) ELSE named_struct('r', c.c.r, 'g', c.c.g, 'b', c.c.b) END"
    else:
        final = "named_struct('r', c.c.r, 'g', c.c.g, 'b', c.c.b)"
    kept = kept.select(IMG, F.expr(f"transform(kept, c -> struct(c.c AS c, {final} AS f))").alias("kept"))
    j = weights.join(kept, IMG).withColumn("s", F.struct("r", "g", "b"))
    pick = F.expr(f"array_min(transform(kept, (k, i) -> struct({_d2('k.c', 's')} AS d, i AS i, k.f AS f))).f")
    j = j.withColumn("f", pick)
    return j.select(IMG, "r", "g", "b", *[F.col(f"f.{c}").cast("int").alias(f"f{c}") for c in "rgb"])


CUBE = 16
"""Side of a cell of the colour cube."""
TILE = 256
"""Side of a tile of the raster whose colours are tested together."""
_REACH = CUBE / 2 * 3 ** 0.5 + 1e-6


class _Mixtures:
    """Segments and triangles of a palette, looked up by cell of the colour cube."""

    def __init__(self, anchors: np.ndarray, tol: float):
        n, self.tol = len(anchors), tol
        i, j = np.triu_indices(n, 1)
        self.a, self.u = anchors[i], anchors[j] - anchors[i]
        self.uu = (self.u * self.u).sum(axis=1)
        line = self.uu >= 1e-9
        self.a, self.u, self.uu = self.a[line], self.u[line], self.uu[line]
        three = [(p, q, r) for p in range(n) for q in range(p + 1, n) for r in range(q + 1, n)]
        p, q, r = (np.array(x, dtype=int) for x in zip(*three)) if three else (np.zeros(0, int),) * 3
        self.o, self.p, self.q = anchors[p], anchors[q] - anchors[p], anchors[r] - anchors[p]
        pp, pq, qq = ((x * y).sum(axis=1) for x, y in ((self.p, self.p), (self.p, self.q), (self.q, self.q)))
        det = pp * qq - pq * pq
        flat = det >= 1e-9
        self.o, self.p, self.q = self.o[flat], self.p[flat], self.q[flat]
        self.pp, self.pq, self.qq, self.det = pp[flat], pq[flat], qq[flat], det[flat]

    def _lines(self, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = c[:, None] - self.a[k]
        wu, ww = (w * self.u[k]).sum(axis=2), (w * w).sum(axis=2)
        return wu / self.uu[k], np.sqrt(np.maximum(0.0, ww - wu * wu / self.uu[k]))

    def _planes(self, c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = c[:, None] - self.o[k]
        wp, wq = (w * self.p[k]).sum(axis=2), (w * self.q[k]).sum(axis=2)
        s = (self.qq[k] * wp - self.pq[k] * wq) / self.det[k]
        t = (self.pp[k] * wq - self.pq[k] * wp) / self.det[k]
        return s, t, np.sqrt(((w - s[:, :, None] * self.p[k] - t[:, :, None] * self.q[k]) ** 2).sum(axis=2))

    def near(self, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments and triangles that can hold a colour of the cell around ``centre``."""
        t, miss = self._lines(centre[None], np.arange(len(self.uu)))
        slack = _REACH / np.sqrt(self.uu)
        lines = np.flatnonzero((miss[0] <= self.tol + _REACH) & (t[0] >= 0.04 - slack) & (t[0] <= 0.96 + slack))
        s, t, miss = self._planes(centre[None], np.arange(len(self.det)))
        gs, gt = _REACH * np.sqrt(self.qq / self.det), _REACH * np.sqrt(self.pp / self.det)
        planes = np.flatnonzero((miss[0] <= self.tol + _REACH) & (s[0] >= -0.02 - gs) & (t[0] >= -0.02 - gt) & (s[0] + t[0] <= 1.02 + gs + gt))
        return lines, planes

    def holds(self, colors: np.ndarray, lines: np.ndarray, planes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(colors), dtype=bool)
        for a in range(0, len(lines), 256):
            t, miss = self._lines(colors, lines[a : a + 256])
            out |= ((t >= 0.04) & (t <= 0.96) & (miss <= self.tol)).any(axis=1)
        for a in range(0, len(planes), 256):
            left = np.flatnonzero(~out)
            s, t, miss = self._planes(colors[left], planes[a : a + 256])
            out[left] = ((s >= -0.02) & (t >= -0.02) & (s + t <= 1.02) & (miss <= self.tol)).any(axis=1)
        return out


def _alike(number: np.ndarray) -> list[np.ndarray]:
    """Places of each value of ``number``, which counts from 0 without gaps."""
    return np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])


def mixture_of(px: DataFrame, anchors: DataFrame, tol: float = 26.0) -> DataFrame:
    """Adds ``is_mixture``: the colour (r, g, b) lies within ``tol`` of a segment or triangle of the image's anchors.

    ``anchors(image_id, anchors)`` holds one bounded array of colours for each image. Each distinct colour of a
    tile of the raster is tested once, and only against the segments and triangles that come near its cell of the colour cube;
    pixels learn their colour's answer. Images without anchors have no mixtures.
    """
    place = [F.floor(F.col(c) / TILE).alias(f"_t{c}") for c in "xy"]
    tiled = px.select("*", *place)
    keys = [IMG, "_tx", "_ty", "r", "g", "b"]
    kinds = dict(px.dtypes)
    schema = f"{IMG} {kinds[IMG]}, _tx long, _ty long, " + ", ".join(f"{c} {kinds[c]}" for c in "rgb") + ", is_mixture boolean"

    def test(t: pa.Table) -> pa.Table:
        palettes = t.column("anchors").combine_chunks()
        names = [str(p) for p in palettes.take(np.flatnonzero(new_groups(t, (IMG,)))).to_pylist()]
        # images of one palette are tested together
        which = np.unique(names, return_inverse=True)[1][np.cumsum(new_groups(t, (IMG,))) - 1]
        rgb = np.stack([t.column(c).to_numpy().astype(float) for c in "rgb"], axis=1)
        out = np.zeros(len(rgb), dtype=bool)
        for own in _alike(which):
            points = np.array([[a["r"], a["g"], a["b"]] for a in palettes[int(own[0])].as_py()], dtype=float).reshape(-1, 3)
            tool = _Mixtures(points, tol)
            cells, cell = np.unique(np.floor(rgb[own] / CUBE), axis=0, return_inverse=True)
            for k, at in enumerate(_alike(cell.ravel())):
                colors, color = np.unique(rgb[own[at]], axis=0, return_inverse=True)
                out[own[at]] = tool.holds(colors, *tool.near(cells[k] * CUBE + CUBE / 2))[color.ravel()]
        return t.drop_columns(["anchors"]).append_column("is_mixture", pa.array(out))

    colors = tiled.select(*keys).distinct()
    asked = st.with_known(colors, anchors.select(IMG, "anchors"), [IMG]).where("anchors is not null").select(*keys, "anchors")
    # a tile has so many pixels at most, so a colour that most pixels have meets its answer in many tasks
    known = map_whole_groups(asked, [IMG, "_tx", "_ty"], [], test, schema)
    out = tiled.join(known, keys, "left")
    return out.withColumn("is_mixture", F.coalesce("is_mixture", F.lit(False))).select(*px.columns, "is_mixture")


def palette_array(colors: DataFrame, order: str = "ord") -> DataFrame:
    """(image_id, centers) from bounded colour rows, sorted by ``order``."""
    return colors.groupBy(IMG).agg(
        F.expr(f"transform(array_sort(collect_list(struct({order} AS k, r, g, b))), s -> struct(double(s.r) AS r, double(s.g) AS g, double(s.b) AS b))").alias("centers")
    )


def nearest_center(px: DataFrame, centers: DataFrame, source: str = "named_struct('r', r, 'g', g, 'b', b)", out: str = "center") -> DataFrame:
    """Adds the index of the nearest centre (lowest on ties) and its squared distance.

    ``centers(image_id, centers)`` holds one bounded array per image.
    """
    j = st.with_known(px, centers, [IMG]).withColumn("_s", F.expr(source))
    best = F.expr(f"array_min(transform(centers, (c, i) -> struct({_d2('c', '_s')} AS d2, i AS i)))")
    return j.withColumn("_m", best).withColumn(out, F.col("_m.i")).withColumn(f"{out}_d2", F.col("_m.d2").cast("double")).drop("_s", "_m", "centers")


def distinct_color_ratio(px: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct 8-level colours per pixel.

    ``approximate`` uses a bounded sketch instead of the exact distinct count.
    """
    key = F.floor(F.col("r") / 8) * 1024 + F.floor(F.col("g") / 8) * 32 + F.floor(F.col("b") / 8)
    n = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return px.groupBy(IMG).agg((n / F.count(F.lit(1))).alias("distinct_color_ratio"))


def gradient_like(px: DataFrame, edges: DataFrame) -> DataFrame:
    """Flag: many tones and mostly smooth.  ``edges(image_id, edge_density)``."""
    return distinct_color_ratio(px).join(edges, IMG).select(
        IMG, "distinct_color_ratio",
        ((F.col("distinct_color_ratio") > 0.095) & (1.0 - F.col("edge_density") > 0.68)).alias("gradient_like"),
    )


def palette_stats(colors: DataFrame) -> DataFrame:
    """Saturation, colour-family and signature statistics of dominant colours with ratios."""
    r, g, b = rgb()
    sat, ratio = cl.saturation(), F.col("ratio")
    red = (r >= 165) & (g <= 115) & (b <= 115) & (r > g * 1.28) & (r > b * 1.28) & (F.abs(g - b) <= 45)
    part = lambda cond: F.bround(F.coalesce(F.sum(F.when(cond, ratio)), F.lit(0.0)), 4)
    return colors.groupBy(IMG).agg(
        part(sat >= 55).alias("saturated_ratio"), part(sat <= 30).alias("neutral_ratio"),
        part(red).alias("red_like_ratio"), part(~red & (sat >= 55)).alias("non_red_saturated_ratio"),
        F.bool_or(F.greatest("r", "g", "b") <= 45).alias("has_black"), F.bool_or(F.least("r", "g", "b") >= 218).alias("has_white"),
        F.bool_or((r >= 165) & (g <= 105) & (b <= 105) & (r > g * 1.35) & (F.abs(g - b) <= 45)).alias("has_red"),
        F.count_distinct(F.when(cl.is_vivid(), cl.hue_bucket30())).alias("vivid_hue_count"),
    )


def foreground_stats(px: DataFrame) -> DataFrame:
    """Chromatic colour count and vivid share of the foreground over white."""
    w = F.col("a") / 255.0
    df = px.select(IMG, "a", *[F.floor(F.col(c) * w + (1.0 - w) * 255.0).cast("int").alias(c) for c in "rgb"])
    fg = (dist(rgb(), (F.lit(255), F.lit(255), F.lit(255))) > 40) & (F.col("a") > 40)
    sat = cl.saturation()
    key = F.floor(F.col("r") / 16) * 256 + F.floor(F.col("g") / 16) * 16 + F.floor(F.col("b") / 16)
    chroma = fg & (sat >= 35)
    return df.groupBy(IMG).agg(
        F.when(F.count_if(chroma) < 20, 0).otherwise(F.count_distinct(F.when(chroma, key))).alias("chromatic_color_count"),
        F.bround(F.count_if(fg & (sat >= 60)) / F.greatest(F.lit(1), F.count_if(fg)), 4).alias("vivid_ratio"),
    )


# -- paired colour measures --------------------------------------------------------

def with_delta_e(pair: DataFrame) -> DataFrame:
    """Adds de76 (8-bit scale) and de00 per pixel pair."""
    df = cl.with_lab(cl.with_lab(pair, ("r", "g", "b"), "s"), ("rr", "rg", "rb"), "t")
    df = cl.with_ciede2000(df.withColumn("de76", cl.delta_e76_lab8("s", "t")), "s", "t", "de00")
    return df.drop(*[f"{p}{k}" for p in "st" for k in ("l8", "a8", "b8", "L", "A", "B")])


def color_metrics(pair: DataFrame) -> DataFrame:
    """Mean, p50, p95, p99 and max CIEDE2000 per image.

    Pixels of equal colours are counted first, and those that did not change are one: the formula is for what differs.
    """
    same = reduce(lambda p, q: p & q, [F.col(p) == F.col(q) for p, q in RGB_PAIR])
    colours = [F.when(same, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("r", "g", "b", "rr", "rg", "rb")]
    counts = pair.select(IMG, *colours).groupBy(IMG, "r", "g", "b", "rr", "rg", "rb").agg(F.count(F.lit(1)).alias("_times"))
    de = with_delta_e(counts).select(IMG, "de00", "_times")
    out = exact_percentiles(de, [IMG], "de00", {"de00_p50": 0.5, "de00_p95": 0.95, "de00_p99": 0.99}, stats=True, times="_times")
    return out.withColumnsRenamed({"mean": "de00_mean", "max": "de00_max"})


def pixel_error(pair: DataFrame) -> DataFrame:
    """MAE, RMSE, changed ratio (> 18 on a channel) and high-error ratio (distance > 18)."""
    diffs = [F.abs(F.col(p) - F.col(q)) for p, q in RGB_PAIR]
    sq = sum((d * d for d in diffs), F.lit(0.0))
    df = with_delta_e(pair)
    n = F.count(F.lit(1))
    return df.groupBy(IMG).agg(
        F.avg(_mean_abs(RGB_PAIR)).alias("mae"), F.sqrt(F.avg(sq / 3)).alias("rmse"),
        (F.count_if(F.greatest(*diffs) > 18) / n).alias("changed_pixel_ratio"), (F.count_if(F.col("de76") > 18.0) / n).alias("high_error_ratio"),
        F.avg("de76").alias("mean_delta_e"),
    )


def ink(prefix: str = "", tol: float = 60, bg: tuple[int, int, int] = (255, 255, 255)) -> Column:
    """Foreground by the largest channel difference to ``bg``."""
    return F.greatest(*[F.abs(c - v) for c, v in zip(rgb(prefix), bg)]) > tol


def ink_euclid(prefix: str = "", tol: float = 60.0, bg: tuple[Column, Column, Column] | None = None) -> Column:
    """Foreground by Euclidean distance to a background colour (columns bgr, bgg, bgb by default)."""
    return dist(rgb(prefix), bg or rgb("bg")) > tol


def seam_ratio(pair: DataFrame) -> DataFrame:
    """White leaks in inked pixels, plain and inside eroded ink (with tolerance 40)."""
    src = F.greatest(*[F.abs(c - 255) for c in rgb()]) > 12
    white = F.least(*rgb("r")) > 244
    df = st.banded(pair.withColumn("_m", ink("", 40).cast("int")), 1)
    df = st.core(st.erode(df, ["_m"], 1))
    leak = F.greatest(*[F.abs(c - 255) for c in rgb("r")]) <= 12
    inner = F.col("_m_ero") == 1
    ratio = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b)).otherwise(0.0)
    return df.groupBy(IMG).agg(ratio(white, src).alias("seam_ratio"), ratio(leak, inner).alias("eroded_seam_ratio"))


def ink_metrics(pair: DataFrame, tol: float = 60, minimum: int = 30) -> DataFrame:
    """Ink recall and precision with one pixel of tolerance (null below ``minimum`` ink pixels)."""
    df = pair.withColumn("_o", ink("", tol).cast("int")).withColumn("_r", ink("r", tol).cast("int"))
    df = st.core(st.dilate(st.banded(df, 1), ["_o", "_r"], 1))
    no, nr = F.sum("_o"), F.sum("_r")
    return df.groupBy(IMG).agg(
        no.alias("ink_pixels"),
        F.when(no >= minimum, F.bround(F.sum(F.col("_o") * F.col("_r_dil")) / no, 4)).alias("ink_recall"),
        F.when(no >= minimum, F.bround(F.sum(F.col("_r") * F.col("_o_dil")) / F.greatest(F.lit(1), nr), 4)).alias("ink_precision"),
    )


def halo_ratio(px: DataFrame, centers: DataFrame, edges: DataFrame, tol: float = 40.0) -> DataFrame:
    """Share of off-palette pixels away from edges (edges dilated by 2).

    ``edges(image_id, x, y)`` lists the edge pixels.
    """
    df = nearest_center(px, centers).join(edges.select(IMG, "x", "y", F.lit(1).alias("_e")), [IMG, "x", "y"], "left")
    df = st.core(st.dilate(st.banded(df.withColumn("_e", F.coalesce("_e", F.lit(0))), 2), ["_e"], 2))
    off = (F.sqrt("center_d2") > tol) & (F.col("_e_dil") == 0)
    return df.groupBy(IMG).agg(F.bround(F.count_if(off) / F.count(F.lit(1)), 5).alias("halo_ratio"))


def palette_agreement(pair: DataFrame, centers: DataFrame, min_union: int = 20) -> DataFrame:
    """Agreement of nearest classes and per-class IoU (classes with a union of at least ``min_union``)."""
    df = nearest_center(pair, centers, out="cs").drop("cs_d2")
    df = nearest_center(df, centers, "named_struct('r', rr, 'g', rg, 'b', rb)", "ct").groupBy(IMG, "cs", "ct").agg(F.count(F.lit(1)).alias("n"))
    side = df.select(IMG, F.explode(F.array_distinct(F.array("cs", "ct"))).alias("c"), "cs", "ct", "n")
    per = side.groupBy(IMG, "c").agg(F.sum("n").alias("u"), F.sum(F.when(F.col("cs") == F.col("ct"), F.col("n")).otherwise(0)).alias("i"))
    iou = F.when(F.col("u") >= min_union, F.col("i") / F.col("u"))
    classes = per.groupBy(IMG).agg(F.min(iou).alias("min_component_iou"), F.avg(iou).alias("mean_component_iou"))
    agree = df.groupBy(IMG).agg((F.sum(F.when(F.col("cs") == F.col("ct"), F.col("n")).otherwise(0)) / F.sum("n")).alias("palette_agree"))
    return agree.join(classes, IMG)


def posterize_thresholds(px: DataFrame, n: int) -> DataFrame:
    """Distinct luminance quantiles k/(n+1) per image (256 grey levels bound the buffer)."""
    qs = F.array(*[F.expr(f"percentile_disc({k / (n + 1)}d) WITHIN GROUP (ORDER BY v)") for k in range(1, n + 1)])
    g = px.select(IMG, cl.gray().alias("v")).groupBy(IMG).agg(F.array_sort(F.array_distinct(qs)).alias("thresholds"))
    return g.select(IMG, F.transform("thresholds", lambda t: t.cast("int")).alias("thresholds"))


def band_colors(px: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Mean colour per luminance band (t[k-1], t[k]]; the last band is the background."""
    j = st.with_known(px, thresholds, [IMG]).withColumn("_l", cl.luma709())
    band = F.size(F.filter("thresholds", lambda t: t < F.col("_l")))
    return j.groupBy(IMG, band.alias("band")).agg(
        *[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"),
        (F.first(F.size("thresholds")) == band).alias("is_background"),
    )


# -- recolouring and gradients --------------------------------------------------------

def recolor_by_path(px: DataFrame, ids: str, fills: DataFrame, min_px: int = 1) -> DataFrame:
    """Interior mean colour per path; adopted where .5 <= distance to the old fill <= 30.

    ``fills(image_id, path, fr, fg, fb)``.
    """
    inner = st.interior(px, ids).where("interior")
    means = inner.groupBy(IMG, F.col(ids).alias("path")).agg(F.count(F.lit(1)).alias("n"), *[F.rint(F.avg(c)).cast("int").alias(f"n{c}") for c in "rgb"])
    j = means.where(F.col("n") >= min_px).join(fills, [IMG, "path"])
    j = cl.with_lab8(cl.with_lab8(j, ("fr", "fg", "fb"), "o"), ("nr", "ng", "nb"), "w").withColumn("shift", cl.delta_e76_lab8("o", "w"))
    take = F.col("shift").between(0.5, 30.0)
    return j.select(
        IMG, "path", "n", "shift", take.alias("applied"),
        *[F.when(take, F.col(f"n{c}")).otherwise(F.col(f"f{c}")).alias(c) for c in "rgb"],
    )


def recolor_by_group(px: DataFrame, ids: str, fills: DataFrame) -> DataFrame:
    """Pooled median per old fill, adopted by the same shift rule; one row per fill."""
    j = st.with_known(px.withColumn("path", F.col(ids)), fills, [IMG, "path"])
    g = j.groupBy(IMG, "fr", "fg", "fb").agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.median(c)).cast("int").alias(f"m{c}") for c in "rgb"])
    g = cl.with_lab8(cl.with_lab8(g, ("fr", "fg", "fb"), "o"), ("mr", "mg", "mb"), "w").withColumn("shift", cl.delta_e76_lab8("o", "w"))
    take = F.col("shift").between(0.5, 30.0)
    return g.select(IMG, "fr", "fg", "fb", "n", "shift", *[F.when(take, F.col(f"m{c}")).otherwise(F.col(f"f{c}")).alias(c) for c in "rgb"])


def snap_shrinking_palette(groups: DataFrame, tol: float = 1.5) -> DataFrame:
    """Snap group colours to an earlier (heavier) centre within ``tol``; the palette only shrinks.

    Groups of one document are bounded by its fill count.
    """
    g = cl.with_lab8(groups, ("r", "g", "b"), "p")
    item = "struct(-n AS k, fr, fg, fb, r, g, b, pl8, pa8, pb8)"
    lab2 = lambda a, b: f"(power({a}.pl8-{b}.pl8,2)+power({a}.pa8-{b}.pa8,2)+power({a}.pb8-{b}.pb8,2))"
    hit = f"filter(acc, it -> {lab2('it', 'x')} <= {tol * tol}d)"
    cs = g.groupBy(IMG).agg(F.array_sort(F.collect_list(F.expr(item))).alias("cs"))
    fold = f"aggregate(cs, slice(cs, 1, 0), (acc, x) -> CASE WHEN size({hit}) > 0 THEN acc ELSE concat(acc, array(x)) END)"
    cs = cs.withColumn("acc", F.expr(fold)).select(IMG, "acc", F.explode("cs").alias("x"))
    cs = cs.withColumn("c", F.coalesce(F.get(F.expr(hit), F.lit(0)), F.col("x")))
    return cs.select(IMG, "x.fr", "x.fg", "x.fb", "c.r", "c.g", "c.b")


def fit_linear_gradient(px: DataFrame, region: str, min_px: int = 900, min_gain: float = 0.0) -> DataFrame:
    """Least-squares plane c0 + gx*x + gy*y per channel and region, with gain over the mean colour.

    One pass of moment sums gives the plane, a second the colour gain and the
    p1/p99 stops along the luminance slope; regions below ``min_px`` are skipped.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    for c in "rgb":
        v = F.col(c).cast("double")
        sums |= {f"s{c}": v, f"sx{c}": x * v, f"sy{c}": y * v}
    keys = [IMG, region]
    m = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()]).where(F.col("n") >= min_px)
    f = F.col
    # centred second moments keep the 2x2 system well conditioned
    m = m.select("*", (f("sxx") - f("sx") * f("sx") / f("n")).alias("cxx"), (f("sxy") - f("sx") * f("sy") / f("n")).alias("cxy"), (f("syy") - f("sy") * f("sy") / f("n")).alias("cyy"))
    m = m.withColumn("det", f("cxx") * f("cyy") - f("cxy") * f("cxy")).where(f("det") > 1e-9)
    for c in "rgb":
        kx, ky = f(f"sx{c}") - f("sx") * f(f"s{c}") / f("n"), f(f"sy{c}") - f("sy") * f(f"s{c}") / f("n")
        m = m.withColumn(f"gx_{c}", (kx * f("cyy") - ky * f("cxy")) / f("det")).withColumn(f"gy_{c}", (ky * f("cxx") - kx * f("cxy")) / f("det"))
        m = m.withColumn(f"c0_{c}", (f(f"s{c}") - f(f"gx_{c}") * f("sx") - f(f"gy_{c}") * f("sy")) / f("n"))
        m = m.withColumn(f"base_{c}", F.floor(f(f"s{c}") / f("n") + 0.5).cast("int"))
    lum = lambda p: f(f"{p}_r") * 0.299 + f(f"{p}_g") * 0.587 + f(f"{p}_b") * 0.114
    m = m.withColumn("lx", lum("gx")).withColumn("ly", lum("gy")).withColumn("norm", F.hypot("lx", "ly"))
    m = m.select(*keys, "n", *[f"{p}_{c}" for p in ("c0", "gx", "gy", "base") for c in "rgb"], (f("lx") / f("norm")).alias("ux"), (f("ly") / f("norm")).alias("uy"), (f("sx") / f("n")).alias("cx"), (f("sy") / f("n")).alias("cy"))
    j = st.with_known(px.select(*keys, "x", "y", "r", "g", "b"), m, keys)
    clip = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e).cast("int")))
    j = j.select("*", *[clip(f(f"c0_{c}") + f(f"gx_{c}") * f("x") + f(f"gy_{c}") * f("y")).alias(f"p_{c}") for c in "rgb"], (f("x") * f("ux") + f("y") * f("uy")).alias("t"))
    lab = cl.with_lab8(cl.with_lab8(cl.with_lab8(j, ("r", "g", "b"), "t_"), ("base_r", "base_g", "base_b"), "k_"), ("p_r", "p_g", "p_b"), "p_")
    gain = lab.groupBy(*keys).agg((F.avg(cl.delta_e76_lab8("t_", "k_")) - F.avg(cl.delta_e76_lab8("t_", "p_"))).alias("gain_de"))
    stops = exact_percentiles(j.where(f("t").isNotNull()), keys, "t", {"t1": 0.01, "t2": 0.99})
    out = meet(meet(m, gain, keys), stops, keys, "left").where(f("gain_de") >= min_gain)
    for i in ("1", "2"):
        out = out.withColumn(f"_s{i}", f(f"t{i}") - (f("cx") * f("ux") + f("cy") * f("uy")))
        out = out.withColumn(f"x{i}", f("cx") + f(f"_s{i}") * f("ux")).withColumn(f"y{i}", f("cy") + f(f"_s{i}") * f("uy"))
    return out.select(*keys, "n", *[f"{p}_{c}" for p in ("c0", "gx", "gy") for c in "rgb"], "gain_de", "x1", "y1", "x2", "y2")


# -- clustering ------------------------------------------------------------------------

def lloyd(hist: DataFrame, start: DataFrame, rounds: int = 20, shift: float = 1.0) -> DataFrame:
    """Lloyd iterations for all images at once: hist(image_id, r, g, b, n) and start(image_id, centers) -> (image_id, centers).

    An image is done when no centre moves by ``shift`` or after ``rounds``; only the others go on. A centre without
    colours goes.
    """
    live, done = cut_lineage(start), []
    moves = "array_max(zip_with(_old, centers, (a, b) -> sqrt(power(a.r - b.r, 2) + power(a.g - b.g, 2) + power(a.b - b.b, 2))))"
    for _ in range(rounds):
        near = nearest_center(hist, live)
        means = near.groupBy(IMG, "center").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"])
        new = palette_array(means, "center").join(live.withColumnRenamed("centers", "_old"), IMG)
        moved = F.when(F.size("_old") == F.size("centers"), F.expr(moves)).otherwise(F.lit(float("inf")))
        new = cut_lineage(new.select(IMG, "centers", (moved >= shift).alias("_live")))
        done.append(new.where("not _live").select(IMG, "centers"))
        live = new.where("_live").select(IMG, "centers")
        if not live.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done, live)


def kmeans_palette(px: DataFrame, k: int, rounds: int = 20, shift: float = 1.0) -> DataFrame:
    """K-means centres per image, started from the k most common colour buckets.

    Works on distinct colours with counts, so repeated colours cost one row.
    """
    hist = cut_lineage(px.groupBy(IMG, "r", "g", "b").agg(F.count(F.lit(1)).alias("n")))
    seeds = dominant_colors(px, 0.0)
    start = seeds.groupBy(IMG).agg(F.expr(
        f"transform(slice(array_sort(collect_list(struct(-n AS k, r, g, b))), 1, {k}), s -> struct(double(s.r) AS r, double(s.g) AS g, double(s.b) AS b))"
    ).alias("centers"))
    return lloyd(hist, start, rounds, shift)


def spread_seeds(hist: DataFrame, wanted: DataFrame, most: int, seed: str) -> DataFrame:
    """Starting centres by seeded squared-distance sampling: (image_id, centers), up to ``k`` of wanted(image_id, k).

    The first colour is drawn by its count, each further one by its count times the squared distance to the
    nearest one drawn. A draw takes the smallest exponential waiting time, -ln(u) / weight, with u fixed by seed, draw, image and
    colour: one aggregate for all images, no colours in an array, the same in every run.
    """
    chosen = wanted.select(IMG, "k", F.expr("array()").cast("array<struct<r:double,g:double,b:double>>").alias("centers"))
    color = F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"])
    for draw in range(most):
        d2 = F.coalesce(F.array_min(F.transform("centers", lambda c: F.pow(c["r"] - F.col("r"), 2) + F.pow(c["g"] - F.col("g"), 2) + F.pow(c["b"] - F.col("b"), 2))), F.lit(1.0))
        text = F.concat_ws(":", F.lit(seed), F.lit(str(draw)), F.col(IMG).cast("string"), *[F.col(c).cast("int").cast("string") for c in "rgb"])
        u = (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        asked = st.with_known(hist, chosen.where(F.size("centers") < F.col("k")), [IMG]).withColumn("_w", F.col("n") * d2).where("_w > 0")
        drawn = asked.groupBy(IMG).agg(F.min_by(color, F.struct(-F.log(u) / F.col("_w"), "r", "g", "b")).alias("_new"))
        both = chosen.join(drawn, IMG, "left")
        chosen = cut_lineage(both.select(IMG, "k", F.when(F.col("_new").isNull(), F.col("centers")).otherwise(F.concat("centers", F.array("_new"))).alias("centers")))
    return chosen.where(F.size("centers") > 0).select(IMG, "centers")


def recenter_by_median(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(IMG, label).agg(*[F.median(c).alias(f"m{c}") for c in "rgb"], F.count(F.lit(1)).alias("n"))


def reduce_to_dominant(px: DataFrame, k: int, min_ratio: float = 0.0004, min_count: int = 60, max_protected: int = 3) -> DataFrame:
    """Palette of the k commonest colours plus up to ``max_protected`` vivid ones, in count order.

    Both limits are parameters of the palette size, not of the input.
    """
    counts = px.groupBy(IMG, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(IMG).agg(F.sum("n").alias("_t"))
    key = "struct(-n AS k, r, g, b)"
    top = _smallest(counts, key, k)
    rest = counts.join(total, IMG).join(top, IMG).where(~F.expr(f"array_contains(cs, {key})"))
    rest = rest.where((F.col("n") >= min_count) & (F.col("n") / F.col("_t") >= min_ratio) & (cl.saturation() >= 60))
    extra = _smallest(rest.select(IMG, "r", "g", "b", "n"), key, max_protected).withColumnRenamed("cs", "xs")
    both = top.join(extra, IMG, "left").select(IMG, F.concat("cs", F.coalesce("xs", F.expr("slice(cs, 1, 0)"))).alias("cs"))
    return both.select(IMG, F.expr("transform(cs, s -> struct(double(s.r) AS r, double(s.g) AS g, double(s.b) AS b))").alias("centers"))


def _smallest(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k smallest keys per image as a sorted array (top-k is limited before the shuffle)."""
    w = Window.partitionBy(IMG).orderBy("_key")
    top = df.select(IMG, F.expr(key).alias("_key")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(IMG).agg(F.array_sort(F.collect_list("_key")).alias("cs"))


def auto_color_count(df: DataFrame) -> DataFrame:
    """Colour budget 16..96 from the estimated colour count."""
    est = F.col("estimated_color_count")
    k = est + 10 + F.when(est >= 18, 32).otherwise(0) + F.when(est >= 22, 16).otherwise(0)
    cap = F.when(est >= 18, 96).otherwise(64)
    return df.withColumn("color_budget", F.greatest(F.lit(16), F.least(cap, k)))


def stride_sample(px: DataFrame, n: int) -> DataFrame:
    """Every k-th pixel in scan order so that at most about ``n`` remain per image."""
    j = st.sized(px)
    step = F.greatest(F.lit(1), F.floor(F.col("_w") * F.col("_h") / n))
    return j.where((F.col("y") * F.col("_w") + F.col("x")) % step == 0).drop("_w", "_h")


def mirror_score(px: DataFrame, axis: str = "x", shifts: int = 8, min_fg: int = 200) -> DataFrame:
    """Best mirror alignment per image: shift, mean difference and share above 30.

    Only foreground pixels (of either side) count; images with little foreground are skipped.
    """
    other = "y" if axis == "x" else "x"
    size = F.col("_w" if axis == "x" else "_h")
    px = px.select(IMG, "x", "y", "r", "g", "b", *[c for c in ("width", "height") if c in px.columns])
    lines, bands = st.by_lines(px, other)
    facts = st.size_of(px, bands)
    corners = st.with_facts(lines, bands, facts).where(_in_corner())
    facts = meet(facts, corners.groupBy(IMG).agg(*[F.median(c).alias(f"bg{c}") for c in "rgb"]), [IMG])
    fg = ink_euclid("", 40.0)
    enough = st.with_facts(lines, bands, facts).groupBy(IMG).agg(F.count_if(fg).alias("_n")).where(F.col("_n") >= min_fg).select(IMG)
    df = st.with_facts(lines, bands, meet(facts, enough, [IMG])).withColumn("fg", fg)
    df = df.select(IMG, "_band", "x", "y", "r", "g", "b", "fg", size.alias("size"))
    df = st.mirrored_lines(df, other, axis, F.col("size") - 1 - F.col(axis), ["r", "g", "b", "fg"], shifts)
    j = df.select(IMG, "r", "g", "b", "fg", "size", F.col(axis).alias("_p"), F.explode("_mates").alias("q"))
    j = j.withColumn("shift", (F.col("_p") - F.col("q._at")).cast("int")).where(F.col("fg") | F.col("q.fg")).where(
        F.col("size") - F.abs("shift") >= F.floor(F.col("size") / 2)
    )
    d = F.greatest(*[F.abs(F.col(c) - F.col(f"q.{c}")) for c in "rgb"])
    g = j.groupBy(IMG, "shift").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("score"), (F.count_if(d > 30) / F.count(F.lit(1))).alias("hi"))
    best = F.min(F.struct("score", "shift", "hi"))
    return g.where(F.col("n") >= min_fg).groupBy(IMG).agg(best.alias("m")).select(
        IMG, F.col("m.shift").alias("shift"), F.col("m.score").alias("mean_diff"), F.col("m.hi").alias("high_ratio")
    )


def symmetrize(px: DataFrame, scores: DataFrame, axis: str = "x", mean_tol: float = 5.0, hi_tol: float = 0.004) -> DataFrame:
    """Average mirrored pixels (floor of half the sum) of images whose mirror score is tight."""
    other = "y" if axis == "x" else "x"
    size = F.col("_w" if axis == "x" else "_h")
    ok = scores.where((F.col("mean_diff") <= mean_tol) & (F.col("high_ratio") <= hi_tol)).select(IMG, "shift")
    ok = ok.withColumn("_which", F.row_number().over(Window.partitionBy(IMG).orderBy("shift")))
    px = px.select(IMG, "x", "y", "r", "g", "b", *[c for c in ("width", "height") if c in px.columns])
    lines, bands = st.by_lines(px, other)
    facts = meet(st.size_of(px, bands), ok, [IMG], "left")
    df = st.with_facts(lines, bands, facts, "left" if {"width", "height"} <= set(px.columns) else "inner")
    df = st.mirrored_lines(df, other, axis, size - 1 - F.col(axis) + F.col("shift"), ["r", "g", "b"], 0, ("_which",))
    j = df.select(IMG, "x", "y", "r", "g", "b", F.explode_outer("_mates").alias("q"))
    mean = lambda c: F.floor((F.col(c) + F.col(f"q.{c}")) / 2).cast("int")
    return j.select(IMG, "x", "y", *[F.when(F.col(f"q.{c}").isNotNull(), mean(c)).otherwise(F.col(c)).alias(c) for c in "rgb"])


def fidelity_score(ssim: DataFrame, pixel: DataFrame, edges: DataFrame) -> DataFrame:
    """.40 similarity + .35 colour + .25 edges on 0..100 scales.

    Inputs: (image_id, ms_ssim), (image_id, mean_delta_e), (image_id, edge_f1).
    """
    j = ssim.join(pixel, IMG).join(edges, IMG)
    s = F.bround(F.col("ms_ssim") * 100.0, 2)
    c = F.bround(F.greatest(F.lit(0.0), 100.0 - F.col("mean_delta_e") * 5.0), 2)
    e = F.bround(F.col("edge_f1") * 100.0, 2)
    return j.select(IMG, s.alias("ssim_score"), c.alias("color_score"), e.alias("edge_score"), (s * 0.40 + c * 0.35 + e * 0.25).alias("fidelity_score"))


def worst_region_de(pair: DataFrame, region: str, min_area: int = 1) -> DataFrame:
    """Largest mean CIEDE2000 over the regions of an image with at least ``min_area`` pixels."""
    g = with_delta_e(pair).groupBy(IMG, region).agg(F.avg("de00").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.groupBy(IMG).agg(F.coalesce(F.max(F.when(F.col("n") >= min_area, F.col("m"))), F.lit(0.0)).alias("worst_face_de00"))
