"""Neighbourhood operators on dense rasters (image_id, x, y, values).

``banded`` copies each row band together with a halo and hash-partitions once
by (image, band).  Row and column windows inside a band then need no further
shuffle, and one large image is processed by as many tasks as it has bands.
Halo rows give wrong values at their outer edge and are dropped by ``core``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaiq.session import meet, spread

BAND = 64
IMG = "image_id"


def row_window():
    return Window.partitionBy(IMG, "_band", "y").orderBy("x")


def col_window():
    return Window.partitionBy(IMG, "_band", "x").orderBy("y")


def banded(df: DataFrame, halo: int, band: int = BAND, times: int = 1) -> DataFrame:
    """Rows dealt by image and band, with ``halo`` rows of the bands around, into the session's number of shuffle partitions.

    The number is given, so that Spark does not merge partitions: pixels shrink some fifty times on their way, and what
    looks like a small partition to it is gigabytes in the sorts of the windows.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("y") - halo) / band))
    last = F.floor((F.col("y") + halo) / band)
    return spread(df.withColumn("_band", F.explode(F.sequence(first, last))), IMG, "_band", times=times)


def core(df: DataFrame, band: int = BAND) -> DataFrame:
    return df.where(F.floor(F.col("y") / band) == F.col("_band")).drop("_band")


def at(c: str, w, k: int) -> Column:
    """Value k steps ahead (negative: behind) along a row or column window."""
    return F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w) if k < 0 else F.col(c)


def mirrored(c: str, w, k: int) -> Column:
    """Neighbour at +-1, mirrored at the border without repeating the edge pixel."""
    return F.coalesce(at(c, w, k), at(c, w, -k), F.col(c))


def _square(df: DataFrame, masks: list[str], r: int, fn, suffix: str) -> DataFrame:
    rows, cols = row_window().rangeBetween(-r, r), col_window().rangeBetween(-r, r)
    df = df.select("*", *[fn(m).over(rows).alias(f"_h_{m}") for m in masks])
    df = df.select("*", *[fn(f"_h_{m}").over(cols).alias(f"{m}{suffix}") for m in masks])
    return df.drop(*[f"_h_{m}" for m in masks])


def dilate(df: DataFrame, masks: list[str], r: int = 1, suffix: str = "_dil") -> DataFrame:
    """Square dilation of 0/1 columns (inside a banded frame with halo >= r)."""
    return _square(df, masks, r, F.max, suffix)


def erode(df: DataFrame, masks: list[str], r: int = 1, suffix: str = "_ero") -> DataFrame:
    """Square erosion; pixels outside the raster do not erode."""
    return _square(df, masks, r, F.min, suffix)


def dilate_erode(px: DataFrame, masks: list[str], r: int = 1) -> DataFrame:
    return core(erode(dilate(banded(px, r), masks, r), masks, r))


def interior(px: DataFrame, ids: str = "label") -> DataFrame:
    """Adds ``interior``: the existing 4-neighbours all carry the same id."""
    df = banded(px, 1)
    same = F.lit(True)
    for w in (row_window(), col_window()):
        for k in (-1, 1):
            same = same & F.coalesce(at(ids, w, k) == F.col(ids), F.lit(True))
    return core(df.withColumn("interior", same))


def sobel(df: DataFrame, v: str, gx: str = "gx", gy: str = "gy") -> DataFrame:
    """3x3 Sobel on a banded frame (halo >= 1), mirrored border."""
    df = df.select(
        "*", (mirrored(v, row_window(), -1) + F.col(v) * 2 + mirrored(v, row_window(), 1)).alias("_s"), (mirrored(v, row_window(), 1) - mirrored(v, row_window(), -1)).alias("_d")
    )
    return df.select(
        "*", (mirrored("_d", col_window(), -1) + F.col("_d") * 2 + mirrored("_d", col_window(), 1)).alias(gx), (mirrored("_s", col_window(), 1) - mirrored("_s", col_window(), -1)).alias(gy)
    ).drop("_s", "_d")


def gradient(px: DataFrame, v: str) -> DataFrame:
    """Adds gx, gy and their magnitude ``grad``."""
    return core(sobel(banded(px, 1), v)).withColumn("grad", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def blur_score(px: DataFrame, v: str) -> DataFrame:
    """Variance of the 4-neighbour Laplacian per image."""
    df = banded(px, 1)
    total = sum((mirrored(v, w, k) for w in (row_window(), col_window()) for k in (-1, 1)), F.lit(0))
    lap = core(df.withColumn("_lap", total - F.col(v) * 4))
    return lap.groupBy(IMG).agg(F.bround(F.var_pop("_lap"), 2).alias("blur_score"))


def edge_candidates(px: DataFrame, sources: dict[str, str], lo: float, hi: float) -> DataFrame:
    """Thin edge candidates of grey columns: ``{name}`` = 0 none, 1 weak, 2 strong.

    Sobel with repeated border, |gx|+|gy| magnitude, non-maximum suppression
    along the quantised gradient direction, double threshold.  All window passes
    share the banded partitioning.
    """
    row, col = row_window(), col_window()
    df = banded(px, 2)
    near = lambda c, w, k: F.coalesce(at(c, w, k), F.col(c))  # noqa: E731 - edge pixel repeated
    zero = lambda c, w, k: F.coalesce(at(c, w, k), F.lit(0))  # noqa: E731 - no gradient outside
    df = df.select("*", *[e for n, v in sources.items() for e in (
        (near(v, row, -1) + F.col(v) * 2 + near(v, row, 1)).alias(f"_{n}s"), (near(v, row, 1) - near(v, row, -1)).alias(f"_{n}d"))])
    df = df.select("*", *[e for n in sources for e in (
        (near(f"_{n}d", col, -1) + F.col(f"_{n}d") * 2 + near(f"_{n}d", col, 1)).alias(f"_{n}gx"),
        (near(f"_{n}s", col, 1) - near(f"_{n}s", col, -1)).alias(f"_{n}gy"))])
    df = df.select("*", *[(F.abs(f"_{n}gx") + F.abs(f"_{n}gy")).alias(f"_{n}m") for n in sources])
    df = df.select("*", *[zero(f"_{n}m", row, k).alias(f"_{n}{t}") for n in sources for t, k in (("l", -1), ("r", 1))])
    df = df.select("*", *[zero(f"_{n}{t}", col, k).alias(f"_{n}{t}{u}") for n in sources for t in "lmr" for u, k in (("u", -1), ("d", 1))])
    out = []
    for n in sources:
        c = lambda t: F.col(f"_{n}{t}")  # noqa: B023, E731
        tg, ys, mid = F.abs(c("gx")) * 13573, F.abs(c("gy")) * 32768, c("m")
        first = F.when(ys < tg, c("l")).when(ys > tg + F.abs(c("gx")) * 65536, c("mu")).when((c("gx") < 0) != (c("gy") < 0), c("ru")).otherwise(c("lu"))
        second = F.when(ys < tg, c("r")).when(ys > tg + F.abs(c("gx")) * 65536, c("md")).when((c("gx") < 0) != (c("gy") < 0), c("ld")).otherwise(c("rd"))
        straight = (ys < tg) | (ys > tg + F.abs(c("gx")) * 65536)
        out += [first.alias(f"_{n}a"), second.alias(f"_{n}b"), straight.alias(f"_{n}t")]
    df = df.select("*", *out)
    peak = lambda n: (F.col(f"_{n}m") > F.col(f"_{n}a")) & ((F.col(f"_{n}m") > F.col(f"_{n}b")) | (F.col(f"_{n}t") & (F.col(f"_{n}m") == F.col(f"_{n}b"))))
    state = [F.when(peak(n) & (F.col(f"_{n}m") > hi), 2).when(peak(n) & (F.col(f"_{n}m") > lo), 1).otherwise(0).alias(n) for n in sources]
    return core(df.select(*px.columns, "_band", *state))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [x / total for x in w]


def image_size(px: DataFrame) -> DataFrame:
    return px.groupBy(IMG).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))


SHARES = 64
"""Parts that the pixels of one image (or region) are dealt into where they meet what is known of it."""


def with_known(px: DataFrame, known: DataFrame, keys: list[str], how: str = "inner", shares: int = SHARES) -> DataFrame:
    """Joins ``known``, one small row for each of ``keys``, to pixels.

    The row is sent to every share of its image's pixels, so an image with most of the pixels meets it in many tasks.
    The shares are shuffled: to Spark ``known`` looks as small as it is before it is sent to them, and would be broadcast.
    """
    apart = ["x", "y"] if {"x", "y"} <= set(px.columns) else [c for c in px.columns if c not in keys]
    dealt = px.withColumn("_share", F.pmod(F.xxhash64(*apart), F.lit(shares)).cast("int"))
    sent = known.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(sent.hint("shuffle_hash"), [*keys, "_share"], how).drop("_share")


def sized(px: DataFrame) -> DataFrame:
    """Adds _w and _h: the columns ``width`` and ``height`` where the pixels carry them, else measured."""
    if {"width", "height"} <= set(px.columns):
        return px.withColumn("_w", F.col("width")).withColumn("_h", F.col("height"))
    return with_known(px, image_size(px), [IMG])


def by_lines(px: DataFrame, across: str) -> tuple[DataFrame, DataFrame]:
    """Pixels shuffled once, so that a line of an image (one value of ``across``) is in one task, and the sizes of the bands they came as.

    Add what is known of an image with ``with_facts``, which leaves the pixels where they are.
    """
    dealt = px.withColumn("_band", F.coalesce(F.floor(F.col(across) / BAND), F.lit(0)))
    bands = dealt.groupBy(IMG, "_band").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    return spread(dealt, IMG, "_band"), bands


def size_of(px: DataFrame, bands: DataFrame) -> DataFrame:
    """Images with _w and _h, unless the pixels carry their size (``with_size``)."""
    size = [] if {"width", "height"} <= set(px.columns) else [F.max(c).alias(c) for c in ("_w", "_h")]
    return bands.groupBy(IMG).agg(*size) if size else bands.select(IMG).distinct()


def with_facts(df: DataFrame, bands: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Joins ``facts``, small rows for an image, to the pixels of ``by_lines``: only the facts move, once for a band."""
    sent = spread(meet(bands.select(IMG, "_band"), facts, [IMG]), IMG, "_band")
    df = df.join(sent.hint("shuffle_hash"), [IMG, "_band"], how)
    return sized(df) if {"width", "height"} <= set(df.columns) else df


def mirrored_lines(df: DataFrame, across: str, axis: str, place: Column, values: list[str], reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of ``by_lines`` with ``_mates``: what lies within ``reach`` of them once every pixel of their line is put to ``place``.

    A mate has its place as ``_at`` and its values; with ``reach`` 0 it has the pixel's own place. Pixels of other ``keys`` don't meet.
    """
    both = F.explode(F.array(F.struct(F.col(axis).alias("_at"), F.lit(False).alias("_put")), F.struct(place.cast(df.schema[axis].dataType).alias("_at"), F.lit(True).alias("_put"))))
    df = df.withColumn("_two", both).select("*", "_two._at", "_two._put").drop("_two")
    line = Window.partitionBy(IMG, "_band", across, *keys, *([] if reach else ["_at"]))
    near = line.orderBy("_at").rangeBetween(-reach, reach) if reach else line
    mate = F.when(F.col("_put") & F.col("_at").isNotNull() & F.col(across).isNotNull(), F.struct("_at", *values))
    return df.withColumn("_mates", F.collect_list(mate).over(near)).where(~F.col("_put")).drop("_at", "_put")


def padded(px: DataFrame, r: int) -> DataFrame:
    """Adds ``r`` border pixels on every side, mirrored with the edge pixel repeated.

    Needs ``_w`` and ``_h``; the border must not exceed the raster.
    """
    def places(c: str, n: str) -> Column:
        v = F.col(c)
        return F.array_compact(F.array(v, F.when(v < r, -v - 1), F.when(v >= F.col(n) - r, F.col(n) * 2 - 1 - v)))

    return px.withColumn("x", F.explode(places("x", "_w"))).withColumn("y", F.explode(places("y", "_h")))


def gaussian(df: DataFrame, values: list[str], sigma: float) -> DataFrame:
    """Separable Gaussian of ``values`` on a banded, padded frame; adds ``{v}_blur``."""
    w = gaussian_weights(sigma)
    r = len(w) // 2

    def tap(c: str, win) -> Column:
        return sum((at(c, win, k - r) * w[k] for k in range(2 * r + 1)), F.lit(0.0))

    df = df.select("*", *[tap(v, row_window()).alias(f"_h_{v}") for v in values])
    df = df.select("*", *[tap(f"_h_{v}", col_window()).alias(f"{v}_blur") for v in values])
    return df.drop(*[f"_h_{v}" for v in values])


def _with_bands(df: DataFrame, known: DataFrame, band: int = BAND, times: int = 1) -> DataFrame:
    """Joins what is known of an image, its ``_h`` included, to its bands; only ``known`` moves."""
    bands = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_h") - 1) / band))
    return df.join(spread(known.withColumn("_band", F.explode(bands)), IMG, "_band", times=times).hint("shuffle_hash"), [IMG, "_band"])


def gaussian_blur(px: DataFrame, values: list[str], sigma: float, derived: dict[str, Column] | None = None) -> DataFrame:
    """Blurred raster, border mirrored; ``derived`` values are computed from the columns after these are shuffled.

    Pixels are shuffled once, as bands; sizes are sent to the bands, and borders are added to them.
    """
    r = len(gaussian_weights(sigma)) // 2
    df = banded(px, r)
    if {"width", "height"} <= set(px.columns):
        df = sized(df)
    else:
        df = _with_bands(df, image_size(px))
    return _blurred(df, values, sigma, derived or {}, BAND)


def _blurred(df: DataFrame, values: list[str], sigma: float, derived: dict[str, Column], band: int) -> DataFrame:
    """``gaussian_blur`` of a frame already dealt by bands, with _w and _h."""
    df = padded(df, len(gaussian_weights(sigma)) // 2)
    df = gaussian(df.select("*", *[e.alias(n) for n, e in derived.items()]), values, sigma)
    inside = F.col("x").between(0, F.col("_w") - 1) & F.col("y").between(0, F.col("_h") - 1)
    return core(df.where(inside), band).drop("_w", "_h")


SSIM_SIGMA = 1.5


def _products() -> dict[str, Column]:
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    return {"a": p, "b": q, "aa": p * p, "bb": q * q, "ab": p * q}


def _similarity(df: DataFrame) -> DataFrame:
    """Mean similarity of each image from its blurred products."""
    ma, mb = F.col("a_blur"), F.col("b_blur")
    c1, c2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2
    va, vb, cov = F.col("aa_blur") - ma * ma, F.col("bb_blur") - mb * mb, F.col("ab_blur") - ma * mb
    value = ((ma * mb * 2 + c1) * (cov * 2 + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return df.select(IMG, value.alias("v")).groupBy(IMG).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("v"))).alias("ssim"))


def _grey_pair(pair: DataFrame, a: str, b: str) -> DataFrame:
    size = [c for c in ("width", "height") if c in pair.columns]
    return pair.select(IMG, "x", "y", *size, F.col(a).alias("_p"), F.col(b).alias("_q"))


def ssim(pair: DataFrame, a: str, b: str, sigma: float = SSIM_SIGMA) -> DataFrame:
    """Mean Gaussian-window similarity of two grey columns per image, clipped to 0..1."""
    return _similarity(gaussian_blur(_grey_pair(pair, a, b), list(_products()), sigma, _products()))


def area_downsample(px: DataFrame, factor: int, values: list[str], rounded: bool = False) -> DataFrame:
    """Box mean over factor x factor cells; ``rounded`` gives 8-bit values."""
    fx, fy = F.floor(F.col("x") / factor).cast("int"), F.floor(F.col("y") / factor).cast("int")
    mean = lambda v: F.floor(F.avg(v) + 0.5) if rounded else F.avg(v)
    return px.groupBy(IMG, fx.alias("x"), fy.alias("y")).agg(*[mean(v).alias(v) for v in values])


def ms_ssim(pair: DataFrame, a: str, b: str) -> DataFrame:
    """.6 full + .4 half-scale similarity where the shorter side is at least 64, else full."""
    names, r, band = list(_products()), len(gaussian_weights(SSIM_SIGMA)) // 2, 2 * BAND
    # a band is as high as two of the half scale, with the halo of one: both scales are made of the same shuffled pixels
    df, known = banded(_grey_pair(pair, a, b), 2 * r, band, times=2), image_size(pair)
    sizes = sized(df) if {"width", "height"} <= set(df.columns) else _with_bands(df, known, band, times=2)
    full = _similarity(_blurred(sizes, names, SSIM_SIGMA, _products(), band))
    large = _with_bands(df.select(IMG, "_band", "x", "y", "_p", "_q"), known.where(F.least("_w", "_h") >= 64), band, times=2)
    cell = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("x", "y")]
    small = [(F.floor((F.col(c) - 1) / 2) + 1).cast("int").alias(c) for c in ("_w", "_h")]
    cells = large.groupBy(IMG, "_band", *cell, *small).agg(*[F.floor(F.avg(v) + 0.5).alias(v) for v in ("_p", "_q")])
    half = _similarity(_blurred(cells, names, SSIM_SIGMA, _products(), BAND)).withColumnRenamed("ssim", "_half")
    return full.join(half, IMG, "left").select(
        IMG, F.coalesce(F.col("ssim") * 0.6 + F.col("_half") * 0.4, F.col("ssim")).alias("ms_ssim")
    )


def thin_ink_ratio(px: DataFrame, ink: str, minimum: int = 30) -> DataFrame:
    """Share of ink pixels whose 3x3 neighbourhood touches background (0 below ``minimum`` ink)."""
    df = core(erode(banded(px.withColumn("_ink", F.col(ink).cast("int")), 1), ["_ink"], 1))
    n = F.sum("_ink")
    return df.groupBy(IMG).agg(F.when(n < minimum, 0.0).otherwise((n - F.sum("_ink_ero")) / n).alias("thin_ink_ratio"))


def smooth_flat_zone(px: DataFrame, light: str, chroma: str, values: list[str], reach: int = 6) -> DataFrame:
    """Blur ``values`` only inside flat neutral zones (chroma <= 12, local energy <= 1).

    Energy is the 15x15 mean of gradient/8; zones are eroded by ``reach``.
    A zone must cover more than 3 % of the image to be used.
    """
    sigma = 0.3 * ((15 - 1) * 0.5 - 1) + 0.8
    halo = 1 + 7 + reach
    df = sobel(banded(px, halo), light)
    df = df.withColumn("_e", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) / 8.0)
    df = df.withColumn("_eh", F.avg("_e").over(row_window().rangeBetween(-7, 7))).withColumn("_energy", F.avg("_eh").over(col_window().rangeBetween(-7, 7)))
    df = df.withColumn("_flat", ((F.col(chroma) <= 12.0) & (F.col("_energy") <= 1.0)).cast("int"))
    zones = core(erode(df, ["_flat"], reach)).select(*px.columns, F.col("_flat_ero").alias("_safe"))
    share = zones.groupBy(IMG).agg((F.avg("_safe") > 0.03).alias("_use"))
    soft = gaussian_blur(px.select(IMG, "x", "y", *values), values, sigma).select(IMG, "x", "y", *[f"{v}_blur" for v in values])
    out = with_known(zones, share, [IMG]).join(soft, [IMG, "x", "y"])
    use = F.col("_use") & (F.col("_safe") == 1)
    keep = [F.col(c) for c in px.columns if c not in values]
    return out.select(*keep, *[F.when(use, F.col(f"{v}_blur")).otherwise(F.col(v)).alias(v) for v in values], use.alias("smoothed"))
