"""Colour, alpha and luminance column functions (no UDFs).

Multi-step colour spaces are staged as named columns: the optimiser keeps a
projection that is referenced several times, so each step is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Named fills, sRGB and D65 constants.
NAMED_COLORS = {"black": "#000000", "white": "#ffffff", "red": "#ff0000"}
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def gray(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """8-bit grey as used by all edge and similarity measures."""
    return half_up(luma601(r, g, b)).cast("int")


def luma601(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114


def luma709(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.col(r) * 0.2126 + F.col(g) * 0.7152 + F.col(b) * 0.0722


def to_byte(c: Column) -> Column:
    """Round half-even and clip to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(c).cast("int")))


def alpha_over(c: str, a: str, background: Column) -> Column:
    w = F.col(a) / 255.0
    return to_byte(F.col(c) * w + background * (1.0 - w))


def checker(x: str = "x", y: str = "y", cell: Column | int = 4, dark: int = 96, light: int = 238) -> Column:
    cell = F.lit(cell) if isinstance(cell, int) else cell
    odd = (F.floor(F.col(x) / cell) + F.floor(F.col(y) / cell)) % 2 == 1
    return F.when(odd, F.lit(dark)).otherwise(F.lit(light))


def premultiply(c: str, a: str = "a") -> Column:
    return to_byte(F.col(c) * F.col(a) / 255.0)


def unpremultiply(c: Column, a: str = "a") -> Column:
    return F.when(F.col(a) > 0, to_byte(c * 255.0 / F.col(a))).otherwise(F.lit(0))


def recover_straight(c: str, a: str = "a") -> Column:
    """Straight colour behind a white composite; 0 where alpha is 0."""
    w = F.col(a) / 255.0
    return F.when(F.col(a) > 0, to_byte((F.col(c) - 255.0 * (1.0 - w)) / w)).otherwise(F.lit(0))


def srgb_to_linear(c: str | Column) -> Column:
    v = (F.col(c) if isinstance(c, str) else c) / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def saturation(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def is_vivid(r: str = "r", g: str = "g", b: str = "b", minimum: int = 55) -> Column:
    return (saturation(r, g, b) >= minimum) & (F.greatest(r, g, b) >= minimum)


def hue(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """HSV hue in degrees, 0 for greys."""
    mx, d = F.greatest(r, g, b), saturation(r, g, b)
    rr, gg, bb = F.col(r), F.col(g), F.col(b)
    h = F.when(d == 0, 0.0).when(mx == rr, ((gg - bb) / d) % 6.0).when(mx == gg, (bb - rr) / d + 2.0).otherwise((rr - gg) / d + 4.0)
    return F.pmod(h * 60.0, F.lit(360.0))


def hue_bucket30(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.floor(F.floor(hue(r, g, b)) / 30).cast("int")


def parse_fill(c: str) -> Column:
    """Fill text -> struct(r,g,b); null for none, url() and unknown text, black for a missing fill."""
    t = F.lower(F.trim(c))
    for name, value in NAMED_COLORS.items():
        t = F.when(t == name, F.lit(value)).otherwise(t)
    pair = lambda i: F.conv(F.substring(t, 2 + 2 * i, 2), 16, 10).cast("int")
    single = lambda i: F.conv(F.repeat(F.substring(t, 2 + i, 1), 2), 16, 10).cast("int")
    pattern = r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)"
    part = lambda i: F.least(F.lit(255), F.regexp_extract(t, pattern, i + 1).try_cast("int"))
    rgb = lambda f: F.struct(f(0).alias("r"), f(1).alias("g"), f(2).alias("b"))
    return (
        F.when(F.col(c).isNull(), F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")))
        .when(t.rlike("^#[0-9a-f]{6}$"), rgb(pair))
        .when(t.rlike("^#[0-9a-f]{3}$"), rgb(single))
        .when(t.rlike(pattern), rgb(part))
    )


def to_hex(r: str = "r", g: str = "g", b: str = "b") -> Column:
    two = lambda c: F.lower(F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def with_lab8(df: DataFrame, rgb: tuple[str, str, str], prefix: str) -> DataFrame:
    """Adds 8-bit scaled ``{prefix}l8, a8, b8`` (L*255/100, a+128, b+128, rounded)."""
    p = f"_{prefix}"
    df = df.select("*", *[srgb_to_linear(c).alias(f"{p}n{i}") for i, c in enumerate(rgb)])
    lin = [F.col(f"{p}n{i}") for i in range(3)]
    df = df.select(
        "*", *[((lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2]) / w).alias(f"{p}t{i}") for i, (m, w) in enumerate(zip(XYZ, WHITE))]
    )
    root = lambda c: F.when(c > 0.008856, F.cbrt(c)).otherwise(c * 7.787 + 16.0 / 116.0)
    df = df.select("*", *[root(F.col(f"{p}t{i}")).alias(f"{p}f{i}") for i in range(3)])
    fx, fy, fz = (F.col(f"{p}f{i}") for i in range(3))
    light = F.when(F.col(f"{p}t1") > 0.008856, fy * 116.0 - 16.0).otherwise(F.col(f"{p}t1") * 903.3)
    clip = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), half_up(c).cast("int")))
    out = df.select(
        "*", clip(light * 2.55).alias(f"{prefix}l8"),
        clip((fx - fy) * 500.0 + 128.0).alias(f"{prefix}a8"), clip((fy - fz) * 200.0 + 128.0).alias(f"{prefix}b8"),
    )
    return out.drop(*[f"{p}{k}{i}" for k in "ntf" for i in range(3)])


def with_lab(df: DataFrame, rgb: tuple[str, str, str], prefix: str) -> DataFrame:
    """Adds true ``{prefix}L, A, B`` recovered from the 8-bit scale."""
    df = with_lab8(df, rgb, prefix)
    return df.select(
        "*", (F.col(f"{prefix}l8") * (100.0 / 255.0)).alias(f"{prefix}L"),
        (F.col(f"{prefix}a8") - 128.0).alias(f"{prefix}A"), (F.col(f"{prefix}b8") - 128.0).alias(f"{prefix}B"),
    )


def delta_e76_lab8(p: str, q: str) -> Column:
    """Euclidean distance on the 8-bit scale."""
    sq = lambda s: F.pow(F.col(f"{p}{s}") - F.col(f"{q}{s}"), 2)
    return F.sqrt(sq("l8") + sq("a8") + sq("b8"))


def with_ciede2000(df: DataFrame, p: str, q: str, out: str) -> DataFrame:
    """Adds the CIEDE2000 difference of two true-Lab column triples."""
    c = F.col
    rad, deg = F.radians, F.degrees
    L1, A1, B1, L2, A2, B2 = (c(f"{s}{k}") for s in (p, q) for k in "LAB")
    big = 25.0**7
    df = df.select("*", (F.hypot(A1, B1) * 0.5 + F.hypot(A2, B2) * 0.5).alias("_cb"))
    df = df.select("*", ((1 - F.sqrt(F.pow("_cb", F.lit(7.0)) / (F.pow("_cb", F.lit(7.0)) + big + 1e-12))) * 0.5 + 1).alias("_g"))
    df = df.select("*", (c("_g") * A1).alias("_a1"), (c("_g") * A2).alias("_a2"))
    df = df.select(
        "*", F.hypot("_a1", B1).alias("_c1"), F.hypot("_a2", B2).alias("_c2"),
        F.pmod(deg(F.atan2(B1, c("_a1"))), F.lit(360.0)).alias("_h1"), F.pmod(deg(F.atan2(B2, c("_a2"))), F.lit(360.0)).alias("_h2"),
    )
    dh = c("_h2") - c("_h1")
    hsum = c("_h1") + c("_h2")
    df = df.select(
        "*", F.when(dh > 180, dh - 360).when(dh < -180, dh + 360).otherwise(dh).alias("_dh"),
        ((L1 + L2) * 0.5).alias("_lb"), ((c("_c1") + c("_c2")) * 0.5).alias("_cp"),
        F.when(c("_c1") * c("_c2") == 0, hsum).when(F.abs(dh) > 180, (hsum + 360) / 2).otherwise(hsum / 2).alias("_hb"),
    )
    t = (
        1 - F.cos(rad(c("_hb") - 30)) * 0.17 + F.cos(rad(c("_hb") * 2)) * 0.24
        + F.cos(rad(c("_hb") * 3 + 6)) * 0.32 - F.cos(rad(c("_hb") * 4 - 63)) * 0.20
    )
    df = df.select(
        "*", (F.sin(rad(c("_dh")) / 2) * F.sqrt(c("_c1") * c("_c2")) * 2).alias("_dq"), t.alias("_t"),
        (F.pow(c("_lb") - 50, 2)).alias("_ls"), F.exp(-F.pow((c("_hb") - 275) / 25, 2)).alias("_ex"),
        (F.sqrt(F.pow("_cp", F.lit(7.0)) / (F.pow("_cp", F.lit(7.0)) + big + 1e-12)) * 2).alias("_rc"),
    )
    df = df.select(
        "*", ((L2 - L1) / (c("_ls") * 0.015 / F.sqrt(c("_ls") + 20) + 1)).alias("_x"),
        ((c("_c2") - c("_c1")) / (c("_cp") * 0.045 + 1)).alias("_y"), (c("_dq") / (c("_cp") * c("_t") * 0.015 + 1)).alias("_z"),
        (-c("_rc") * F.sin(rad(c("_ex") * 60))).alias("_rt"),
    )
    total = c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z") + c("_rt") * c("_y") * c("_z")
    steps = ["_cb", "_g", "_a1", "_a2", "_c1", "_c2", "_h1", "_h2", "_dh", "_lb", "_cp", "_hb", "_dq", "_t", "_ls", "_ex", "_rc", "_x", "_y", "_z", "_rt"]
    return df.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), total))).drop(*steps)


def same_tone_family(p: str, q: str) -> Column:
    """Two lab8 triples of one tone family: distance <= 45, neutral rules, hue within 30 degrees."""
    c = F.col
    ca, cb = (F.hypot(c(f"{s}a8") - 128.0, c(f"{s}b8") - 128.0) for s in (p, q))
    ha, hb = (F.degrees(F.atan2(c(f"{s}b8") - 128.0, c(f"{s}a8") - 128.0)) for s in (p, q))
    dh = F.abs(ha - hb) % 360.0
    return (delta_e76_lab8(p, q) <= 45.0) & (
        F.when((ca <= 10.0) & (cb <= 10.0), True)
        .when((ca <= 10.0) | (cb <= 10.0), (ca <= 14.0) & (cb <= 14.0))
        .otherwise(F.least(dh, 360.0 - dh) <= 30.0)
    )


def blend_residual(cr: tuple[str, str, str], ca: tuple[str, str, str], cb: tuple[str, str, str]) -> tuple[Column, Column]:
    """(residual, t) of the best linear-light mix t*ca + (1-t)*cb for cr.

    Column names hold linear values (see ``srgb_to_linear``).
    """
    c = F.col
    d = [c(a) - c(b) for a, b in zip(ca, cb)]
    denom = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    dot = sum(((c(r) - c(b)) * e for r, b, e in zip(cr, cb, d)), F.lit(0.0))
    flat = denom < 1e-9
    t = F.when(flat, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / denom)))
    miss = sum((F.pow(c(r) - (t * c(a) + (1 - t) * c(b)), 2) for r, a, b in zip(cr, ca, cb)), F.lit(0.0))
    near = sum((F.pow(c(r) - c(a), 2) for r, a in zip(cr, ca)), F.lit(0.0))
    return F.sqrt(F.when(flat, near).otherwise(miss)), t


def register_sql_functions(spark: SparkSession) -> None:
    """The scalar colour functions as temporary SQL functions."""
    define = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{define} luma601(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN r*0.299e0 + g*0.587e0 + b*0.114e0")
    spark.sql(f"{define} luma709(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN r*0.2126e0 + g*0.7152e0 + b*0.0722e0")
    spark.sql(f"{define} srgb_linear(v DOUBLE) RETURNS DOUBLE RETURN CASE WHEN v/255e0 <= 0.04045e0 THEN v/255e0/12.92e0 ELSE power((v/255e0+0.055e0)/1.055e0, 2.4e0) END")
    spark.sql(f"{define} lab_f(t DOUBLE) RETURNS DOUBLE RETURN CASE WHEN t > 0.008856e0 THEN cbrt(t) ELSE t*7.787e0 + 16e0/116e0 END")
    spark.sql(f"{define} delta_e76(l1 DOUBLE, a1 DOUBLE, b1 DOUBLE, l2 DOUBLE, a2 DOUBLE, b2 DOUBLE) RETURNS DOUBLE RETURN sqrt((l1-l2)*(l1-l2)+(a1-a2)*(a1-a2)+(b1-b2)*(b1-b2))")
