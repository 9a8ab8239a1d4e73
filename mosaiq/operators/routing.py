"""Scoring and routing rules over feature, candidate and metric rows.

All operators are projections: no shuffle, everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.columns import codes, finite, lookup
from mosaiq.operators.calibration import AUTO_MODES

# Feature rules, score weights and gate thresholds.
FEATURE_RULES = {
    "estimated_color_count": ("integer", 0, 48), "flat_color_count": ("integer", 0, 48),
    "blur_score": ("number", 0.0, 1.0e12), "edge_density": ("number", 0.0, 1.0),
    "quality_score": ("number", 0.0, 100.0), "thin_ink_ratio": ("number", 0.0, 1.0),
    "straight_edge_likelihood": ("number", 0.0, 1.0), "corner_likelihood": ("number", 0.0, 1.0),
    "has_gradient": ("boolean", None, None), "likely_geometric_logo": ("boolean", None, None),
    "likely_text_logo": ("boolean", None, None), "likely_color_logo": ("boolean", None, None),
    "likely_photo_or_complex": ("boolean", None, None), "likely_single_color": ("boolean", None, None),
    "likely_line_art": ("boolean", None, None), "semantic_photo_like": ("boolean", None, None),
    "semantic_edge_density": ("number", 0.0, 1.0), "edge_coherence": ("number", 0.0, 1.0),
}
OPTIONAL_PAIR = ("semantic_edge_density", "edge_coherence")
FLAT_MODES = ["geometric_logo", "minimal_ai", "flat_logo"]
BINARY_MODES = ["single_color", "lineart", "centerline"]
WEIGHTS = {
    "geometric": {"color": 0.16, "edge": 0.16, "detail": 0.10, "path": 0.08, "warning": 0.08,
                  "straight_edge": 0.17, "corner_cleanliness": 0.15, "axis_alignment": 0.10},
    "flat": {"color": 0.25, "edge": 0.25, "detail": 0.10, "path": 0.15, "warning": 0.10, "geometry": 0.15},
    "binary": {"color": 0.18, "edge": 0.22, "detail": 0.10, "path": 0.15, "warning": 0.10, "geometry": 0.25},
    "color": {"color": 0.25, "edge": 0.30, "detail": 0.25, "path": 0.12, "warning": 0.08},
}
SCORE_PARTS = ["color", "edge", "detail", "path", "warning", "straight_edge", "corner_cleanliness", "axis_alignment", "geometry"]
_SHARED_ALPHA = {"alpha_iou_min": 0.995, "alpha_mae_max": 0.005, "alpha_background_ssim_min": 0.995, "alpha_background_mae_max": 0.008}
GATE_THRESHOLDS = {
    "clean_logo": {"comp_delta": 0, "hole_delta": 0, "seam_ratio": 0.002, "de00_p95": 6.0, "worst_face_de00": 8.0,
                   "ssim_min": 0.9897, "edge_f1_min": 0.9940, "min_component_iou": 0.90, **_SHARED_ALPHA},
    "lineart": {"comp_delta": 0, "hole_delta": 0, "seam_ratio": 0.003, "de00_p95": 8.0, "worst_face_de00": 10.0,
                "ssim_min": 0.97, "edge_f1_min": 0.98, "min_component_iou": 0.85, **_SHARED_ALPHA},
    "geometric": {"comp_delta": 0, "hole_delta": 0, "seam_ratio": 0.002, "de00_p95": 6.0, "worst_face_de00": 8.0,
                  "ssim_min": 0.985, "edge_f1_min": 0.99, "min_component_iou": 0.90, **_SHARED_ALPHA},
    "illustration": {"comp_delta": 3, "hole_delta": 2, "seam_ratio": 0.006, "de00_p95": 10.0, "worst_face_de00": 14.0,
                     "ssim_min": 0.94, "edge_f1_min": 0.94, "min_component_iou": 0.70, "alpha_iou_min": 0.990,
                     "alpha_mae_max": 0.010, "alpha_background_ssim_min": 0.985, "alpha_background_mae_max": 0.015},
    "photo": {"comp_delta": 9999, "hole_delta": 9999, "seam_ratio": 0.02, "de00_p95": 20.0, "worst_face_de00": 30.0,
              "ssim_min": 0.80, "edge_f1_min": 0.70, "min_component_iou": 0.40, "alpha_iou_min": 0.985,
              "alpha_mae_max": 0.015, "alpha_background_ssim_min": 0.975, "alpha_background_mae_max": 0.025},
}
QUALITY_POLICY = {"min_fidelity": 0.98, "min_edge_f1": 0.96, "max_delta_e": 2.8, "max_banding_ratio": 0.008}
LOW_FIDELITY, RECALL_WARN, RECALL_SEVERE, PRECISION_WARN = 78.0, 0.985, 0.955, 0.96


def image_quality_score(df: DataFrame) -> DataFrame:
    """0..100 penalty score from width, height, blur, colours, edges and background."""
    side = F.least("width", "height")
    n = F.col("estimated_color_count")
    penalty = (
        F.when(side < 512, 25).when(side < 900, 10).otherwise(0)
        + F.when(F.col("blur_score") < 40, 30).when(F.col("blur_score") < 90, 12).otherwise(0)
        + F.when(n > 28, 18).when(n > 16, 8).otherwise(0)
        + F.when(F.col("edge_density") > 0.18, 12).otherwise(0)
        + F.when(F.col("has_gradient"), 6).otherwise(0)
        + F.when(F.col("is_uniform_background"), 0).otherwise(8)
    )
    return df.withColumn("image_quality", F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)))


def route_mode(f: DataFrame) -> DataFrame:
    """Named predicates, detected type and warnings from measured features.

    Inputs: estimated_color_count, flat_color_count, edge_density, blur_score,
    quality_score, min_side, thin_ink_ratio, straight_edge_likelihood,
    corner_likelihood, has_gradient, is_uniform_background, has_alpha_foreground,
    has_black, has_white, has_red, saturated_ratio, neutral_ratio,
    non_red_saturated_ratio, vivid_hue_count, foreground_color_count,
    vivid_ratio and the nullable semantic_edge_density.
    """
    c = F.col
    flat, edge = c("flat_color_count"), c("edge_density")
    df = f.select(
        "*",
        (c("vivid_hue_count") >= 3).alias("vivid_multicolor"),
        (c("foreground_color_count") >= 90).alias("rich_foreground"),
        (c("foreground_color_count") >= 28).alias("has_color_foreground"),
        (c("vivid_ratio") >= 0.02).alias("chromatic_accents"),
        ((flat <= 8) & (edge <= 0.105) & c("has_black") & c("has_white") & c("has_red") & (c("non_red_saturated_ratio") <= 0.035)).alias("bwr"),
    )
    df = df.withColumn(
        "gradient0",
        c("has_gradient") | (c("rich_foreground") & (c("vivid_ratio") >= 0.08) & c("is_uniform_background") & (edge <= 0.08)),
    ).withColumn("gradient", c("gradient0") & ~c("bwr"))
    df = df.withColumn(
        "is_flat0", (flat <= 10) & ~c("gradient") & (edge <= 0.13) & (c("blur_score") >= 45) & (c("has_black") | c("has_white"))
    )
    hard = (flat <= 8) & ~c("gradient") & (edge <= 0.105) & c("has_black") & c("has_white") & c("has_red")
    soft = c("is_flat0") & (flat <= 6) & (edge <= 0.085) & (c("saturated_ratio") <= 0.35) & c("has_black") & c("has_white")
    df = df.withColumn("geometric0", hard | soft)
    rescue = (
        ~c("geometric0") & (flat <= 8) & ~c("gradient") & (edge <= 0.13) & c("has_black") & c("has_white")
        & (
            (c("has_red") & (c("non_red_saturated_ratio") <= 0.035))
            | ((c("saturated_ratio") <= 0.35) & (c("non_red_saturated_ratio") <= 0.045))
        )
        & (c("straight_edge_likelihood") >= 0.34) & (c("corner_likelihood") >= 0.28)
    )
    df = df.withColumn("_rescue", rescue)
    df = df.withColumn("is_flat_logo", c("is_flat0") | c("_rescue")).withColumn("geometric", c("geometric0") | c("_rescue"))
    neutral = (c("neutral_ratio") >= 0.82) & (c("saturated_ratio") <= 0.10)
    df = df.select(
        "*",
        (~c("gradient") & c("has_black") & c("has_white") & ~c("has_red") & ~c("has_alpha_foreground") & (edge >= 0.018)
         & ((flat <= 4) | ((flat <= 16) & neutral))).alias("line_art"),
        ((flat <= 3) & ~c("gradient") & c("has_black") & c("has_white") & ~c("has_red") & (edge < 0.08) & (c("thin_ink_ratio") <= 0.55)).alias("single"),
        (c("is_flat_logo") & c("has_black") & c("has_white") & (flat <= 12) & (edge <= 0.14)).alias("text_logo"),
        ((flat > 8) | c("gradient") | c("vivid_multicolor") | c("rich_foreground") | (c("saturated_ratio") > 0.38)
         | (c("non_red_saturated_ratio") > 0.045) | ((flat >= 7) & (c("saturated_ratio") > 0.22) & ~c("bwr"))).alias("color_logo"),
        ((c("estimated_color_count") > 28) | (c("gradient") & (edge > 0.11))
         | ((c("quality_score") < 45) & (c("estimated_color_count") > 16))).alias("complex"),
        ((c("estimated_color_count") > 34) & ~c("has_alpha_foreground") & ~c("is_flat_logo")
         & (~c("is_uniform_background") | (c("gradient") & (edge > 0.11) & (c("straight_edge_likelihood") < 0.28)))).alias("photo0"),
        F.coalesce(
            (edge / F.greatest("semantic_edge_density", F.lit(0.005)) >= 1.2) & (edge >= 0.05)
            & (c("semantic_edge_density") < 0.12) & ~c("has_alpha_foreground") & ~c("is_flat_logo"),
            F.lit(False),
        ).alias("semantic_photo"),
    )
    rich = c("color_logo") & ~c("bwr") & (c("vivid_multicolor") | c("rich_foreground") | (c("saturated_ratio") >= 0.18) | (flat >= 10))
    binary_ok = ~c("has_color_foreground") & ~c("chromatic_accents")
    mode = (
        F.when(c("single") & binary_ok, "single_color")
        .when(c("line_art") & binary_ok, "lineart")
        .when(c("photo0") | c("semantic_photo"), "photo_poster")
        .when(rich, "logo_color")
        .when(c("geometric"), "geometric_logo")
        .when(c("text_logo") & ~c("color_logo"), "minimal_ai")
        .when((flat <= 12) & ~c("gradient") & (edge < 0.14) & (c("quality_score") >= 55) & ~c("color_logo") & (c("has_black") | c("has_white")), "minimal_ai")
        .otherwise("logo_color")
    )
    df = df.withColumn("recommended_mode", mode).withColumn("_rich", rich)
    is_complex = (c("recommended_mode") == "logo_color") & ~c("_rich") & c("complex")
    warn = codes(
        ("low_resolution", c("min_side") < 512),
        ("blurry", c("blur_score") < 40),
        ("many_colors", c("estimated_color_count") > 28),
        ("gradient_detected", c("gradient0")),
        ("background_not_uniform", ~c("is_uniform_background") & ~c("recommended_mode").isin("minimal_ai", "geometric_logo", "single_color", "lineart")),
        ("photo_like", c("recommended_mode") == "photo_poster"),
        ("complex_color", is_complex),
    )
    geo = c("recommended_mode") == "geometric_logo"
    return df.select(
        *f.columns[:1], c("recommended_mode").alias("detected_type"), "recommended_mode",
        (c("gradient") & ~geo).alias("gradient_flag"), (c("color_logo") & ~geo).alias("likely_color_logo"),
        c("geometric").alias("likely_geometric_logo"), c("text_logo").alias("likely_text_logo"),
        c("line_art").alias("likely_line_art"), c("single").alias("likely_single_color"),
        c("complex").alias("likely_photo_or_complex"), c("semantic_photo").alias("semantic_photo_like"),
        F.array_join(warn, ",").alias("warnings"),
    )


def validate_features(df: DataFrame, key: str = "image_id", rules: dict = FEATURE_RULES) -> DataFrame:
    """(key, code) for every broken feature rule; absent columns count as missing."""
    pairs: list[tuple[str, Column]] = []
    for name, (kind, low, high) in rules.items():
        if name not in df.columns:
            if name not in OPTIONAL_PAIR:
                pairs.append((f"missing_feature:{name}", F.lit(True)))
            continue
        c = F.col(name)
        if name not in OPTIONAL_PAIR:
            pairs.append((f"missing_feature:{name}", c.isNull()))
        if kind == "boolean":
            if dict(df.dtypes)[name] != "boolean":
                pairs.append((f"invalid_boolean:{name}", c.isNotNull()))
            continue
        ok = finite(name)
        inside = c.between(low, high)
        pairs.append((f"nonfinite_or_invalid:{name}", c.isNotNull() & ~ok))
        pairs.append((f"out_of_range:{name}", ok & ~inside))
        if kind == "integer":
            pairs.append((f"non_integer:{name}", ok & inside & (F.floor(c) != c)))
    a, b = OPTIONAL_PAIR
    if a in df.columns and b in df.columns:
        pairs.append(("partial_optional_signal:hed", F.col(a).isNull() != F.col(b).isNull()))
    return df.select(key, F.explode(codes(*pairs)).alias("code"))


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def support_score(mode: str) -> Column:
    c, on = F.col, _flag
    flat, edge, quality, thin = c("flat_color_count"), c("edge_density"), c("quality_score"), c("thin_ink_ratio")
    terms = {
        "geometric_logo": [(0.40, on(c("likely_geometric_logo"))), (0.15, on(c("straight_edge_likelihood") >= 0.34)),
                           (0.15, on(c("corner_likelihood") >= 0.28)), (0.10, on(flat <= 8)), (0.10, on(~c("has_gradient")))],
        "minimal_ai": [(0.35, on(c("likely_text_logo"))), (0.15, on(flat <= 12)), (0.10, on(~c("has_gradient"))),
                       (0.10, on(quality >= 55)), (0.10, on(~c("likely_color_logo")))],
        "logo_color": [(0.35, on(c("likely_color_logo"))), (0.15, on(c("has_gradient"))), (0.15, on(flat > 8)),
                       (0.10, on(c("likely_photo_or_complex"))), (0.05, on(quality < 55))],
        "single_color": [(0.45, on(c("likely_single_color"))), (0.15, on(flat <= 3)), (0.15, on(thin <= 0.55)), (0.10, on(edge < 0.08))],
        "lineart": [(0.45, on(c("likely_line_art"))), (0.15, on(flat <= 4)), (0.15, on(thin > 0.55)), (0.10, on(edge >= 0.018))],
        "photo_poster": [(0.45, on(c("semantic_photo_like"))), (0.20, on(c("likely_photo_or_complex"))), (0.10, on(flat > 28)),
                         (0.10, on(edge > 0.11)), (0.05, on(quality < 45))],
    }
    total = F.lit(0.10)
    for weight, hit in terms[mode]:
        total = total + F.lit(weight) * hit
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)


def mode_support_scores(df: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, mode, score, rank, margin): rank by score then fixed order, margin to the best other mode."""
    entries = F.array(*[F.struct((-support_score(m)).alias("neg"), F.lit(i).alias("o"), F.lit(m).alias("mode")) for i, m in enumerate(AUTO_MODES)])
    ranked = df.select(key, F.array_sort(entries).alias("s"))
    out = ranked.select(key, "s", F.posexplode("s").alias("pos", "e"))
    other = F.when(F.col("pos") == 0, F.col("s")[1]["neg"]).otherwise(F.col("s")[0]["neg"])
    return out.select(
        key, F.col("e.mode").alias("mode"), (-F.col("e.neg")).alias("score"), (F.col("pos") + 1).alias("rank"),
        F.bround(other - F.col("e.neg"), 6).alias("margin"),
    )


def candidate_subscores(df: DataFrame) -> DataFrame:
    """path, colour, detail and warning scores from path_count, node_count, unique_colors, has_bitmap, mode."""
    c = F.col
    paths, nodes, colors = c("path_count"), c("node_count"), c("unique_colors")
    lo = lookup("mode", {"logo_color": 120, "photo_poster": 60}, 3)
    hi = lookup("mode", {"logo_color": 2600, "photo_poster": 5000}, 600)
    path = (
        F.when(paths <= 0, 0.0)
        .when(paths.between(lo, hi), 100.0)
        .when(paths < lo, F.bround(F.greatest(F.lit(45.0), 100.0 - (lo - paths) / lo * 55.0), 2))
        .otherwise(F.bround(F.greatest(F.lit(0.0), 100.0 - (paths - hi) / hi * 60.0), 2))
    )
    expected = F.greatest(F.lit(1), c("estimated_color_count"))
    color = (
        F.when(colors <= 0, 0.0)
        .when(c("mode").isin(FLAT_MODES), F.when(colors <= F.greatest(F.lit(6), expected + 1), 100.0)
              .otherwise(F.greatest(F.lit(40.0), 100.0 - (colors - (expected + 1)) * 8.0)))
        .when(c("mode").isin(BINARY_MODES), F.when(colors <= 3, 100.0).otherwise(F.greatest(F.lit(50.0), 100.0 - (colors - 3) * 12.0)))
        .when(c("mode") == "logo_color", F.when(colors.between(12, 64), 100.0)
              .when(colors < 12, F.greatest(F.lit(50.0), 100.0 - (12 - colors) * 5.0))
              .otherwise(F.greatest(F.lit(45.0), 100.0 - (colors - 64) * 4.0)))
        .otherwise(80.0)
    )
    per_path = nodes / paths
    detail = (
        F.when((paths <= 0) | (nodes <= 0), 0.0)
        .when(c("mode").isin(FLAT_MODES + BINARY_MODES),
              F.when(per_path <= 40, 100.0).otherwise(F.bround(F.greatest(F.lit(40.0), 100.0 - (per_path - 40) * 1.5), 2)))
        .when(nodes >= 400, 100.0)
        .otherwise(F.bround(F.greatest(F.lit(45.0), 50.0 + nodes / 8.0), 2))
    )
    warning = F.greatest(
        F.lit(0.0),
        100.0 - F.when(c("has_bitmap"), 60.0).otherwise(0.0) - F.when(paths == 0, 100.0).otherwise(0.0)
        - F.when(paths > 3000, 20.0).otherwise(0.0) - F.when(c("mode").isin(FLAT_MODES) & (colors > 8), 15.0).otherwise(0.0),
    )
    return (
        df.withColumn("path_score", path).withColumn("color_score", color)
        .withColumn("detail_score", detail).withColumn("warning_score", warning)
    )


def weighted_total(df: DataFrame, places: int = 2) -> DataFrame:
    """``total`` = sum of ``<part>_score`` times the weight of the row's mode, rounded half-even."""
    group = (
        F.when(F.col("mode") == "geometric_logo", "geometric").when(F.col("mode").isin("minimal_ai", "flat_logo"), "flat")
        .when(F.col("mode").isin(BINARY_MODES), "binary").otherwise("color")
    )
    df = df.withColumn("_group", group)
    total = F.lit(0.0)
    for part in SCORE_PARTS:
        if f"{part}_score" in df.columns:
            weight = lookup("_group", {g: w.get(part, 0.0) for g, w in WEIGHTS.items()})
            total = total + F.coalesce(F.col(f"{part}_score"), F.lit(0.0)) * weight
    return df.withColumn("total", F.bround(total, places)).drop("_group")


def mode_warning(df: DataFrame, centerline_tool: bool = False) -> DataFrame:
    """Warning code for a manually requested mode that fits the image badly."""
    used, n = F.col("mode_used"), F.col("estimated_color_count")
    warn = (
        F.when(F.col("trace_mode") == "auto", None)
        .when((used == "minimal_ai") & (n > 12), "many_colors_for_minimal")
        .when((used == "logo_color") & F.col("likely_geometric_logo"), "looks_geometric")
        .when((used == "geometric_logo") & F.col("likely_color_logo") & (n > 12), "many_colors_for_geometric")
    )
    if not centerline_tool:
        warn = warn.when(used == "centerline", "centerline_fallback")
    return df.withColumn("mode_warning", warn)


def quality_report(df: DataFrame) -> DataFrame:
    """status and warning codes of a chosen candidate.

    Inputs: mode, path_count, unique_colors, has_bitmap, total_score and the
    nullable fidelity, ink_recall, ink_precision, component_delta, components.
    """
    c = F.col
    paths, colors, fid = c("path_count"), c("unique_colors"), c("fidelity")
    flat = c("mode").isin(FLAT_MODES + BINARY_MODES)
    on = lambda cond: F.coalesce(cond, F.lit(False))
    good_fid, low_fid = on(fid >= 85.0), on(fid < LOW_FIDELITY)
    measured = c("ink_recall").isNotNull()
    structure_ok = on(c("ink_recall") >= RECALL_WARN)
    stray = on(c("ink_precision") < PRECISION_WARN)
    pieces = on((c("components") > 0) & (c("component_delta") > F.greatest(F.lit(2), F.floor(c("components") * 0.5))))
    broken = measured & (on(c("ink_recall") < RECALL_SEVERE) | stray | pieces)
    exempt = flat & (colors <= 6) & (paths >= 10)
    color_mode, photo = c("mode") == "logo_color", c("mode") == "photo_poster"
    warn = codes(
        ("embedded_bitmap", c("has_bitmap")),
        ("no_paths", paths == 0),
        ("low_path_count", color_mode & paths.between(1, 249) & ~good_fid),
        ("high_color_count", color_mode & (colors > 64)),
        ("very_low_path_count", ~color_mode & ~exempt & paths.between(1, 3) & ~good_fid & ~structure_ok),
        ("very_high_path_count", paths > 3000),
        ("too_many_colors_for_flat", flat & (colors > 8)),
        ("low_fidelity", low_fid),
        ("photo_product_limit", photo),
        ("missing_strokes", on(c("ink_recall") < RECALL_WARN)),
        ("stray_marks", measured & stray),
        ("fragmented_shapes", measured & pieces),
    )
    df = df.withColumn("warnings", warn).withColumn("_broken", broken)
    quiet = F.size("warnings") == 0
    status = (
        F.when(paths == 0, "failed")
        .when(c("has_bitmap") | c("_broken") | photo | low_fid, "needs_review")
        .when(quiet & ((c("total_score") >= 80.0) | on(fid >= 90.0)), "production_ready")
        .when(quiet & (c("total_score") >= 70.0), "production_ready")
        .otherwise("needs_review")
    )
    return df.withColumn("status", status).drop("_broken")


def gate_limit(name: str) -> Column:
    """Threshold of the row's image_class; unknown classes use illustration."""
    return lookup("image_class", {k: float(v[name]) for k, v in GATE_THRESHOLDS.items()}, float(GATE_THRESHOLDS["illustration"][name]))


def artifact_gate(df: DataFrame) -> DataFrame:
    """hard / soft / unmeasured codes and verdict of a measured artifact.

    Metrics: comp_delta, hole_delta, seam_ratio, de00_p95, worst_face_de00,
    ssim, edge_f1, and nullable min_component_iou, alpha_iou, alpha_mae plus
    has_alpha; optional baseline_ssim / baseline_edge_f1 / baseline_seam_ratio
    tighten the limits.
    """
    cols = df.columns
    base = lambda c: F.col(c) if c in cols else F.lit(None).cast("double")
    ssim_min = F.greatest(gate_limit("ssim_min"), base("baseline_ssim") - 0.002)
    edge_min = F.greatest(gate_limit("edge_f1_min"), base("baseline_edge_f1") - 0.003)
    seam_max = F.least(gate_limit("seam_ratio"), base("baseline_seam_ratio") + 0.0005)
    strict = F.col("image_class").isin("clean_logo", "lineart", "geometric")
    alpha = F.col("has_alpha")
    measured = F.col("alpha_iou").isNotNull()  # then a missing background counts as the worst
    required = ["seam_ratio", "de00_p95", "worst_face_de00", "ssim", "edge_f1"]
    hard = codes(
        ("topology_component_delta", strict & (F.col("comp_delta") > gate_limit("comp_delta"))),
        ("topology_hole_delta", strict & (F.col("hole_delta") > gate_limit("hole_delta"))),
        ("seam_gap", F.col("seam_ratio") > seam_max),
        ("ssim_below_min", F.col("ssim") < ssim_min),
        ("alpha_iou_below_min", alpha & (F.col("alpha_iou") < gate_limit("alpha_iou_min"))),
        ("alpha_mae_above_max", alpha & (F.col("alpha_mae") > gate_limit("alpha_mae_max"))),
        *[
            (f"alpha_{bg}_{m}", alpha & cond)
            for bg in ("white", "black", "checker")
            for m, cond in [
                ("ssim_below_min", measured & (F.coalesce(base(f"{bg}_ssim"), F.lit(0.0)) < gate_limit("alpha_background_ssim_min"))),
                ("mae_above_max", measured & (F.coalesce(base(f"{bg}_mae"), F.lit(1.0)) > gate_limit("alpha_background_mae_max"))),
            ]
        ],
    )
    soft = codes(
        ("color_de00_p95", F.col("de00_p95") > gate_limit("de00_p95")),
        ("worst_face_de00", F.col("worst_face_de00") > gate_limit("worst_face_de00")),
        ("edge_f1_below_min", F.col("edge_f1") < edge_min),
        ("component_iou_below_min", F.col("min_component_iou") < gate_limit("min_component_iou")),
    )
    missing = codes(*[(m, ~finite(m)) for m in required], ("alpha_fidelity", alpha & F.col("alpha_iou").isNull()))
    return (
        df.withColumn("hard_codes", hard).withColumn("soft_codes", soft).withColumn("unmeasured", missing)
        .withColumn("verdict", F.when(F.size("hard_codes") > 0, "failed")
                    .when((F.size("unmeasured") > 0) | (F.size("soft_codes") > 0), "needs_review").otherwise("production_ready"))
    )


def quality_contract(df: DataFrame, policy: dict[str, float] = QUALITY_POLICY) -> DataFrame:
    """Hard targets on fidelity, edge_f1, mean_delta_e and banding_ratio; missing fails."""
    ok = (
        (F.col("fidelity") >= policy["min_fidelity"]) & (F.col("edge_f1") >= policy["min_edge_f1"])
        & (F.col("mean_delta_e") <= policy["max_delta_e"]) & (F.col("banding_ratio") <= policy["max_banding_ratio"])
    )
    return df.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def final_verdict(df: DataFrame) -> DataFrame:
    """Artifact verdict lowered by the automatic decision or the quality report.

    Columns: verdict, soft_codes, requested_mode, decision, quality_status.
    """
    review = (F.col("requested_mode") == "auto") & (F.col("decision") == "needs_review")
    lowered = F.when(review & (F.col("verdict") == "production_ready"), "needs_review").otherwise(F.col("verdict"))
    final = (
        F.when(F.col("quality_status") == "failed", "failed")
        .when(lowered.isin("failed", "needs_review") | (F.col("quality_status") == "needs_review"), "needs_review")
        .otherwise("production_ready")
    )
    added = F.when(review, F.array_union("soft_codes", F.array(F.lit("analyzer_auto_review")))).otherwise(F.col("soft_codes"))
    return df.withColumn("artifact_verdict", lowered).withColumn("soft_codes", added).withColumn("final_verdict", final)
