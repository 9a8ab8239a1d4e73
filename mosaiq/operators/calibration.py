"""Analyzer calibration and release measures over labelled decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.columns import codes, finite

# Automatic modes, bins and release limits.
AUTO_MODES = ["geometric_logo", "minimal_ai", "logo_color", "single_color", "lineart", "photo_poster"]
CASE_KINDS = ["in_domain", "boundary"]
MARGIN_BINS = [(-1.0, 0.05), (0.05, 0.20), (0.20, 0.40), (0.40, 1.0)]
CONFIDENCE_BINS = [(0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0)]
RELEASE_LIMITS = {"precision": 1.0, "correct": 1, "accepted_precision": 1.0, "brier": 0.35, "ece": 0.35}
MIN_CONFIDENCE = 0.50
MIN_MARGIN = 0.05


def bin_number(value: Column, bins: list[tuple[float, float]]) -> Column:
    """Index of the half-open bin (lo, hi]; the first bin also holds its lower edge."""
    expr = F.when(value.between(*bins[0]), F.lit(0))
    for i, (lo, hi) in enumerate(bins[1:], start=1):
        expr = expr.when((value > lo) & (value <= hi), F.lit(i))
    return expr


def margin_bin(value: Column) -> Column:
    """As ``bin_number``, but margins beyond 1 fall in the last and others in the first bin."""
    return F.coalesce(bin_number(value, MARGIN_BINS), F.when(value > 1.0, len(MARGIN_BINS) - 1).otherwise(0))


def calibration_bins(cases: DataFrame) -> DataFrame:
    """Laplace-smoothed confidence per margin bin (every bin is present)."""
    spark = cases.sparkSession
    bins = spark.range(len(MARGIN_BINS)).select(F.col("id").cast("int").alias("bin"))
    got = cases.groupBy(margin_bin(F.col("runner_up_margin")).alias("bin")).agg(
        F.count_if(F.col("recommended_mode") == F.col("label")).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.broadcast(bins).join(got, "bin", "left").select(
        "bin", n("correct").alias("correct"), n("total").alias("total"),
        F.bround((n("correct") + 1) / (n("total") + 2), 6).alias("confidence"),
    )


def calibrated_confidence(decisions: DataFrame, bins: DataFrame) -> DataFrame:
    """Cap the selected score by its bin, by .25 below zero margin and .85 without the optional signal.

    ``decisions`` has selected_score, runner_up_margin and signal_available.
    """
    small = F.broadcast(bins.select("bin", F.col("confidence").alias("_bc")))  # one row per fixed bin
    c = F.least(F.col("selected_score"), F.col("_bc"))
    c = F.least(c, F.when(F.col("runner_up_margin") < 0, F.lit(0.25)))
    c = F.least(c, F.when(~F.col("signal_available"), F.lit(0.85)))
    return (
        decisions.withColumn("bin", margin_bin(F.col("runner_up_margin")))
        .join(small, "bin", "left")
        .withColumn("calibrated", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6))
        .drop("_bc")
    )


def auto_decision(decisions: DataFrame) -> DataFrame:
    """accepted / needs_review / manual with reason codes.

    ``requested_mode`` and ``support_contradiction`` are optional columns.
    """
    cols = decisions.columns
    manual = (F.col("requested_mode") != "auto") if "requested_mode" in cols else F.lit(False)
    contradiction = F.col("support_contradiction") if "support_contradiction" in cols else F.lit(False)
    reasons = codes(
        ("confidence_missing", F.col("confidence").isNull()),
        ("confidence_below_minimum", F.col("confidence") < MIN_CONFIDENCE),
        ("margin_missing", F.col("runner_up_margin").isNull()),
        ("margin_below_minimum", F.col("runner_up_margin") < MIN_MARGIN),
        ("support_contradiction", contradiction),
    )
    return decisions.withColumn(
        "decision", F.when(manual, "manual").when(F.size(reasons) > 0, "needs_review").otherwise("accepted")
    ).withColumn(
        "reason_codes",
        F.when(manual, F.array(F.lit("manual_mode_bypass")))
        .when(F.size(reasons) > 0, reasons)
        .otherwise(F.array(F.lit("verified_recommendation"))),
    )


def confusion_matrix(cases: DataFrame) -> DataFrame:
    """Per mode: recommended and accepted counts, precision and recall (null on zero denominators)."""
    modes = F.explode(F.array(*map(F.lit, AUTO_MODES))).alias("mode")
    grid = cases.sparkSession.range(1).select(modes)
    known = F.col("label").isin(AUTO_MODES)
    accepted = F.col("decision_status") == "accepted"
    right = F.col("label") == F.col("recommended_mode")
    by_prediction = cases.groupBy(F.col("recommended_mode").alias("mode")).agg(
        F.count_if(known).alias("recommended"),
        F.count_if(known & right).alias("correct"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & right).alias("accepted_correct"),
    )
    by_label = cases.groupBy(F.col("label").alias("mode")).agg(
        F.count(F.lit(1)).alias("labelled"), F.count_if(right).alias("_hit")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(n(b) > 0, n(a) / n(b))
    return (
        F.broadcast(grid).join(by_prediction, "mode", "left").join(by_label, "mode", "left")
        .select(
            "mode", n("recommended").alias("recommended"), n("correct").alias("correct"),
            n("accepted").alias("accepted"), n("labelled").alias("labelled"),
            ratio("correct", "recommended").alias("precision"),
            ratio("accepted_correct", "accepted").alias("accepted_precision"),
            F.coalesce(ratio("_hit", "labelled"), F.lit(0.0)).alias("recall"),
        )
    )


def confusion_counts(cases: DataFrame) -> DataFrame:
    """The label x prediction matrix itself, one row per label."""
    return cases.where(F.col("label").isin(AUTO_MODES)).groupBy("label").pivot("recommended_mode", AUTO_MODES).agg(F.count(F.lit(1))).na.fill(0)


def calibration_error(cases: DataFrame) -> DataFrame:
    """Brier score and expected calibration error of "accepted and correct"."""
    outcome = F.when((F.col("decision_status") == "accepted") & (F.col("label") == F.col("recommended_mode")), 1.0).otherwise(0.0)
    rows = cases.where(finite("confidence") & F.col("confidence").between(0, 1)).select("confidence", outcome.alias("o"))
    bins = rows.groupBy(bin_number(F.col("confidence"), CONFIDENCE_BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg("o").alias("o"),
        F.sum((F.col("confidence") - F.col("o")) ** 2).alias("sq"),
    )
    n = F.sum("n")
    return bins.agg(
        n.alias("case_count"),
        F.bround(F.sum("sq") / n, 6).alias("brier_score"),
        F.bround(F.sum(F.col("n") * F.abs(F.col("c") - F.col("o"))) / n, 6).alias("expected_calibration_error"),
    )


def analyzer_release_gate(cases: DataFrame) -> DataFrame:
    """Sorted distinct error codes of a labelled release corpus (empty = release_ready).

    Needs label, kind, recommended_mode, decision_status and confidence.
    """
    spark = cases.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, AUTO_MODES))).alias("label")).select(
        "label", F.explode(F.array(*map(F.lit, CASE_KINDS))).alias("kind")
    )
    subject = F.col("case_id").cast("string")
    uncovered = F.broadcast(grid).join(cases.select("label", "kind").distinct(), ["label", "kind"], "left_anti")
    right = F.col("label") == F.col("recommended_mode")
    per_case = cases.select(
        F.explode(
            codes(
                (F.concat(F.lit("case_scope:"), subject), ~(F.col("label").isin(AUTO_MODES) & F.col("kind").isin(CASE_KINDS))),
                (F.concat(F.lit("in_domain_prediction_mismatch:"), subject), (F.col("kind") == "in_domain") & ~right),
                (F.concat(F.lit("boundary_false_accept:"), subject), (F.col("kind") == "boundary") & ~right & (F.col("decision_status") != "needs_review")),
            )
        ).alias("code")
    )
    modes = confusion_matrix(cases).select(
        F.explode(
            codes(
                (F.concat(F.lit("correct_recommendation_coverage:"), "mode"), F.col("correct") < RELEASE_LIMITS["correct"]),
                (F.concat(F.lit("recommendation_precision:"), "mode"), F.coalesce(F.col("precision") < RELEASE_LIMITS["precision"], F.lit(True))),
                (F.concat(F.lit("accepted_precision:"), "mode"), F.col("accepted_precision") < RELEASE_LIMITS["accepted_precision"]),
            )
        ).alias("code")
    )
    error = calibration_error(cases).select(
        F.explode(
            codes(
                ("brier_score", F.coalesce(F.col("brier_score") > RELEASE_LIMITS["brier"], F.lit(True))),
                ("expected_calibration_error", F.coalesce(F.col("expected_calibration_error") > RELEASE_LIMITS["ece"], F.lit(True))),
            )
        ).alias("code")
    )
    wrong = cases.where((F.col("decision_status") == "accepted") & ~right).limit(1).select(F.lit("accepted_wrong_mode").alias("code"))
    cover = uncovered.limit(1).select(F.lit("mode_kind_coverage").alias("code"))
    return per_case.unionByName(modes).unionByName(error).unionByName(wrong).unionByName(cover).distinct()
