"""Corpus intake: record validation, duplicates, coverage, output integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaiq.functions.columns import codes, is_digest

# The intake policy.
LICENSES = ["owned-original", "user-consented-private", "customer-consented-private", "cc0", "public-domain"]
SOURCE_FORMATS = ["png", "jpeg", "webp", "tiff"]
MAX_PIXELS, MAX_FILE_BYTES = 8294400, 26214400
SPLIT_TARGETS = {"calibration": 72, "qualification": 24, "holdout": 24}
CATEGORY_TARGETS = {
    "flat_logo": 15, "badge_seal": 12, "small_text": 15, "monoline": 12, "multicolor": 12,
    "low_resolution_signage_photo": 15, "gradient_artwork": 10, "native_4k": 8,
    "transparent_dark_background": 10, "complex_illustration": 11,
}
OUTPUT_FORMATS = ["svg", "pdf", "eps", "dxf", "png"]
INSPECTED = ["case_id", "category", "source_sha256", "source_format", "width", "height", "file_bytes"]


def validate_records(records: DataFrame, categories: list[str] = tuple(CATEGORY_TARGETS), object_prefix: str = "objects/") -> DataFrame:
    """Records with the array of broken rules (empty = valid).

    ``inspection`` (a struct of the INSPECTED fields), ``privacy_review`` and
    ``storage_object_id`` are checked when present.
    """
    cols = records.columns
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    rules = [
        ("invalid_case_id", no(F.col("case_id").cast("string").rlike("^[a-z0-9][a-z0-9-]{2,63}$"))),
        ("unknown_category", no(F.col("category").isin(list(categories)))),
        ("wrong_split", no(F.col("split").isin(list(SPLIT_TARGETS)))),
        ("invalid_source_sha256", ~is_digest("source_sha256")),
        ("unreviewed_license", no(F.col("license").isin(LICENSES))),
        ("unsupported_source_format", no(F.col("source_format").isin(SOURCE_FORMATS))),
        ("invalid_dimensions", no((F.col("width") > 0) & (F.col("height") > 0))),
        ("pixel_budget_exceeded", F.col("width").cast("bigint") * F.col("height") > MAX_PIXELS),
        ("file_budget_exceeded", no((F.col("file_bytes") > 0) & (F.col("file_bytes") <= MAX_FILE_BYTES))),
        ("privacy_gate_failed", no(~F.col("contains_public_pii"))),
    ]
    if "privacy_review" in cols:
        rules.append(("privacy_review_missing", no(F.col("privacy_review") == "approved")))
    if "storage_object_id" in cols:
        sid = F.col("storage_object_id")
        rules.append(("invalid_storage_object", no(sid.startswith(object_prefix) & ~sid.contains("://"))))
    if "inspection" in cols:
        same = F.lit(True)
        for f in INSPECTED:
            same = same & F.col(f"inspection.{f}").eqNullSafe(F.col(f))
        rules.append(("inspection_mismatch", ~same))
    return records.withColumn("codes", codes(*rules))


def reject_duplicates(new: DataFrame, existing: DataFrame, keys: list[str], id_col: str = "case_id") -> DataFrame:
    """(id, code) for each key of a new record already used by an existing one."""
    old = existing.select(*[F.col(k).cast("string").alias(k) for k in keys]).unpivot([], keys, "key", "value")
    mine = new.select(
        F.col(id_col).alias("_id"), *[F.col(k).cast("string").alias(k) for k in keys]
    ).unpivot(["_id"], keys, "key", "value")
    hit = mine.join(old.distinct(), ["key", "value"], "left_semi")
    return hit.select(F.col("_id").alias(id_col), F.concat(F.lit("duplicate_"), "key").alias("code"))


def coverage(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts against ``targets(split, category, target)`` with split and overall subtotals.

    Targets are a policy table; cells without records appear with zero.
    """
    counts = records.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"))
    cells = targets.join(counts, ["split", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cells.rollup("split", "category").agg(
        F.sum("n").alias("records"), F.sum("target").cast("bigint").alias("target"),
        F.count_if(F.col("n") == 0).alias("empty_cells"), F.bool_and(F.col("n") >= F.col("target")).alias("complete"),
    )


def artifact_integrity(outputs: DataFrame, jobs: DataFrame, formats: list[str] = OUTPUT_FORMATS) -> DataFrame:
    """Codes per (job, expected format): missing, empty, digest mismatch, unsafe.

    ``outputs(job_id, format, byte_size, sha256, expected_sha256, structural_safe)``.
    """
    grid = jobs.select("job_id").distinct().select("job_id", F.explode(F.array(*map(F.lit, formats))).alias("format"))
    got = grid.join(outputs, ["job_id", "format"], "left")
    present = F.col("byte_size").isNotNull()
    return got.select(
        "job_id", "format",
        codes(
            ("artifact_missing", ~present),
            ("artifact_empty", F.col("byte_size") == 0),
            ("digest_mismatch", present & ~F.col("sha256").eqNullSafe(F.col("expected_sha256"))),
            ("not_structurally_safe", present & ~F.coalesce(F.col("structural_safe"), F.lit(False))),
        ).alias("codes"),
    )


def downloadable_formats(integrity: DataFrame) -> DataFrame:
    """Sorted list of clean formats per job (at most one entry per expected format)."""
    return integrity.where(F.size("codes") == 0).groupBy("job_id").agg(
        F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats")
    )
