"""Text predicates: redaction, sensitive content and vector markup structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.columns import codes

# The published patterns.
PATH_TOKEN = r"(?:[A-Za-z]:)?(?:[\\/][\w.\-~+]+){2,}"
ADDRESS = r"0x[0-9a-fA-F]+"
MESSAGE_LIMIT = 200
SENSITIVE = {
    "posix_path": r"(?<![A-Za-z0-9_.-])/(?:home|tmp|var|Users|private|opt|workspace|runner)(?:/[^\s\"']+)+",
    "windows_path": r"\b[A-Za-z]:[\\/](?:[^\s\"']+[\\/])*[^\s\"']+",
    "secret": r"(?i)(authorization\s*:|bearer\s+[A-Za-z0-9._~+/-]{8,}|github_pat_|ghp_[A-Za-z0-9]{10,}|token[=:\s]+[A-Za-z0-9._~+/-]{8,})",
    "traceback": r"Traceback \(most recent call last\):",
}
DANGEROUS_TAGS = ["script", "foreignobject", "iframe", "object", "embed", "image"]


def redact(column: str, limit: int | None = None) -> Column:
    """Paths and addresses masked; a report caps its messages with ``limit`` (MESSAGE_LIMIT characters)."""
    clean = F.regexp_replace(F.regexp_replace(column, PATH_TOKEN, "<redacted-path>"), ADDRESS, "<addr>")
    return clean if limit is None else F.substring(clean, 1, limit)


def sensitive_scan(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, code) for each pattern found in a string column; whole texts are searched."""
    long = df.select(key, *columns).unpivot([key], columns, "field", "_text")
    return long.select(key, "field", F.explode(codes(*[(k, F.col("_text").rlike(p)) for k, p in SENSITIVE.items()])).alias("code"))


def markup_structure(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Counts and defect codes of vector markup text (well-formedness itself is not checked).

    References count if the gradient they name exists.
    """
    # attributes in single quotes are read like those in double ones; both texts are columns of their own, made once a row
    df = df.select(key, F.regexp_replace(column, r"(\s[\w:.-]+\s*=\s*)'([^'\"<]*)'", r'$1"$2"').alias("_text"))
    df = df.select(key, "_text", F.lower("_text").alias("_low"))
    c, low = F.col("_text"), F.col("_low")
    n = lambda p: F.regexp_count(c, F.lit(p))
    d_attr = r"(?i)<path\b[^>]*?\sd\s*=\s*\"([^\"]*)\""
    node_count = F.aggregate(
        F.regexp_extract_all(c, F.lit(d_attr), F.lit(1)), F.lit(0), lambda acc, d: acc + F.regexp_count(d, F.lit("[MmLlHhVvCcSsQqTtAaZz]"))
    )
    href = r"(?i)\s(?:xlink:)?(?:href|src)\s*=\s*\""
    ids = F.regexp_extract_all(c, F.lit(r"(?i)<(?:linear|radial|mesh)gradient\b[^>]*?\sid\s*=\s*\"([^\"]+)\""), F.lit(1))
    used = F.regexp_extract_all(c, F.lit(r"url\(\s*['\"]?#([^)'\"\s]+)"), F.lit(1))
    raster = low.rlike(r"<image\b") | low.rlike(href + r"\s*data:image")
    external = low.rlike(href + r"\s*(?!data:image)[^#\"\s]") | low.rlike(r"url\(\s*['\"]?\s*[^#'\"\s)]")
    viewbox = F.regexp_extract(c, r"(?i)<svg\b[^>]*?\sviewbox\s*=\s*\"([^\"]*)\"", 1)
    num = r"[-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?"
    positive = r"\+?(?=[0-9.]*[1-9])[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?"
    is_svg = F.coalesce(low.rlike(r"^\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<svg\b"), F.lit(False))
    tags = [(f"forbidden_{t}", low.rlike(rf"<{t}\b")) for t in DANGEROUS_TAGS if t != "image"]
    found = codes(
        ("root_not_svg", ~is_svg),
        ("viewbox_missing", viewbox == ""),
        ("viewbox_invalid", (viewbox != "") & ~viewbox.rlike(rf"(?i)^\s*{num}[\s,]+{num}[\s,]+{positive}[\s,]+{positive}\s*$")),
        ("embedded_raster", raster), *tags,
        ("event_handler", low.rlike(r"<[a-z][^>]*\son[a-z]+\s*=")),
        ("external_reference", external),
        ("unsafe_css", low.rlike(r">[^<]*(?:javascript:|@import|data:)")),
        ("unsafe_uri", low.rlike(r"javascript:|=\s*\"\s*data:")),
        ("nonfinite_geometry", low.rlike(r"\s(?:d|points|transform|viewbox|x|y|x1|y1|x2|y2|cx|cy|r|rx|ry|width|height)\s*=\s*\"[^\"]*\b(?:nan|inf|infinity)\b")),
    )
    return df.select(
        key, n(r"(?i)<path\b").alias("path_count"), node_count.alias("node_count"),
        n(r"(?i)<linearGradient\b").alias("linear_gradient_count"), n(r"(?i)<radialGradient\b").alias("radial_gradient_count"),
        n(r"(?i)<meshGradient\b").alias("mesh_gradient_count"), n(r"(?i)<(?:linear|radial|mesh)Gradient\b").alias("gradient_count"),
        F.size(F.filter(used, lambda u: F.array_contains(ids, u))).alias("gradient_reference_count"), F.array_join(found, ",").alias("codes"),
    )
