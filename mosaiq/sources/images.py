"""Raster sources: upload screening, decoding and pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Upload limits and accepted formats.
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
MAX_SIDE = 12000
MAX_PIXELS = 40_000_000
FORMATS = ["PNG", "JPEG", "WEBP"]


def sniff_format(content: str = "content") -> Column:
    """Format by file signature, null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
        .when(head.startswith("47494638"), "GIF").when(head.startswith("424D"), "BMP")
    )


def _big_endian(content: str, start: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("bigint")


def screen_uploads(
    files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS
) -> DataFrame:
    """Adds format, sha256, header size (PNG) and the reject ``reason`` known before decoding."""
    fmt = sniff_format()
    png = F.col("format") == "PNG"
    df = files.withColumn("format", fmt).withColumn("sha256", F.sha2("content", 256))
    df = df.withColumn("head_width", F.when(png, _big_endian("content", 17))).withColumn("head_height", F.when(png, _big_endian("content", 21)))
    w, h = F.col("head_width"), F.col("head_height")
    reason = (
        F.when(F.length("content") > max_bytes, "file_too_large")
        .when(F.length("content") == 0, "corrupt_image")
        .when(~F.coalesce(F.col("format").isin(FORMATS), F.lit(False)), "unsupported_format")
        .when(png & ((w <= 0) | (h <= 0)), "corrupt_image")
        .when((w > max_side) | (h > max_side) | (w * h > max_pixels), "image_too_large")
    )
    return df.withColumn("reason", reason)


def read_images(
    spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rasters of a folder.

    Accepted rows hold decoded BGR(A) bytes; an undecodable file shows width -1
    in the image source and is rejected as corrupt.  Zero-byte files have no row
    in either file source; ``screen_uploads`` rejects empty content in tables.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    screened = screen_uploads(files, max_bytes, max_side, max_pixels).select("path", "length", "format", "sha256", "reason")
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    same_name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    j = screened.withColumn("_k", same_name("path")).join(decoded.withColumn("_k", same_name("origin")), "_k", "left").drop("_k")
    w, h = F.col("width"), F.col("height")
    reason = F.coalesce(
        F.col("reason"), F.when(w.isNull() | (w <= 0) | (h <= 0), "corrupt_image"),
        F.when((w > max_side) | (h > max_side) | (w.cast("bigint") * h > max_pixels), "image_too_large"),
    )
    j = j.withColumn("reason", reason)
    ok = j.where("reason is null").select(
        F.col("path").alias("image_id"), "sha256", "width", "height", "format",
        (F.col("nChannels") == 4).alias("has_alpha"), "nChannels", "data",
    )
    return ok, j.where("reason is not null").select("path", "length", "sha256", "reason")


def explode_pixels(images: DataFrame, band: int = 64) -> DataFrame:
    """images(image_id, width, height, nChannels, data) -> one row per pixel, with the size of its image.

    Rows of an image are cut first and spread by (image, row band), so one large
    image is exploded by many tasks.
    """
    stride = F.col("width") * F.col("nChannels")
    rows = images.select(
        "image_id", "width", "height", "nChannels", "data", stride.alias("_stride"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    ).select("image_id", "width", "height", "nChannels", "y", F.substring(F.col("data"), F.col("y") * F.col("_stride") + 1, F.col("_stride")).alias("row"))
    rows = rows.repartition("image_id", F.floor(F.col("y") / band))
    # cutting bytes takes constant time, and only the cut pixels leave the scanline
    pixel = lambda x: F.struct(x.alias("x"), F.substring(F.col("row"), x * F.col("nChannels") + 1, F.col("nChannels")).alias("p"))
    px = rows.select("image_id", "width", "height", "y", "nChannels", F.explode(F.transform(F.sequence(F.lit(0), F.col("width") - 1), pixel)).alias("s"))
    px = px.select("image_id", "width", "height", "y", "nChannels", "s.x", F.hex("s.p").alias("hex"))

    def channel(i: int) -> Column:
        return F.conv(F.substring("hex", 2 * i + 1, 2), 16, 10).cast("int")

    color = F.col("nChannels") >= 3
    return px.select(
        "image_id", "x", "y",
        F.when(color, channel(2)).otherwise(channel(0)).alias("r"), F.when(color, channel(1)).otherwise(channel(0)).alias("g"),
        channel(0).alias("b"), F.when(F.col("nChannels") == 4, channel(3)).otherwise(F.lit(255)).alias("a"), "width", "height",
    )
