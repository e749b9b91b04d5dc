"""Image files as DataFrames: heads, raw RGB, and decoded pixels by Spark's own image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.operators.heads import file_heads
from rasterflow.operators.walks import let


def heads(spark: SparkSession, path: str, pattern: str = "*", alpha_policy: str = "keep") -> DataFrame:
    """(path, length, head, ...), as ``file_heads``: one row per file, unreadable ones with status 'error'. Spark's file source
    passes empty files over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return file_heads(files.select("path", "content"), alpha_policy)


def raw_rgb(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Headerless 8-bit RGB: (path, status, content); a file of another length is a row with status 'error'."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") == width * height * 3
    return files.select("path", F.when(fits, "ok").otherwise("error").alias("status"), F.when(fits, F.col("content")).alias("content"))


def raw_alpha(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """As raw_rgb, for one alpha byte a pixel."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") == width * height
    return files.select("path", F.when(fits, "ok").otherwise("error").alias("status"), F.when(fits, F.col("content")).alias("content"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data): pixels of PNG, JPEG and BMP files, rows from the top, channels as BGR(A) or
    grey; files that cannot be decoded have width -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select(
        F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data"
    )


def pixels(images: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b, a) of decoded images, from the bytes in place; alpha 255 where there is none. Images are cut into
    rows, then rows into pixels, so that a pixel costs no copy of its image."""
    c = F.col("channels")
    stride = F.col("width") * c
    cut = lambda d: F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring(d, y * stride + 1, stride))
    rows = images.where("width > 0").select("path", "width", "channels", F.posexplode(let(F.col("data"), cut)).alias("y", "row"))
    at = lambda d, x, k: F.conv(F.hex(F.substring(d, x * c + k + 1, F.lit(1))), 16, 10).cast("bigint")
    pixel = lambda d, x: F.struct(
        x.cast("bigint").alias("x"), F.when(c >= 3, at(d, x, 2)).otherwise(at(d, x, 0)).alias("r"), F.when(c >= 3, at(d, x, 1)).otherwise(at(d, x, 0)).alias("g"), at(d, x, 0).alias("b"),
        F.when(c == 4, at(d, x, 3)).otherwise(F.lit(255)).alias("a"),
    )
    line = lambda d: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: pixel(d, x))
    return rows.select("path", F.col("y").cast("bigint").alias("y"), F.inline(let(F.col("row"), line)))


def stage_planes(planes: DataFrame, path: str) -> None:
    """Planes (image_id, plane, row, samples) as Parquet by plane, rows in order, so that bands prune."""
    planes.repartitionByRange("image_id", "row").sortWithinPartitions("image_id", "plane", "row").write.partitionBy("plane").parquet(path)


def band(spark: SparkSession, path: str, first: int, rows: int) -> DataFrame:
    """Rows first .. first + rows - 1 of all staged planes; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("row").between(first, first + rows - 1))
