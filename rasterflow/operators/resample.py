"""Chroma planes back to full size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.functions.integers import floor_div


def doubled(plane: DataFrame, axis: str, across: str) -> DataFrame:
    """(image_id, y, x, s) with twice the places along ``axis``: three parts of a sample and one of its nearer neighbour,
    rounded; at the edge the sample is its own neighbour. Windows run along one row or column."""
    w = Window.partitionBy("image_id", across).orderBy(axis)
    near = plane.withColumn("p", F.coalesce(F.lag("s").over(w), "s")).withColumn("n", F.coalesce(F.lead("s").over(w), "s"))
    mix = lambda o: F.shiftright(3 * F.col("s") + F.col(o) + 2, 2)
    two = F.array(F.struct((F.col(axis) * 2).alias("at"), mix("p").alias("v")), F.struct((F.col(axis) * 2 + 1).alias("at"), mix("n").alias("v")))
    return near.select("image_id", across, F.inline(two)).select("image_id", across, F.col("at").alias(axis), F.col("v").alias("s"))


def upsampled(plane: DataFrame, dims: DataFrame) -> DataFrame:
    """A 4:2:0 plane at the display size (image_id, w, h): doubled along rows, then columns, then cropped."""
    full = doubled(doubled(plane, "x", "y"), "y", "x")
    return full.join(dims, "image_id").where("x < w AND y < h").select("image_id", "y", "x", "s")


def repeated(plane: DataFrame, fx: int, fy: int) -> DataFrame:
    """Nearest neighbour: every sample fx by fy times."""
    step = lambda c, n: F.explode(F.sequence(F.col(c) * n, F.col(c) * n + n - 1))
    rows = plane.select("image_id", "x", "s", step("y", fy).alias("y"))
    return rows.select("image_id", "y", "s", step("x", fx).alias("x2")).select("image_id", "y", F.col("x2").alias("x"), "s")


def chroma_plane(pixels: DataFrame) -> DataFrame:
    """A quarter-size plane of mean green, for tests and queries."""
    return pixels.groupBy("image_id", floor_div(F.col("y"), 2).alias("y"), floor_div(F.col("x"), 2).alias("x")).agg(floor_div(F.sum("g"), 4).alias("s"))
