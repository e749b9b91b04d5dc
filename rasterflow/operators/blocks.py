"""Macroblocks and quantisers as relations: tiling, mode scores on source pixels, tables as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterflow.functions.integers import clamp255, floor_div

#: Fixed values (RFC 6386): quantiser steps by index, for DC and AC.
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34,
    35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67, 68,
    69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110,
    112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41,
    42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78, 80, 82, 84, 86, 88, 90, 92, 94, 96,
    98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152, 155, 158, 161, 164, 167, 170, 173,
    177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
#: Fixed values (a calibration of quality to quantiser index, not part of the format): the knots between which is interpolated.
KNOTS = (
    (0, 127), (5, 86), (10, 75), (15, 68), (20, 62), (25, 57), (30, 52), (35, 48), (40, 45), (45, 41), (50, 38),
    (55, 36), (60, 33), (65, 30), (70, 28), (75, 26), (80, 19), (85, 14), (90, 9), (95, 4), (98, 1), (100, 0),
)


def knots() -> list[tuple[int, int]]:
    return list(KNOTS)


def steps() -> list[tuple[int, int, int]]:
    return [(i, d, a) for i, (d, a) in enumerate(zip(DC_STEPS, AC_STEPS))]


def quality_index(qualities: DataFrame, quality: str = "quality") -> DataFrame:
    """qualities with q_index: a range join to the 22 knots, linear in between, rounded half up; clamped to 0..100."""
    spark: SparkSession = qualities.sparkSession
    ends = spark.createDataFrame([(a, b, x, y) for (a, x), (b, y) in zip([(-1, 127), *knots()], knots())], "lo int, hi int, from_i int, to_i int")
    q = F.least(F.greatest(F.col(quality), F.lit(0)), F.lit(100))
    out = qualities.join(F.broadcast(ends), (q > F.col("lo")) & (q <= F.col("hi")))
    at = F.when(q == F.col("hi"), F.col("to_i")).otherwise(F.col("from_i") + (q - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("to_i") - F.col("from_i")))
    return out.withColumn("q_index", F.round(at).cast("int")).drop("lo", "hi", "from_i", "to_i")


def quantiser_steps(indexed: DataFrame, deltas: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Rows with q_index joined to the steps of all planes, 128 rows of them. deltas: added to the index for luma DC, chroma DC
    and chroma AC, inside 0..127."""
    at = lambda table, i: table[min(max(i, 0), 127)]
    y_dc, uv_dc, uv_ac = deltas
    rows = [
        (i, at(DC_STEPS, i + y_dc), ac, 2 * DC_STEPS[i], max(8, ac * 155 // 100), min(at(DC_STEPS, i + uv_dc), 132), at(AC_STEPS, i + uv_ac)) for i, ac in enumerate(AC_STEPS)
    ]
    names = "q_index int, y_dc int, y_ac int, y2_dc int, y2_ac int, uv_dc int, uv_ac int"
    table = F.broadcast(indexed.sparkSession.createDataFrame(rows, names))
    return indexed.join(table, "q_index").select(*indexed.columns, "y_dc", "y_ac", "y2_dc", "y2_ac", "uv_dc", "uv_ac")


def quantised(coefficient: Column, step: Column, bias: float = 0.65) -> Column:
    """Dead-zone quantiser: the magnitude plus step less floor(bias * step), over step, cut; the sign returns."""
    size = F.floor((F.abs(coefficient) + step - F.floor(step * F.lit(bias))) / step).cast("bigint")
    return F.when(coefficient < 0, -size).otherwise(size)


def macroblock_stats(pixels: DataFrame, sample: str = "r", size: int = 16) -> DataFrame:
    """Count, sum, extremes and squared sum of every size x size block; partial sums form before the shuffle."""
    s = F.col(sample)
    return pixels.groupBy("image_id", floor_div(F.col("y"), size).alias("mby"), floor_div(F.col("x"), size).alias("mbx")).agg(
        F.count("*").alias("n"), F.sum(s).alias("total"), F.min(s).alias("low"), F.max(s).alias("high"), F.sum(s * s).alias("squares")
    )


def mode_scores(pixels: DataFrame, sample: str = "r", size: int = 16) -> DataFrame:
    """Absolute error of each whole-block predictor on source pixels: (image_id, mby, mbx, mode, sad).

    Modes: 0 the mean of the edges inside the image, rounded half up, or 128 without any; 1 vertical, 2 horizontal, 3 true
    motion (left + above - corner, clamped). For modes 1 to 3 the row above is 127 outside the image and the column to the
    left 129. Edges are looked up with three equi-joins on the block, their means with a fourth.
    """
    px = pixels.select("image_id", "y", "x", F.col(sample).alias("s"), floor_div(F.col("y"), size).alias("mby"), floor_div(F.col("x"), size).alias("mbx"))
    last_row = px.where(f"y % {size} = {size - 1}").select("image_id", (F.col("mby") + 1).alias("mby"), "x", F.col("s").alias("above"))
    last_col = px.where(f"x % {size} = {size - 1}").select("image_id", (F.col("mbx") + 1).alias("mbx"), "y", F.col("s").alias("left"))
    corner = px.where(f"x % {size} = {size - 1} AND y % {size} = {size - 1}").select("image_id", (F.col("mby") + 1).alias("mby"), (F.col("mbx") + 1).alias("mbx"), F.col("s").alias("corner"))
    edges = px.where(f"y % {size} = {size - 1}").select("image_id", (F.col("mby") + 1).alias("mby"), "mbx", "s").unionByName(
        px.where(f"x % {size} = {size - 1}").select("image_id", "mby", (F.col("mbx") + 1).alias("mbx"), "s")
    )
    mean = edges.groupBy("image_id", "mby", "mbx").agg(F.expr("(2 * sum(s) + count(s)) div (2 * count(s))").alias("mean"))
    near = px.join(last_row, ["image_id", "mby", "x"], "left").join(last_col, ["image_id", "mbx", "y"], "left").join(corner, ["image_id", "mby", "mbx"], "left")
    near = near.join(mean, ["image_id", "mby", "mbx"], "left")
    a, l = F.coalesce("above", F.lit(127)), F.coalesce("left", F.lit(129))
    p = F.coalesce("corner", F.when(F.col("mby") == 0, F.lit(127)).otherwise(F.lit(129)))
    errors = [F.sum(F.abs(F.col("s") - c)).alias(f"m{k}") for k, c in ((0, F.coalesce("mean", F.lit(128))), (1, a), (2, l), (3, clamp255(a + l - p)))]
    sums = near.groupBy("image_id", "mby", "mbx").agg(*errors)
    return sums.select("image_id", "mby", "mbx", F.expr("stack(4, 0, m0, 1, m1, 2, m2, 3, m3) AS (mode, sad)"))


def best_mode(scores: DataFrame) -> DataFrame:
    """The mode of least error; of equal ones the first."""
    return scores.groupBy("image_id", "mby", "mbx").agg(F.min(F.struct("sad", "mode")).alias("m")).select("image_id", "mby", "mbx", "m.mode", "m.sad")


def pruned_modes(scores: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` modes of least error of each block."""
    w = Window.partitionBy("image_id", "mby", "mbx").orderBy("sad", "mode")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
