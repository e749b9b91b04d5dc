"""Rasters as relations (image_id, y, x, r, g, b, a) and set-oriented pixel operators.

Nothing here gathers an image: rows are shuffled by image row or column only where a window needs neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.functions.integers import clamp255, floor_div

#: Rows of one derived image.
ROWS = 16


def embedding_pixels(embeddings: DataFrame) -> DataFrame:
    """64-wide images of 16 embeddings each: component v becomes floor((v + 1) * 127.5); green, blue and alpha are the row
    turned by 21, 42 and 13 places. Rows without an embedding give no pixels."""
    level = lambda v: (F.floor((v.cast("double") + 1) * F.lit(127.5))).cast("bigint")
    n = F.size("embedding")
    at = lambda k: level(F.get("embedding", (F.col("x") + k) % n))
    wide = embeddings.where(F.size("embedding") > 0).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), n - 1)).alias("x"))
    return wide.select(
        floor_div(F.col("vec_id"), ROWS).alias("image_id"), (F.col("vec_id") % ROWS).alias("y"), F.col("x").cast("bigint").alias("x"),
        at(0).alias("r"), at(21).alias("g"), at(42).alias("b"), at(13).alias("a"),
    )


def luma(r: Column, g: Column, b: Column) -> Column:
    """Studio-range luma of 8-bit RGB in 16-bit fixed point, rounded."""
    return F.shiftright(16839 * r + 33059 * g + 6420 * b + F.lit((16 << 16) + 32768), 16)


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def chroma(pixels: DataFrame) -> DataFrame:
    """U and V at half size, from sums of 2x2 pixels; the last row or column of an odd size counts twice."""
    sized = pixels.join(sizes(pixels), "image_id")
    times = F.when((F.col("x") == F.col("w") - 1) & (F.col("w") % 2 == 1), 2).otherwise(1) * F.when((F.col("y") == F.col("h") - 1) & (F.col("h") % 2 == 1), 2).otherwise(1)
    u, v = (-9719 * F.col("r") - 19081 * F.col("g") + 28800 * F.col("b"), 28800 * F.col("r") - 24116 * F.col("g") - 4684 * F.col("b"))
    sums = sized.groupBy("image_id", floor_div(F.col("y"), 2).alias("cy"), floor_div(F.col("x"), 2).alias("cx")).agg(F.sum(u * times).alias("u"), F.sum(v * times).alias("v"))
    level = lambda c: clamp255(F.shiftright(F.shiftright(F.col(c) + 2, 2) + F.lit((128 << 16) + 32768), 16))
    return sums.select("image_id", "cy", "cx", level("u").alias("u"), level("v").alias("v"))


def padded(plane: DataFrame, to: int = 16) -> DataFrame:
    """(image_id, y, x, s) grown to multiples of ``to`` by its last row and column: each edge pixel is exploded to the places it fills."""
    sized = plane.join(sizes(plane), "image_id")
    places = lambda c, n: F.when(F.col(c) == F.col(n) - 1, F.sequence(F.col(c), F.ceil(F.col(n) / to).cast("bigint") * to - 1)).otherwise(F.array(c))
    rows = sized.select("image_id", "x", "s", "w", F.explode(places("y", "h")).alias("y2"))
    return rows.select("image_id", "y2", "s", F.explode(places("x", "w")).alias("x2")).select("image_id", F.col("y2").alias("y"), F.col("x2").alias("x"), "s")


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    cb, cr = cb - 128, cr - 128
    return (
        clamp255(y + F.shiftright(91881 * cr, 16)),
        clamp255(y - F.shiftright(22554 * cb + 46802 * cr, 16)),
        clamp255(y + F.shiftright(116130 * cb, 16)),
    )


def masked_channel(sample: Column, shift: int, most: int) -> Column:
    """A bit field scaled to 0..255, to nearest."""
    return F.expr("0") if most == 0 else F.floor((F.shiftright(sample, shift).bitwiseAND(F.lit(most)) * 255 + (most >> 1)) / most).cast("bigint")


def unpacked(pixels: DataFrame, sample: str, bits: int) -> DataFrame:
    """Samples of ``bits`` bits packed in bytes, most significant first: x grows 8 / bits times."""
    per = 8 // bits
    k = F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k")
    value = F.expr(f"shiftright({sample}, cast({8 - bits} - k * {bits} as int)) & {2**bits - 1}")
    return pixels.select("image_id", "y", "x", sample, k).select("image_id", "y", (F.col("x") * per + F.col("k")).alias("x"), value.alias("v"))


def palette_resolved(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, i) with the colours of palette (i, r, g, b); an index outside it is black."""
    out = indexed.join(palette, "i", "left")
    return out.select("image_id", "y", "x", "i", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("r", "g", "b")))


#: The seven passes of PNG interlacing: first x, first y, step x, step y.
INTERLACE = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def interlace_pass(x: Column, y: Column) -> Column:
    """The pass (1 to 7) that a pixel belongs to."""
    out = F.lit(None).cast("int")
    for k, (xs, ys, dx, dy) in reversed(list(enumerate(INTERLACE, 1))):
        out = F.when((x % dx == xs) & (y % dy == ys), F.lit(k)).otherwise(out)
    return out


def alpha_residuals(pixels: DataFrame) -> DataFrame:
    """Residuals of the three alpha predictors: left, above, and clipped left + above - corner; the first row and column use
    the neighbour they have, the first pixel none."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    near = pixels.withColumn("l", F.lag("a").over(row)).withColumn("t", F.lag("a").over(col)).withColumn("tl", F.lag("l").over(col))
    edge = lambda inner: F.coalesce(inner, F.col("t"), F.col("l"), F.lit(0))
    res = lambda p: (F.col("a") - p).bitwiseAND(F.lit(255))
    horizontal = F.coalesce("l", "t", F.lit(0))
    vertical = F.coalesce("t", "l", F.lit(0))
    # least() and greatest() pass nulls over, so the missing corner is tested first
    gradient = edge(F.when(F.col("tl").isNotNull(), clamp255(F.col("l") + F.col("t") - F.col("tl"))))
    return near.select("image_id", "y", "x", res(horizontal).alias("horizontal"), res(vertical).alias("vertical"), res(gradient).alias("gradient"))


def undo_horizontal(residuals: DataFrame) -> DataFrame:
    """Alpha from horizontal residuals (image_id, y, x, horizontal): sums modulo 256 along the first column, then along rows."""
    col, row = Window.partitionBy("image_id").orderBy("y"), Window.partitionBy("image_id", "y").orderBy("x")
    first = residuals.where("x = 0").withColumn("base", F.sum("horizontal").over(col) - F.col("horizontal")).select("image_id", "y", "base")
    return residuals.join(first, ["image_id", "y"]).select("image_id", "y", "x", (F.col("base") + F.sum("horizontal").over(row)).bitwiseAND(F.lit(255)).alias("a"))


def psnr(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Per image: n, squared error, and 10 log10 (255^2 n / error) to six places; null error gives infinity."""
    e = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    out = pairs.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(e).alias("sse"))
    return out.withColumn("psnr", F.when(F.col("sse") == 0, F.lit(float("inf"))).otherwise(F.round(10 * F.log10(F.lit(65025.0) * F.col("n") / F.col("sse")), 6)))
