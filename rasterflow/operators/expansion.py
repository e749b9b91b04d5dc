"""From stored samples to pixels: depths, palettes, runs, scanline filters, row order, decorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors that spread grey samples of 1, 2, 4 and 8 bits over 0..255.
GREY_FACTORS = {1: 255, 2: 85, 4: 17, 8: 1}


def grey_level(sample: Column, depth: Column) -> Column:
    """A grey sample of 1, 2, 4, 8 or 16 bits as 0..255; the high byte of 16 bits; null for other depths."""
    out = F.when(depth == 16, F.shiftright(sample, 8))
    for bits, k in GREY_FACTORS.items():
        out = out.when(depth == bits, sample * k)
    return out


def palette_checked(indexed: DataFrame, palette: DataFrame, transparency: DataFrame) -> DataFrame:
    """(image_id, y, x, i) with colours of palette (i, r, g, b), alpha of transparency (i, a), 255 where it has none, and a
    status: an index outside the palette is a row with status 'error' and null colours."""
    out = indexed.join(palette, "i", "left").join(transparency, "i", "left")
    inside = F.col("r").isNotNull()
    return out.select("image_id", "y", "x", "i", "r", "g", "b", F.when(inside, F.coalesce("a", F.lit(255))).alias("a"), F.when(inside, "ok").otherwise("error").alias("status"))


def keyed_alpha(matches: Column) -> Column:
    """Alpha of a colour key: 0 for pixels of the key's colour."""
    return F.when(matches, 0).otherwise(255)


def opacity(pixels: DataFrame, clear_below: int = 128) -> DataFrame:
    """Per image: whether every pixel is opaque, and how many are clearer than ``clear_below``."""
    return pixels.groupBy("image_id").agg(F.bool_and(F.col("a") == 255).alias("opaque"), F.count_if(F.col("a") < clear_below).alias("n_clear"))


def runs_expanded(runs: DataFrame, width: Column) -> DataFrame:
    """Pixels (line, x, level) of runs (line, at, length, level); what lies beyond ``width`` is ignored."""
    inside = runs.withColumn("_n", F.least(F.col("length"), width - F.col("at"))).where("_n > 0")
    return inside.select("line", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("_n") - 1)).alias("x"), "level")


def undo_sub(rows: DataFrame, channels: int) -> DataFrame:
    """Bytes (image_id, y, k, v) of scanlines that all use the Sub filter: running sums of each channel modulo 256."""
    w = Window.partitionBy("image_id", "y", F.col("k") % channels).orderBy("k")
    return rows.select("image_id", "y", "k", F.sum("v").over(w).bitwiseAND(F.lit(255)).alias("v"))


def undo_up(rows: DataFrame) -> DataFrame:
    """As undo_sub for the Up filter, down the columns."""
    w = Window.partitionBy("image_id", "k").orderBy("y")
    return rows.select("image_id", "y", "k", F.sum("v").over(w).bitwiseAND(F.lit(255)).alias("v"))


def undo_vertical(residuals: DataFrame) -> DataFrame:
    """Alpha from vertical residuals (image_id, y, x, vertical): along the first row, then down the columns, modulo 256."""
    row, col = Window.partitionBy("image_id").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    first = residuals.where("y = 0").select("image_id", "x", (F.sum("vertical").over(row) - F.col("vertical")).alias("base"))
    return residuals.join(first, ["image_id", "x"]).select("image_id", "y", "x", (F.col("base") + F.sum("vertical").over(col)).bitwiseAND(F.lit(255)).alias("a"))


def display_row(y: Column, height: Column) -> Column:
    """The row that a stored row shows: files with a positive height are stored bottom up."""
    return F.when(height < 0, y).otherwise(height - 1 - y)


def less_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Red and blue without green, modulo 256."""
    return (r - g).bitwiseAND(F.lit(255)), (b - g).bitwiseAND(F.lit(255))


#: Filters that are tried, in order; horizontal only up to so many pixels.
TRIED_FILTERS = {"none": 0, "gradient": 1, "horizontal": 2}
THOROUGH_PIXELS = 2_000_000


def chosen_filter(candidates: DataFrame) -> DataFrame:
    """The filter of least length of each image from rows (image_id, pixels, filter, length); of equal ones the first tried."""
    order = candidates.sparkSession.createDataFrame(list(TRIED_FILTERS.items()), "filter string, place int")
    tried = candidates.join(F.broadcast(order), "filter").where((F.col("filter") != "horizontal") | (F.col("pixels") <= THOROUGH_PIXELS))
    best = tried.groupBy("image_id").agg(F.min_by(F.struct("filter", "length"), F.struct("length", "place")).alias("b"))
    return best.select("image_id", "b.filter", "b.length")


def scanline_pixels(rows: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b, a) of 8-bit scanline samples (image_id, color_type, y, samples): grey, RGB, grey with
    alpha or RGB with alpha; other colour types give no pixels. 255 where there is no alpha."""
    channels = F.when(F.col("color_type") == 0, 1).when(F.col("color_type") == 2, 3).when(F.col("color_type") == 4, 2).when(F.col("color_type") == 6, 4)
    sized = rows.withColumn("c", channels).withColumn("n", F.floor(F.size("samples") / F.col("c")).cast("int")).where("n > 0")
    each = sized.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda k: F.get("samples", F.col("x") * F.col("c") + k)
    colour = F.col("c") >= 3
    alpha = F.when(F.col("c").isin(2, 4), at(F.col("c") - 1)).otherwise(F.lit(255))
    return each.select(
        "image_id", "y", F.col("x").cast("bigint").alias("x"), at(F.lit(0)).alias("r"), F.when(colour, at(F.lit(1))).otherwise(at(F.lit(0))).alias("g"),
        F.when(colour, at(F.lit(2))).otherwise(at(F.lit(0))).alias("b"), alpha.alias("a"),
    )


def clipped(levels: DataFrame, dims: DataFrame, size: int = 8) -> DataFrame:
    """Samples (image_id, y, x, s) of block levels (image_id, by, bx, y, x, level) inside the display size (image_id, w, h)."""
    placed = levels.select("image_id", (F.col("by") * size + F.col("y")).alias("y"), (F.col("bx") * size + F.col("x")).alias("x"), F.col("level").alias("s"))
    return placed.join(dims, "image_id").where("x < w AND y < h").select("image_id", "y", "x", "s")


def plane_rows(plane: DataFrame, name: str) -> DataFrame:
    """Rows (image_id, plane, row, samples) of a plane (image_id, y, x, s), a byte a sample; one row of one image at a time."""
    lists = plane.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "s"))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda v: F.lpad(F.hex(v["s"]), 2, "0")), ""))
    return lists.select("image_id", F.lit(name).alias("plane"), F.col("y").alias("row"), data.alias("samples"))


#: Names of the alpha filters by their code.
FILTER_NAMES = ("none", "horizontal", "vertical", "gradient")


def filter_name(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, FILTER_NAMES)), code.cast("int"))


def geometry_status(width: Column, height: Column, expected_width: Column, expected_height: Column, most: int = 16383) -> Column:
    """ok, bad_size (outside 1 to ``most``), or unexpected where a size was named and differs."""
    legal = width.between(1, most) & height.between(1, most)
    differs = (F.coalesce(expected_width, width) != width) | (F.coalesce(expected_height, height) != height)
    return F.when(~F.coalesce(legal, F.lit(False)), "bad_size").when(differs, "unexpected").otherwise("ok")
