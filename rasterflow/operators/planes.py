"""Padded planes of whole images from their pixels: luma, half-size chroma and alpha as rows of bytes, with the facts of each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.functions.integers import clamp255, floor_div
from rasterflow.operators import pixels
from rasterflow.operators.walks import let

#: Side of a macroblock.
BLOCK = 16


def as_bytes(levels: Column) -> Column:
    """An array of levels 0 to 255 as binary."""
    return F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def image_facts(px: DataFrame) -> DataFrame:
    """(image_id, w, h, wp, hp, mbw, mbh, has_alpha, status): visible and padded size, macroblocks; status is ok, or gaps where
    pixels are missing, repeated or null."""
    whole = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull() & F.col("a").isNotNull() & (F.col("x") >= 0) & (F.col("y") >= 0)
    sums = px.groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count_if(whole).alias("good"), F.count("*").alias("n"),
        F.coalesce(F.bool_or(F.col("a") < 255), F.lit(False)).alias("has_alpha"),
    )
    up = lambda c: F.shiftleft(F.shiftright(F.col(c) + BLOCK - 1, 4), 4)
    full = (F.col("good") == F.col("n")) & (F.col("n") == F.col("w") * F.col("h"))
    return sums.select(
        "image_id", "w", "h", up("w").alias("wp"), up("h").alias("hp"), F.shiftright(up("w"), 4).alias("mbw"), F.shiftright(up("h"), 4).alias("mbh"),
        "has_alpha", F.when(full, "ok").otherwise("gaps").alias("status"),
    )


def padded_planes(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, facts) of pixels (image_id, y, x, r, g, b, a): rows (image_id, plane, row, samples), facts as image_facts.

    Planes y, u and v are padded to whole macroblocks: to the right by the last visible sample, below by the last row, for
    chroma by what two copies of the last row of pixels would give. Plane a has the visible size and is there only for images
    that are not opaque. Images with gaps give no rows. All is dealt by image once; a pair of rows is the most that is gathered.
    """
    dealt = px.repartition("image_id")
    facts = image_facts(dealt)
    pair = F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("p")
    pairs = dealt.groupBy("image_id", floor_div(F.col("y"), 2).alias("c")).agg(pair).join(facts.where("status = 'ok'").hint("merge"), "image_id")
    w, last = F.col("w").cast("int"), F.col("c") == F.shiftright(F.col("h") - 1, 1)
    cut = pairs.select("*", last.alias("last"), F.slice("p", F.lit(1), w).alias("top"), F.when(F.size("p") > w, F.slice("p", w + 1, w)).otherwise(F.slice("p", F.lit(1), w)).alias("bottom"))

    def luma(line: str) -> Column:
        levels = F.transform(line, lambda v: pixels.luma(v["r"], v["g"], v["b"]))
        return as_bytes(let(levels, lambda n: F.concat(n, F.array_repeat(F.element_at(n, -1), (F.col("wp") - w).cast("int")))))

    def chroma(upper: str, lower: str, r: int, g: int, b: int) -> Column:
        """Fixed values r, g, b: weights in 16-bit fixed point. The sum of four pixels is halved twice, rounding."""
        part = lambda v: r * v["r"] + g * v["g"] + b * v["b"]

        def level(i: Column) -> Column:
            first = F.least(2 * i, w - 1)
            second = F.least(2 * i + 1, w - 1)
            total = sum((part(F.get(line, at)) for line in (upper, lower) for at in (first, second)), F.lit(0))
            return clamp255(F.shiftright(F.shiftright(total + 2, 2) + F.lit((128 << 16) + 32768), 16))

        columns = F.sequence(F.lit(0), (F.col("wp") / 2).cast("int") - 1)
        seen = F.floor((w - 1) / 2).cast("int")
        return as_bytes(F.transform(columns, lambda i: level(F.least(i, seen))))

    weights = {"u": (-9719, -19081, 28800), "v": (28800, -24116, -4684)}
    lines = cut.select(
        "image_id", "c", "last", "h", "hp", "has_alpha", (F.size("p") > w).alias("two"), luma("top").alias("y0"), luma("bottom").alias("y1"),
        *(chroma("top", "bottom", *k).alias(f"{n}0") for n, k in weights.items()),
        *(F.when(F.col("last"), chroma("bottom", "bottom", *k)).alias(f"{n}1") for n, k in weights.items()),
        *(as_bytes(F.transform(line, lambda v: v["a"])).alias(n) for line, n in (("top", "a0"), ("bottom", "a1"))),
    )
    row = lambda plane, at, data: F.struct(F.lit(plane).alias("plane"), at.cast("long").alias("row"), data.alias("samples"))

    def down(plane: str, first: Column, end: Column) -> Column:
        """The rows of one plane that a pair stands for, padding included."""
        return F.transform(F.sequence(F.lit(0).cast("long"), end - first), lambda k: row(plane, first + k, F.when(k == 0, F.col(f"{plane}0")).otherwise(F.col(f"{plane}1"))))

    half = (F.col("hp") / 2).cast("long") - 1
    colour = [down("y", 2 * F.col("c"), F.when(F.col("last"), F.col("hp") - 1).otherwise(2 * F.col("c") + 1))]
    colour += [down(n, F.col("c"), F.when(F.col("last"), half).otherwise(F.col("c"))) for n in weights]
    clear = F.when(F.col("two"), F.array(row("a", 2 * F.col("c"), F.col("a0")), row("a", 2 * F.col("c") + 1, F.col("a1")))).otherwise(F.array(row("a", 2 * F.col("c"), F.col("a0"))))
    every = F.when(F.col("has_alpha"), F.concat(*colour, clear)).otherwise(F.concat(*colour))
    return lines.select("image_id", F.inline(every)), facts
