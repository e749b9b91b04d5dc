"""Scanline filters of mixed rows: None, Sub and Up in any order, by sums along rows and segmented sums down columns.

A row of None or Sub depends on itself alone, so a chain of Up rows begins anew at each of them: a column's value is the sum,
modulo 256, of its bytes since the last such row. Sums along a row need no shuffle, as a row is one value; chains need one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.operators.expansion import grey_level

NONE, SUB, UP = 0, 1, 2


def unit_rows(scanlines: DataFrame) -> DataFrame:
    """Scanlines (image_id, y, filter, channels, data, ...) with ``units`` in place of data: the bytes of each pixel, or of each
    byte of packed pixels, those of Sub rows summed up along the row, by channel, modulo 256. Null and empty data go."""
    rest = [c for c in scanlines.columns if c != "data"]
    rows = scanlines.where("octet_length(data) > 0").select(*rest, "data")
    filter_at, channels_at = rest.index("filter"), rest.index("channels")

    def run(batches):
        for batch in batches:
            flat, inner, outer = [], [np.zeros(1, np.int64)], [0]
            for kind, n, data in zip(*(batch.column(k).to_pylist() for k in (filter_at, channels_at, len(rest)))):
                line = np.frombuffer(data, np.uint8)
                size = len(line)
                if kind == SUB:
                    line = np.cumsum(np.pad(line, (0, -size % n)).reshape(-1, n), axis=0, dtype=np.uint8).ravel()[:size]
                ends = np.minimum(np.arange(1, -(-size // n) + 1) * n, size)
                flat.append(line.astype(np.int16))
                inner.append(inner[-1][-1] + ends)
                outer.append(outer[-1] + len(ends))
            units = pa.ListArray.from_arrays(pa.array(np.concatenate(inner), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int16), *flat]), pa.int16()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(outer, pa.int32()), units)], names=[*rest, "units"])

    kept = rows.drop("data").schema.simpleString()[len("struct<") : -1]
    return rows.mapInArrow(run, f"{kept},units:array<array<smallint>>")


def chains(rows: DataFrame) -> DataFrame:
    """rows (image_id, y, filter, ...) with ``chain``: how many rows up to this one do not use Up. One short row a scanline is
    sorted here, not its bytes."""
    order = Window.partitionBy("image_id").orderBy("y")
    return rows.select("image_id", "y", F.sum(F.when(F.col("filter") == UP, 0).otherwise(1)).over(order).alias("chain"))


#: Bytes of the largest pixel: four channels of 16 bits.
MOST_BYTES = 8


def unfiltered_units(scanlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, verdicts) of scanlines (image_id, y, filter, channels, data, ...), channels being the bytes of a pixel, 1 where
    pixels are packed.

    units: (image_id, y, u, c, ...), the bytes c of pixel u, and the other columns. verdicts: (image_id, status): ok, or serial
    where a row uses another filter (Average and Paeth need the byte before, reconstructed); such images give no units. Up in
    the first row adds nothing. Null or empty data gives no units; image and row tell scanlines apart.
    """
    known = F.coalesce(F.col("filter").isin(NONE, SUB, UP), F.lit(False))
    verdicts = scanlines.groupBy("image_id").agg(F.bool_and(known).alias("ok")).select("image_id", F.when(F.col("ok"), "ok").otherwise("serial").alias("status"))
    lines = scanlines.join(verdicts.where("status = 'ok'").select("image_id"), "image_id", "left_semi")
    numbered = unit_rows(lines).join(chains(lines), ["image_id", "y"])
    rest = [c for c in numbered.columns if c not in ("image_id", "y", "filter", "channels", "units", "chain")]
    each = numbered.select("image_id", "y", "chain", *rest, F.posexplode("units").alias("u", "c"))
    down = Window.partitionBy("image_id", "u", "chain").orderBy("y")
    sums = F.array(*(F.sum(F.get("c", F.lit(i)).cast("bigint")).over(down).bitwiseAND(F.lit(255)) for i in range(MOST_BYTES)))
    return each.select("image_id", "y", F.col("u").cast("bigint").alias("u"), F.slice(sums, F.lit(1), F.size("c")).alias("c"), *rest), verdicts


def unfiltered(scanlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As unfiltered_units, byte by byte: (image_id, y, k, v)."""
    units, verdicts = unfiltered_units(scanlines.select("image_id", "y", "filter", "channels", "data", F.col("channels").cast("bigint").alias("n")))
    each = units.select("image_id", "y", "u", "n", F.posexplode("c").alias("i", "v"))
    return each.select("image_id", "y", (F.col("u") * F.col("n") + F.col("i")).alias("k"), "v"), verdicts


def samples(units: DataFrame) -> DataFrame:
    """Rows (image_id, y, x, s, fmt) of units whose fmt holds w and depth: the samples s of each pixel, of 1 to 16 bits; places
    beyond the width, in the last byte of packed pixels, are left out."""
    depth, c = F.col("fmt.depth"), F.col("c")
    per = F.greatest(F.floor(8 / depth), F.lit(1)).cast("int")
    packed = F.explode(F.when(depth < 8, F.sequence(F.lit(0), per - 1)).otherwise(F.array(F.lit(0))))
    each = units.withColumn("i", packed).withColumn("x", F.col("u") * per + F.col("i")).where("x < fmt.w")
    wide = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda k: F.get(c, 2 * k) * 256 + F.get(c, 2 * k + 1))
    bits = F.expr("array(shiftright(c[0], CAST(8 - (i + 1) * fmt.depth AS INT)) & (shiftleft(1L, CAST(fmt.depth AS INT)) - 1))")
    s = F.when(depth == 16, F.when(F.size("c") > 1, wide)).when(depth == 8, c).otherwise(bits)
    return each.select("image_id", "y", "x", s.alias("s"), "fmt")


def coloured(sampled: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b, a, status) of samples of all colour types and depths.

    fmt: (w, depth, color_type, key), key being the samples of the clear colour, or null. palette: (image_id, i, r, g, b, a).
    The key is compared before 16 bits become 8, so colours that differ in their low bytes alone stay apart. An index
    outside the palette is a row with status 'error' and null colours.
    """
    kind, depth = F.col("fmt.color_type"), F.col("fmt.depth")
    level = lambda k: grey_level(F.get("s", F.lit(k)), F.when(kind.isin(0, 4), depth).otherwise(F.greatest(depth, F.lit(8))))
    grey = kind.isin(0, 4)
    direct = sampled.where(kind != 3).select(
        "image_id", "y", "x", level(0).alias("r"), F.when(grey, level(0)).otherwise(level(1)).alias("g"), F.when(grey, level(0)).otherwise(level(2)).alias("b"),
        F.when(kind == 4, level(1)).when(kind == 6, level(3)).when(F.col("s") == F.col("fmt.key"), 0).otherwise(255).cast("bigint").alias("a"), F.lit("ok").alias("status"),
    )
    indexed = sampled.where(kind == 3).select("image_id", "y", "x", F.get("s", F.lit(0)).alias("i")).join(palette, ["image_id", "i"], "left")
    return direct.unionByName(indexed.select("image_id", "y", "x", "r", "g", "b", "a", F.when(F.col("r").isNull(), "error").otherwise("ok").alias("status")))
