"""Images of mixed types, each by the reader that fits: whole tables of pixels with a status and the reader's name.

PNG files whose rows use None, Sub and Up are read here, at all depths and colour types: chunks by the recursive walk,
rows inflated in Arrow batches, filters undone by sums over all images at once. BMP files of all depths, masks and run
lengths are read by ``bitmaps``. What is left - other filters, interlaced files and JPEG - goes to Spark's image source, and
WebP is skipped.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions.integers import be_uint
from rasterflow.operators.expansion import geometry_status
from rasterflow.operators.heads import file_heads
from rasterflow.operators.metadata import PNG_DEPTHS
from rasterflow.operators.scanlines import coloured, samples, unfiltered_units
from rasterflow.operators.walks import file_facts, segments, walked
from rasterflow.plans.staging import kept
from rasterflow.sources.bitmaps import bmp_pixels
from rasterflow.sources.files import decoded, pixels

#: Channels of the colour types.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Greatest side, most pixels and most compressed bytes of a PNG.
PNG_SIDE, PNG_PIXELS, PNG_BYTES = 16384, 40_000_000, 1 << 27
LINES = "image_id string, y long, filter int, channels int, data binary, fmt struct<w:bigint,depth:bigint,color_type:bigint,key:array<bigint>>, problem string"


def _inflated(batches):
    """Scanlines of each file, or one row with a problem. The inflated size is known beforehand, and no more is asked for."""
    for batch in batches:
        for path, w, h, depth, kind, key, data in zip(*(batch.column(k).to_pylist() for k in range(7))):
            bits = CHANNELS[kind] * depth
            row = (w * bits + 7) // 8
            inflate = zlib.decompressobj()
            try:
                raw = inflate.decompress(b"".join(data), (row + 1) * h + 1)
            except zlib.error:
                raw = b""
            good = len(raw) == (row + 1) * h and inflate.eof
            places = range(h) if good else range(1)
            fmt = {"w": w, "depth": depth, "color_type": kind, "key": key}
            for first in range(0, len(places), 1024):
                lines = [raw[y * (row + 1) : (y + 1) * (row + 1)] if good else b"" for y in places[first : first + 1024]]
                n = len(lines)
                columns = [[path] * n, list(places[first : first + 1024]), [x[0] if x else None for x in lines], [max(1, bits // 8)] * n, [x[1:] for x in lines], [fmt] * n, [None if good else "bad_data"] * n]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.struct([("w", pa.int64()), ("depth", pa.int64()), ("color_type", pa.int64()), ("key", pa.list_(pa.int64()))]), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["image_id", "y", "filter", "channels", "data", "fmt", "problem"])


def png_scanlines(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, palettes, verdicts) of PNG files (path, content).

    lines: as ``unfiltered_units`` takes them; palettes: (image_id, i, r, g, b, a); verdicts: (image_id, status): ok, the
    walk's status, bad_format (a colour type, depth or method that the format lacks, or a colour-mapped file without a
    palette), bad_size, bad_data (does not inflate to the rows' size), interlaced.
    """
    walk = kept(walked(files, ("png_data",)))
    facts = file_facts(walk, "path", ("IHDR", "PLTE", "tRNS"))
    ihdr = lambda at, n: be_uint(F.col("IHDR"), at, n)
    named = facts.select(
        F.col("path").alias("image_id"), "status", ihdr(0, 4).alias("w"), ihdr(4, 4).alias("h"), ihdr(8, 1).alias("depth"), ihdr(9, 1).alias("color_type"), (ihdr(10, 1) + ihdr(11, 1)).alias("method"), ihdr(12, 1).alias("interlaced"),
        F.coalesce("PLTE", F.lit(b"")).alias("plte"), F.col("tRNS").alias("clear"),
    )
    legal = F.lit(False)
    for kind, depths in PNG_DEPTHS.items():
        legal = legal | ((F.col("color_type") == kind) & F.col("depth").isin(*depths))
    colours = F.octet_length("plte")
    told = (
        F.when(F.col("status") != "ok", F.col("status")).when(~legal | (F.col("method") != 0) | (F.col("interlaced") > 1) | ((F.col("color_type") == 3) & ((colours == 0) | (colours % 3 != 0))), "bad_format")
        .when(~F.col("w").between(1, PNG_SIDE) | ~F.col("h").between(1, PNG_SIDE) | (F.col("w") * F.col("h") > PNG_PIXELS), "bad_size").when(F.col("interlaced") == 1, "interlaced").otherwise("ok")
    )
    level = lambda i: be_uint(F.col("clear"), 2 * i, 2)
    key = F.when((F.col("color_type") == 0) & (F.octet_length("clear") >= 2), F.array(level(0))).when((F.col("color_type") == 2) & (F.octet_length("clear") >= 6), F.array(level(0), level(1), level(2)))
    heads = named.withColumn("status", told)
    parts = segments(walk).where("name = 'IDAT'").groupBy(F.col("path").alias("image_id")).agg(F.sum("length").alias("bytes"), F.sort_array(F.collect_list(F.struct("place", "data"))).alias("p"))
    heads = heads.join(parts.select("image_id", "bytes"), "image_id", "left").withColumn("status", F.when((F.col("status") == "ok") & (F.col("bytes") > PNG_BYTES), "bad_size").otherwise(F.col("status")))
    good = heads.where("status = 'ok'").select("image_id", "w", "h", "depth", "color_type", key.alias("key")).join(parts, "image_id")
    lines = good.select(F.col("image_id").cast("string").alias("image_id"), "w", "h", "depth", "color_type", "key", F.col("p.data").alias("data"))
    lines = kept(lines.mapInArrow(_inflated, LINES))
    problems = lines.where("problem IS NOT NULL").select("image_id", "problem")
    verdicts = heads.select(F.col("image_id").cast("string").alias("image_id"), "status").join(problems, "image_id", "left").select("image_id", F.coalesce("problem", "status").alias("status"))
    entry = F.posexplode(F.sequence(F.lit(0), F.floor(colours / 3).cast("int") - 1)).alias("k", "n")
    mapped = heads.where("status = 'ok' AND color_type = 3").select(F.col("image_id").cast("string").alias("image_id"), "plte", "clear", entry)
    at = lambda c, k: F.conv(F.hex(F.substring(F.col(c), (k + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    palettes = mapped.select("image_id", F.col("n").cast("bigint").alias("i"), *(at("plte", 3 * F.col("n") + j).alias(c) for j, c in enumerate("rgb")), F.coalesce(at("clear", F.col("n")), F.lit(255)).alias("a"))
    return lines.where("problem IS NULL").drop("problem"), palettes, verdicts


def png_pixels(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels, verdicts) of PNG files (path, content): (path, y, x, r, g, b, a), and (path, status), which besides those of
    png_scanlines is serial (other filters) or bad_index (a pixel outside the palette)."""
    lines, palettes, verdicts = png_scanlines(files)
    units, filters = unfiltered_units(lines)
    shown = kept(coloured(samples(units), palettes))
    wrong = shown.where("status = 'error'").select("image_id").distinct().withColumn("wrong", F.lit("bad_index"))
    serial = filters.where("status = 'serial'").withColumnRenamed("status", "serial")
    told = verdicts.join(serial, "image_id", "left").join(wrong, "image_id", "left").select(F.col("image_id").alias("path"), F.coalesce("wrong", "serial", "status").alias("status"))
    return shown.where("status = 'ok'").join(wrong, "image_id", "left_anti").select(F.col("image_id").alias("path"), "y", "x", "r", "g", "b", "a"), told


def read_images(spark: SparkSession, path: str, pattern: str = "*", expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels, report) of all files under a path.

    pixels: (path, y, x, r, g, b, a), rows from the top. report: (path, type, width, height, reader, status): reader is own or
    built-in; status is ok, skipped_webp, unexpected (another size than expected (path, width, height) says; no pixels),
    bad_size, or error. A PNG that the own reader leaves for its filters or passes goes to the built-in one; one that is
    broken stays an error. Files of null or empty content never stop the others.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    heads = kept(file_heads(files).select("path", "head.type", "head.width", "head.height", "head.status"))
    of = lambda kind: files.join(heads.where((F.col("type") == kind) & (F.col("status") == "ok")).select("path"), "path", "left_semi")
    (own, told), (mapped, mapped_told) = png_pixels(of("png")), bmp_pixels(of("bmp"))
    own, told = own.unionByName(mapped), kept(told.unionByName(mapped_told))
    built_in = decoded(spark, path).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))  # as the other source names it
    sizes = built_in.select("path", (F.col("width") > 0).alias("_read"))
    wanted = heads.select("path", F.lit(None).cast("long").alias("_w"), F.lit(None).cast("long").alias("_h")) if expected is None else expected.select("path", F.col("width").cast("long").alias("_w"), F.col("height").cast("long").alias("_h"))
    rows = heads.join(told.withColumnRenamed("status", "_own"), "path", "left").join(sizes, "path", "left").join(wanted, "path", "left")
    left = F.col("_own").isin("serial", "interlaced")
    reader = F.when(F.col("_own") == "ok", "own").when(((F.col("type") == "jpeg") | left) & F.coalesce("_read", F.lit(False)), "built-in")
    geometry = geometry_status(F.col("width"), F.col("height"), F.col("_w"), F.col("_h"), PNG_SIDE)
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_reader").isNull(), "error").otherwise(geometry)
    report = rows.withColumn("_reader", reader).select("path", "type", "width", "height", F.when(status == "ok", F.col("_reader")).alias("reader"), status.alias("status"))
    by = lambda name: report.where(F.col("reader") == name).select("path")
    return own.join(by("own"), "path", "left_semi").unionByName(pixels(built_in.join(by("built-in"), "path", "left_semi"))), report
