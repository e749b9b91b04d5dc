"""Bitmaps of all depths, masks and run lengths as pixels.

A file's stored rows are cut out of its bytes in one expression, a run-length stream becomes rows by the parallel reader of
``rle``; from there on both are rows of samples. A palette travels with its rows, so that no pixel is shuffled to be
coloured; channel masks are applied by column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.operators.rle import rle_runs
from rasterflow.operators.walks import BMP_MASKS, bmp_header
from rasterflow.plans.staging import kept

#: Samples of one batch of rows handed back to Spark.
BATCH = 1 << 20
RUN = "array<struct<x:bigint,length:int,pattern:binary>>"


def palette_bytes(content: Column, h: Column) -> Column:
    """The stored palette, as far as it fits before the pixels; empty for samples that are colours."""
    entry = h["palette_entry"]
    room = F.least(h["offset"], F.octet_length(content)) - h["palette_at"]
    n = F.greatest(F.least(h["palette_colors"], F.floor(room / entry), F.lit(256)), F.lit(0))
    return F.substring(content, (h["palette_at"] + 1).cast("int"), (n * entry).cast("int"))


def packed_samples(data: bytes, w: int, bits: int) -> np.ndarray:
    """The samples of a stored row; what pads it is left out."""
    line = np.frombuffer(data, np.uint8)
    if bits < 8:
        return (np.unpackbits(line).reshape(-1, bits) @ (1 << np.arange(bits)[::-1]))[:w]
    n = bits // 8
    return line[: w * n].reshape(w, n).astype(np.int64) @ (1 << 8 * np.arange(n))


def run_samples(runs: list[dict], w: int) -> np.ndarray:
    """The samples of a row of runs; places that none writes, and those outside the row, are as the format says: 0 and gone."""
    out = np.zeros(w, np.int64)
    if not runs:
        return out
    x, n, size = (np.array(v, np.int64) for v in ([r["x"] for r in runs], [r["length"] for r in runs], [len(r["pattern"]) for r in runs]))
    flat = np.frombuffer(b"".join(r["pattern"] for r in runs), np.uint8)
    each = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    place, value = x[each] + within, flat[(np.cumsum(size) - size)[each] + within % size[each]]
    out[place[place < w]] = value[place < w]
    return out


def _rows(batches):
    for batch in batches:
        held, many, first = [], 0, 0
        columns = [c.to_pylist() for c in batch.columns[3:]]

        def close(first, held):
            size = np.cumsum([0, *map(len, held)])
            samples = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(held), pa.int64()))
            return pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in batch.columns[:3]), samples], ["path", "y", "masks", "s"])

        for k, (w, bits, data, runs, palette, entry) in enumerate(zip(*columns)):
            s = packed_samples(data, w, bits) if data is not None else run_samples(runs or [], w)
            if bits <= 8:
                stored = np.frombuffer(palette, np.uint8).reshape(-1, entry)[:, :3].astype(np.int64)
                colours = np.zeros(256, np.int64)
                colours[: len(stored)] = stored @ (1 << 8 * np.arange(3))
                s = colours[s]
            held.append(s)
            many += w
            if many >= BATCH:
                yield close(first, held)
                held, many, first = [], 0, k + 1
        if held:
            yield close(first, held)


def channel(sample: Column, mask: Column) -> Column:
    """A masked field, its range widened to 0..255, to nearest; 0 where the mask is empty."""
    low = mask.bitwiseAND(-mask)
    whole = lambda a, b: F.floor(a / b).cast("bigint")
    most = whole(mask, low)
    return F.when(mask == 0, 0).otherwise(whole(whole(sample.bitwiseAND(mask), low) * 255 + whole(most, F.lit(2)), most)).cast("bigint")


def bmp_pixels(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels, verdicts) of BMP files (path, content), one row a path.

    pixels: (path, y, x, r, g, b, a), rows from the top; alpha is 255 without a mask of its own; an index outside the
    palette is black, and so are places that a run-length stream leaves out if the palette says so for index 0. verdicts:
    (path, status): that of ``bmp_header``, or truncated where a run-length stream ends before its end command. Files that
    are not ok, null and empty ones included, give no pixels. A null path is dropped.
    """
    heads = kept(files.where("path IS NOT NULL").select("path", "content", bmp_header(F.col("content")).alias("h")))
    good = heads.where("h.status = 'ok'")
    h = F.col("h")
    shown = lambda y: F.when(h["top_down"], y).otherwise(h["height"] - 1 - y)
    fixed = F.array(*(F.lit(m).cast("bigint") for m in BMP_MASKS[24]))
    bare = F.array(*(F.when(h["alpha"] | (F.lit(k) < 3), F.get(h["masks"], F.lit(k))).otherwise(F.lit(0)) for k in range(4)))
    facts = (F.when(h["depth"] <= 8, fixed).otherwise(bare).alias("masks"), h["width"].alias("w"), h["depth"].alias("bits"))
    colours = (palette_bytes(F.col("content"), h).alias("palette"), h["palette_entry"].alias("entry"))

    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), h["height"] - 1), lambda i: F.substring(F.col("content"), (h["offset"] + i * h["stride"] + 1).cast("int"), h["stride"].cast("int")))
    packed = good.where("h.stride > 0").select("path", "h", *facts, *colours, F.posexplode(cut).alias("y", "data"))
    lines = packed.select("path", shown(F.col("y").cast("bigint")).alias("y"), "masks", "w", "bits", "data", F.lit(None).cast(RUN).alias("runs"), "palette", "entry")

    coded = good.where("h.stride = 0")
    runs, ends = rle_runs(coded.select(F.col("path").alias("image_id"), F.expr("substring(content, CAST(h.offset AS INT) + 1)").alias("data"), (h["compression"] == 2).alias("nibbles")))
    ends = kept(ends)
    whole = coded.join(ends.where("status = 'ok'").select(F.col("image_id").alias("path")), "path", "left_semi")
    by_row = runs.groupBy(F.col("image_id").alias("path"), "y").agg(F.collect_list(F.struct("x", "length", "pattern")).alias("runs"))
    rows = whole.select("path", "h", *facts, *colours, F.explode(F.sequence(F.lit(0).cast("bigint"), h["height"] - 1)).alias("y")).join(by_row, ["path", "y"], "left")
    lines = lines.unionByName(rows.select("path", shown(F.col("y")).alias("y"), "masks", "w", "bits", F.lit(None).cast("binary").alias("data"), F.col("runs").cast(RUN), "palette", "entry"))

    found = lines.mapInArrow(_rows, "path string, y bigint, masks array<bigint>, s array<bigint>")
    each = found.select("path", "y", "masks", F.posexplode("s").alias("x", "s"))
    mask = lambda k: F.get("masks", F.lit(k))
    levels = [channel(F.col("s"), mask(k)).alias(c) for k, c in enumerate("rgb")]
    alpha = F.when(F.coalesce(mask(3), F.lit(0)) == 0, 255).otherwise(channel(F.col("s"), mask(3))).cast("bigint").alias("a")
    told = heads.select("path", h["status"].alias("status")).join(ends.where("status <> 'ok'").select(F.col("image_id").alias("path"), F.col("status").alias("cut")), "path", "left")
    return each.select("path", "y", F.col("x").cast("bigint").alias("x"), *levels, alpha), told.select("path", F.coalesce("cut", "status").alias("status"))
