"""Metadata rules as joins: legal PNG formats, profile parts, frame kinds, distance codes, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit depths that each PNG colour type allows.
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: JPEG start-of-frame markers by name; only the first is decoded.
FRAME_KINDS = {
    0xC0: "baseline sequential",
    0xC1: "extended sequential",
    0xC2: "progressive",
    0xC3: "lossless",
    0xC5: "differential sequential",
    0xC6: "differential progressive",
    0xC7: "differential lossless",
    0xC9: "arithmetic sequential",
    0xCA: "arithmetic progressive",
    0xCB: "arithmetic lossless",
    0xCD: "differential arithmetic sequential",
    0xCE: "differential arithmetic progressive",
    0xCF: "differential arithmetic lossless",
}
#: Fixed value: most parts of a profile, as one byte counts them.
MOST_PARTS = 255
#: Fixed values (lossless bitstream specification): neighbour offsets (x, y) in order of their distance codes 1 to 120.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1),
    (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2),
    (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5),
    (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4),
    (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7),
    (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1),
    (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6),
    (8, 7),
)


def neighbours() -> list[tuple[int, int, int]]:
    return [(i, *p) for i, p in enumerate(NEIGHBOURS, 1)]


def png_format_legal(formats: DataFrame) -> DataFrame:
    """Rows (color_type, depth, ...) with legal: whether the pair is one of the fifteen allowed."""
    pairs = [(c, d, True) for c, ds in PNG_DEPTHS.items() for d in ds]
    table = F.broadcast(formats.sparkSession.createDataFrame(pairs, "color_type int, depth int, legal boolean"))
    return formats.join(table, ["color_type", "depth"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


def frame_kinds(markers: DataFrame) -> DataFrame:
    """Rows (marker, ...) with the frame's name, 'unknown' for others, and whether it is supported."""
    table = F.broadcast(markers.sparkSession.createDataFrame(list(FRAME_KINDS.items()), "marker int, name string"))
    out = markers.join(table, "marker", "left").withColumn("name", F.coalesce("name", F.lit("unknown")))
    return out.withColumn("supported", F.col("marker") == 0xC0)


def assembled_profiles(parts: DataFrame, most: int | None = MOST_PARTS, place: str | None = None) -> DataFrame:
    """Profiles from segments (path, seq, total, payload) with a status: null and 'error' unless there are as many numbers as
    the total says.

    place: a column that orders a file's segments. Of parts with one number the later one stays, and the last total counts;
    without it, the longest part and the greatest total. The format numbers parts in one byte, so a path with a total beyond
    ``most`` is invalid. Counts settle that before payloads are collected, and one row's list is bounded, unless ``most`` is
    None.
    """
    fits = lambda n: F.lit(True) if most is None else F.col(n) <= most
    legal = F.coalesce(F.expr("seq >= 1 AND total >= 1 AND seq <= total"), F.lit(False))
    rank = F.struct(F.octet_length("payload"), F.hex("payload")) if place is None else F.col(place)
    last = F.when(legal, F.struct(F.lit(0).alias("r") if place is None else F.col(place).alias("r"), F.col("total").alias("t")))
    numbers = parts.groupBy("path", F.when(legal, F.col("seq")).alias("seq")).agg(F.max(last).alias("last"))
    counts = numbers.groupBy("path").agg(F.count("seq").alias("n"), F.max("last")["t"].alias("total"))
    counts = counts.select("path", F.coalesce((F.col("n") == F.col("total")) & fits("total"), F.lit(False)).alias("whole"))
    own = parts.where(legal & fits("seq")).groupBy("path", "seq").agg(F.max_by("payload", rank).alias("payload"))
    own = own.join(counts.where("whole").select("path"), "path", "left_semi")
    lists = own.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["payload"])), ""))
    out = counts.join(lists.select("path", joined.alias("profile")), "path", "left")
    return out.select("path", "profile", F.when(F.col("whole"), "ok").otherwise("error").alias("status"))


def distance_codes(distances: DataFrame) -> DataFrame:
    """Rows (distance, width, ...) with the code of the backward distance: the least neighbour that lies there, else + 120."""
    near = distances.sparkSession.createDataFrame(neighbours(), "near int, dx int, dy int")
    widths = distances.select("width").distinct()
    table = widths.crossJoin(F.broadcast(near)).groupBy("width", F.greatest(F.col("dx") + F.col("dy") * F.col("width"), F.lit(1)).alias("distance")).agg(F.min("near").alias("near"))
    return distances.join(table, ["width", "distance"], "left").withColumn("code", F.coalesce("near", F.col("distance") + 120)).drop("near")

