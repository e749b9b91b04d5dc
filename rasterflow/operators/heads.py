"""Head facts of whole files: sizes of JPEG files from their segments, transparency of PNG files from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.functions.integers import be_uint
from rasterflow.operators.container import ALPHA_POLICIES, HEAD_BYTES, file_type, webp_size
from rasterflow.operators.metadata import assembled_profiles
from rasterflow.operators.walks import bmp_header, file_facts, frame_size, let, profile_parts, walked
from rasterflow.plans.staging import kept

#: Names of BMP compression methods.
BMP_METHODS = {1: "rle8", 2: "rle4", 3: "bitfields", 6: "alpha-bitfields"}


def key_levels(transparency: Column, color_type: Column, depth: Column) -> Column:
    """The colour that a PNG's transparency chunk makes clear, as 8-bit levels: one of a grey picture, three of a colour one;
    null for palettes and chunks too short."""
    level = lambda i: F.when(depth >= 16, be_uint(transparency, 2 * i, 1)).otherwise(be_uint(transparency, 2 * i + 1, 1))
    grey = (color_type == 0) & (F.octet_length(transparency) >= 2)
    return F.when(grey, F.array(level(0))).when((color_type == 2) & (F.octet_length(transparency) >= 6), F.array(level(0), level(1), level(2)))


def described(kind: Column, chunk: Column, depth: Column, color_type: Column, packing: Column, alpha: Column, transparency: Column, key: Column, profile_bytes: Column) -> Column:
    """A picture's kind in words: format, depth, colour type or compression, transparency, profile."""
    method = F.lit("rgb")
    for code, name in BMP_METHODS.items():
        method = F.when(packing == code, name).otherwise(method)
    bmp = F.concat_ws(" ", F.lit("bmp"), F.concat(depth.cast("string"), F.lit("bpp")), method, F.when(alpha, "alpha"))
    png = F.concat_ws(" ", F.concat(F.lit("png/ct"), color_type.cast("string"), F.lit("/bd"), depth.cast("string")), F.when(transparency.isNotNull(), F.when(key.isNull(), "trns(palette)").otherwise("trns(key)")))
    icc = F.when(profile_bytes.isNotNull(), F.concat(F.lit("icc "), profile_bytes.cast("string"), F.lit("B")))
    own = F.when(kind == "bmp", bmp).when(kind == "png", png).when(kind == "jpeg", "jpeg")
    return F.when(kind == "webp", F.concat(F.lit("webp ("), F.rtrim(chunk), F.lit(")"))).when(own.isNotNull(), F.concat_ws(" ", own, icc))


def file_heads(files: DataFrame, alpha_policy: str = "keep", key: str = "path", content: str = "content") -> DataFrame:
    """One row a file: key, length, head (as ``head_facts``, all of it from the file's own parts), marker of a JPEG's frame,
    key_levels, profile (of a JPEG) and description.

    A PNG may have alpha by its colour type or by a transparency chunk before its picture; a JPEG's size is that of its first
    frame, and one without a frame is an error; a BMP's facts are those of a header that holds all rules. Keys tell files
    apart. A null content is an unreadable file, status 'error'. Bytes of PNG and JPEG files are read up to the picture;
    only facts are joined.
    """
    head, size = F.substring(F.col(content), 1, HEAD_BYTES), F.octet_length(content)
    kind = file_type(F.substring(F.col(content), 1, 12))
    webp = let(head, lambda c: F.struct(F.substring(c, 13, 4).cast("string").alias("chunk"), webp_size(c).alias("size")))
    typed = files.select(F.col(key), content, kind.alias("_kind"))
    base = typed.select(key, "_kind", size.cast("bigint").alias("length"), F.when(F.col("_kind") == "webp", webp).alias("w"), F.when(F.col("_kind") == "bmp", bmp_header(head, size)).alias("b"))
    serial = typed.where("_kind IN ('png', 'jpeg')")
    walk = kept(walked(serial, ("png_head", "jpeg"), key, content, F.when(F.col("_kind") == "png", "png_head").otherwise("jpeg")))
    facts = file_facts(walk, key, ("IHDR", "tRNS")).select(key, F.col("status").alias("_walk"), frame_size(F.col("frame")).alias("f"), "IHDR", "tRNS")
    profiles = assembled_profiles(profile_parts(walk, key).withColumnRenamed(key, "path"), place="place").select(F.col("path").alias(key), "profile")
    all_facts = base.join(facts, key, "left").join(profiles, key, "left")
    is_kind = lambda k: F.col("_kind") == k
    pick = lambda png, jpeg, bmp, other: F.when(is_kind("png"), png).when(is_kind("jpeg"), jpeg).when(is_kind("bmp"), bmp).otherwise(other)
    ihdr = lambda at, n: be_uint(F.col("IHDR"), at, n)
    alpha = pick(ihdr(9, 1).isin(4, 6) | F.col("tRNS").isNotNull(), F.lit(False), F.col("b.alpha"), is_kind("webp"))
    good = pick(F.col("_walk") == "ok", F.col("f.width").isNotNull(), F.col("b.status") == "ok", F.col("w.size.width").isNotNull())
    shown = lambda c: F.when(F.col("_good"), c)
    rows = all_facts.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_alpha", F.coalesce(alpha, F.lit(False)))
    rows = rows.withColumn("_depth", pick(ihdr(8, 1), F.lit(None), F.col("b.depth"), F.lit(None))).withColumn("_color", F.when(is_kind("png"), ihdr(9, 1)))
    rows = rows.withColumn("_key", key_levels(F.col("tRNS"), F.col("_color"), F.col("_depth")))
    status = F.when(is_kind("webp"), "skipped_webp").when(F.col("_good"), "ok").otherwise("error")
    # a file cut short has the policy of what its header says
    cut = F.coalesce(pick(F.lit(False), F.col("_walk") == "truncated", F.col("b.status") == "truncated", F.lit(False)), F.lit(False))
    policy = F.when((F.col("_good") | cut) & ~is_kind("webp"), F.when(F.col("_alpha"), ALPHA_POLICIES[alpha_policy]).otherwise("none"))
    facts_of = F.struct(
        F.col("_kind").alias("type"), shown(pick(ihdr(0, 4), F.col("f.width"), F.col("b.width"), F.col("w.size.width"))).alias("width"), shown(pick(ihdr(4, 4), F.col("f.height"), F.col("b.height"), F.col("w.size.height"))).alias("height"),
        shown(F.col("_depth")).alias("depth"), shown(F.col("_color")).alias("color_type"), F.col("_alpha").alias("may_have_alpha"), status.alias("status"), policy.alias("alpha_status"),
    )
    text = described(F.col("_kind"), F.col("w.chunk"), F.col("_depth"), F.col("_color"), F.col("b.compression"), F.col("b.alpha"), F.col("tRNS"), F.col("_key"), F.octet_length("profile"))
    return rows.select(key, "length", facts_of.alias("head"), F.col("f.marker").alias("marker"), F.col("_key").alias("key_levels"), "profile", shown(text).alias("description"))
