"""Staged sets: padded planes, alpha, colour profiles and facts of images as tables bucketed by image, read back by bands.

All tables of a set have the same buckets, so a band meets its facts, and the last step its profile, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.operators.planes import BLOCK, padded_planes
from rasterflow.plans.staging import kept


def _stored(df: DataFrame, table: str, path: str, buckets: int, order: list[str], by: list[str]) -> None:
    """One file a bucket (and plane): rows are dealt by the buckets' own hash before they are written."""
    out = df.repartition(buckets, "image_id").write.bucketBy(buckets, "image_id").sortBy(*order).option("path", path).mode("overwrite")
    (out.partitionBy(*by) if by else out).saveAsTable(table)


def stage_images(px: DataFrame, name: str, folder: str, buckets: int, profiles: DataFrame | None = None) -> None:
    """Store pixels (image_id, y, x, r, g, b, a) as the set ``name`` under ``folder``: tables name_planes, name_facts and
    name_profiles. profiles: (image_id, profile), one a row of an image at most; null and empty ones count as none.

    Rows lie by their number inside a bucket, so a band prunes the rest. Images with gaps have facts with that status and no
    rows. A set of the same name is replaced. ``buckets`` is a matter of size: a file of planes should fit a task.
    """
    rows, facts = padded_planes(kept(px))
    none = px.select("image_id", F.lit(None).cast("binary").alias("profile")).limit(0)
    given = (none if profiles is None else profiles.select("image_id", "profile")).where(F.octet_length("profile") > 0)
    given = given.groupBy("image_id").agg(F.min("profile").alias("profile"))
    sizes = given.select("image_id", F.octet_length("profile").cast("long").alias("icc_bytes"))
    facts = facts.join(sizes, "image_id", "left").withColumn("icc_bytes", F.coalesce("icc_bytes", F.lit(0).cast("long")))
    _stored(rows, f"{name}_planes", f"{folder}/{name}/planes", buckets, ["row", "image_id"], ["plane"])
    _stored(facts, f"{name}_facts", f"{folder}/{name}/facts", buckets, ["image_id"], [])
    _stored(given, f"{name}_profiles", f"{folder}/{name}/profiles", buckets, ["image_id"], [])


def staged_band(spark: SparkSession, name: str, top: int, rows: int) -> DataFrame:
    """Macroblock rows top .. top + rows - 1 of every image of a set: (image_id, plane, row, samples, mbw, mbh, has_alpha,
    icc_bytes, status), planes y, u and v. An image that ends before the band does, or has gaps, is one row with status
    'short' or 'gaps' and nothing else."""
    half = BLOCK // 2
    luma = (F.col("plane") == "y") & F.col("row").between(top * BLOCK, (top + rows) * BLOCK - 1)
    chroma = F.col("plane").isin("u", "v") & F.col("row").between(top * half, (top + rows) * half - 1)
    found = spark.table(f"{name}_planes").where(luma | chroma).select("image_id", "plane", "row", "samples")
    facts = spark.table(f"{name}_facts").select(
        "image_id", "mbw", "mbh", "has_alpha", "icc_bytes", F.when(F.col("status") != "ok", F.col("status")).when(F.col("mbh") < top + rows, "short").otherwise("ok").alias("status")
    )
    out = facts.hint("merge").join(found, "image_id", "left").where("status = 'ok'").unionByName(facts.where("status <> 'ok'"), allowMissingColumns=True)
    return out.select("image_id", "plane", "row", "samples", "mbw", "mbh", "has_alpha", "icc_bytes", "status")


def staged_extras(spark: SparkSession, name: str) -> DataFrame:
    """(image_id, profile, alpha_rows) of every image of a set: its profile or null, and how many rows of alpha it has, 0 if it
    is opaque; the rows themselves are plane a of name_planes."""
    alpha = spark.table(f"{name}_planes").where("plane = 'a'").groupBy("image_id").agg(F.count("*").alias("alpha_rows"))
    facts, profiles = spark.table(f"{name}_facts").select("image_id"), spark.table(f"{name}_profiles")
    out = facts.hint("merge").join(profiles, "image_id", "left").hint("merge").join(alpha, "image_id", "left")
    return out.select("image_id", "profile", F.coalesce("alpha_rows", F.lit(0)).alias("alpha_rows"))
