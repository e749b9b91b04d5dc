"""Queries of staged sets and of the file sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterflow.functions.integers import floor_div
from rasterflow.operators import pixels
from rasterflow.plans.image_queries import PX, table
from rasterflow.plans.queries import register
from rasterflow.plans.staging import shared_folder
from rasterflow.sources import file_sink, staged

#: Images of 40 rows and 61 columns, so that both sides need padding: (image_id, y, x, r, g, b, a); a is 255 in every other one.
ODD = """od AS (SELECT (image_id * 16 + y) // 40 image_id, (image_id * 16 + y) % 40 y, x, r, g, b, CASE WHEN (image_id * 16 + y) // 40 % 2 = 0 THEN a ELSE 255 END a FROM px WHERE x < 61),
os AS (SELECT image_id, max(x) + 1 w, max(y) + 1 h, bool_or(a < 255) has_alpha, count(*) = (max(x) + 1) * (max(y) + 1) whole FROM od GROUP BY image_id),
fa AS (SELECT *, (w + 15) // 16 * 16 wp, (h + 15) // 16 * 16 hp, CASE WHEN image_id % 3 = 0 THEN len('profile ' || image_id) ELSE 0 END icc FROM os)"""

#: Padded plane rows pr(image_id, plane, row, samples) of whole images, each sample found by its own place.
PLANES = """gy AS (SELECT image_id, w, h, y, unnest(range(0, wp)) x FROM (SELECT *, unnest(range(0, hp)) y FROM fa WHERE whole)),
yy AS (SELECT g.image_id, 'y' plane, g.y AS row, g.x, (16839*r + 33059*g + 6420*b + 1081344) >> 16 s FROM gy g JOIN od ON od.image_id = g.image_id AND od.y = least(g.y, h - 1) AND od.x = least(g.x, w - 1)),
gc AS (SELECT image_id, w, h, y, unnest(range(0, wp // 2)) x FROM (SELECT *, unnest(range(0, hp // 2)) y FROM fa WHERE whole)),
g4 AS (SELECT *, unnest([0, 0, 1, 1]) dy, unnest([0, 1, 0, 1]) dx FROM gc),
cs AS (SELECT g.image_id, g.y, g.x, sum(-9719*r - 19081*g + 28800*b) u, sum(28800*r - 24116*g - 4684*b) v
FROM g4 g JOIN od ON od.image_id = g.image_id AND od.y = least(2 * g.y + dy, h - 1) AND od.x = least(2 * least(g.x, (w - 1) // 2) + dx, w - 1) GROUP BY ALL),
cc AS (SELECT image_id, plane, y AS row, x, least(greatest((((CAST(t AS BIGINT) + 2) >> 2) + 8421376) >> 16, 0), 255) s FROM (SELECT image_id, 'u' plane, y, x, u t FROM cs UNION ALL SELECT image_id, 'v', y, x, v FROM cs)),
aa AS (SELECT image_id, 'a' plane, y AS row, x, a s FROM od JOIN fa USING (image_id) WHERE whole AND fa.has_alpha),
pr AS (SELECT image_id, plane, row, string_agg(right('0' || hex(s), 2), '' ORDER BY x) samples FROM (SELECT * FROM yy UNION ALL SELECT * FROM cc UNION ALL SELECT * FROM aa) GROUP BY ALL)"""


def odd_images(spark, sf_dir):
    row = F.col("image_id") * 16 + F.col("y")
    px = pixels.embedding_pixels(table(spark, sf_dir, "embeddings")).where("x < 61")
    image = floor_div(row, 40)
    return px.select(image.alias("image_id"), (row % 40).alias("y"), "x", "r", "g", "b", F.when(image % 2 == 0, F.col("a")).otherwise(255).alias("a"))


def staged_set(spark, sf_dir) -> str:
    """Stages the images, a profile for every third, and returns the set's name."""
    px = odd_images(spark, sf_dir)
    ids = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(floor_div(F.col("vec_id"), 40).alias("image_id")).distinct()
    profiles = ids.where("image_id % 3 = 0").withColumn("profile", F.encode(F.concat(F.lit("profile "), F.col("image_id").cast("string")), "utf-8"))
    name = "set_" + uuid.uuid4().hex[:12]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    staged.stage_images(px, name, shared_folder(spark), buckets, profiles)
    return name


@register("staged_planes", f"WITH {PX}, {ODD}, {PLANES} SELECT * FROM pr")
def staged_planes(spark, sf_dir):
    """All rows of all planes of the staged set."""
    return spark.table(f"{staged_set(spark, sf_dir)}_planes").select("image_id", "plane", "row", F.hex("samples").alias("samples"))


@register(
    "staged_bands",
    f"""WITH {PX}, {ODD}, {PLANES}, st AS (SELECT *, CASE WHEN NOT whole THEN 'gaps' WHEN hp // 16 < 3 THEN 'short' ELSE 'ok' END status FROM fa)
SELECT st.image_id, plane, row, samples, wp // 16 AS mbw, hp // 16 AS mbh, has_alpha, icc AS icc_bytes, status FROM st LEFT JOIN pr
ON st.image_id = pr.image_id AND status = 'ok' AND (plane = 'y' AND row BETWEEN 16 AND 47 OR plane IN ('u', 'v') AND row BETWEEN 8 AND 23)""",
)
def staged_bands(spark, sf_dir):
    """The second and third macroblock rows."""
    return staged.staged_band(spark, staged_set(spark, sf_dir), 1, 2).withColumn("samples", F.hex("samples"))


@register(
    "staged_extras",
    f"""WITH {PX}, {ODD} SELECT image_id, CASE WHEN icc > 0 THEN 'profile ' || image_id END AS profile, CASE WHEN whole AND has_alpha THEN h ELSE 0 END AS alpha_rows FROM fa""",
)
def staged_extras(spark, sf_dir):
    return staged.staged_extras(spark, staged_set(spark, sf_dir)).withColumn("profile", F.decode("profile", "utf-8"))


@register("stored_files", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN strlen(text) END AS bytes, md5(text) AS content_md5, CASE WHEN text IS NULL THEN 'error' ELSE 'ok' END AS status FROM documents")
def stored_files(spark, sf_dir):
    """Texts as files, listed by the manifest and read back from it."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "utf-8").alias("content"))
    folder = shared_folder(spark)
    file_sink.store_files(rows, f"{folder}/files", f"{folder}/manifest")
    listed = file_sink.listed_files(spark, f"{folder}/manifest")
    read = file_sink.stored_contents(listed).select("path", F.md5("content").alias("content_md5"))
    return listed.join(read, "path", "left").select(F.col("name").cast("long").alias("doc_id"), "bytes", "content_md5", "status")
