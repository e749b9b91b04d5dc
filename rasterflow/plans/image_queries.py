"""Queries of the image operators over rasters derived from whole shared tables, with the SQL that states each."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterflow.operators import blocks, container, entropy, expansion, metadata, pixels, resample
from rasterflow.plans.queries import register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark, sf_dir):
    return pixels.embedding_pixels(table(spark, sf_dir, "embeddings"))


def _level(k: int) -> str:
    return f"CAST(floor((CAST(embedding[(x + {k}) % len(embedding) + 1] AS DOUBLE) + 1) * 1.275e2) AS BIGINT)"


#: Pixels px(image_id, y, x, r, g, b, a) of the embeddings.
PX = f"""px AS (SELECT vec_id // 16 image_id, vec_id % 16 y, x, {_level(0)} r, {_level(21)} g, {_level(42)} b, {_level(13)} a
FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) x FROM embeddings)),
sz AS (SELECT image_id, max(x) + 1 w, max(y) + 1 h FROM px GROUP BY image_id)"""


@register(
    "macroblock_stats",
    f"WITH {PX} SELECT image_id, y // 16 AS mby, x // 16 AS mbx, count(*) AS n, CAST(sum(r) AS BIGINT) AS total, min(r) AS low, max(r) AS high, CAST(sum(r * r) AS BIGINT) AS squares FROM px GROUP BY image_id, y // 16, x // 16",
)
def macroblock_stats(spark, sf_dir):
    return blocks.macroblock_stats(derived(spark, sf_dir))


@register("pixel_luma", f"WITH {PX} SELECT image_id, y, x, (16839*r + 33059*g + 6420*b + 1081344) >> 16 AS luma FROM px")
def pixel_luma(spark, sf_dir):
    return derived(spark, sf_dir).select("image_id", "y", "x", pixels.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


@register(
    "pixel_chroma",
    f"""WITH {PX}, t AS (SELECT px.*, (CASE WHEN x = w - 1 AND w % 2 = 1 THEN 2 ELSE 1 END) * (CASE WHEN y = h - 1 AND h % 2 = 1 THEN 2 ELSE 1 END) k FROM px JOIN sz USING (image_id)),
s AS (SELECT image_id, y // 2 cy, x // 2 cx, CAST(sum(k * (-9719*r - 19081*g + 28800*b)) AS BIGINT) u, CAST(sum(k * (28800*r - 24116*g - 4684*b)) AS BIGINT) v FROM t GROUP BY ALL)
SELECT image_id, cy, cx, least(greatest((((u + 2) >> 2) + 8421376) >> 16, 0), 255) AS u, least(greatest((((v + 2) >> 2) + 8421376) >> 16, 0), 255) AS v FROM s""",
)
def pixel_chroma(spark, sf_dir):
    return pixels.chroma(derived(spark, sf_dir))


@register(
    "plane_padding",
    f"""WITH {PX}, g AS (SELECT image_id, w, h, y, unnest(range(0, ((w + 23) // 24) * 24)) x FROM (SELECT *, unnest(range(0, ((h + 23) // 24) * 24)) y FROM sz))
SELECT g.image_id, g.y, g.x, px.r AS s FROM g JOIN px ON px.image_id = g.image_id AND px.y = least(g.y, h - 1) AND px.x = least(g.x, w - 1)""",
)
def plane_padding(spark, sf_dir):
    return pixels.padded(derived(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("s")), 24)


@register(
    "ycc_to_rgb",
    f"""WITH {PX} SELECT image_id, y, x, least(greatest(r + ((91881 * (b - 128)) >> 16), 0), 255) AS red,
least(greatest(r - ((22554 * (g - 128) + 46802 * (b - 128)) >> 16), 0), 255) AS green, least(greatest(r + ((116130 * (g - 128)) >> 16), 0), 255) AS blue FROM px""",
)
def ycc_to_rgb(spark, sf_dir):
    red, green, blue = pixels.ycc_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return derived(spark, sf_dir).select("image_id", "y", "x", red.alias("red"), green.alias("green"), blue.alias("blue"))


@register(
    "masked_channels",
    f"""WITH {PX}, s AS (SELECT image_id, y, x, ((r << 8) | g) v FROM px)
SELECT image_id, y, x, (((v >> 11) & 31) * 255 + 15) // 31 AS red, (((v >> 5) & 63) * 255 + 31) // 63 AS green, ((v & 31) * 255 + 15) // 31 AS blue FROM s""",
)
def masked_channels(spark, sf_dir):
    v = F.shiftleft(F.col("r"), 8).bitwiseOR(F.col("g"))
    return derived(spark, sf_dir).select("image_id", "y", "x", *(pixels.masked_channel(v, s, m).alias(n) for n, s, m in (("red", 11, 31), ("green", 5, 63), ("blue", 0, 31))))


@register(
    "packed_samples",
    f"WITH {PX} SELECT image_id, y, x * 4 + k AS x, (r >> CAST(6 - 2 * k AS INTEGER)) & 3 AS v FROM (SELECT *, unnest(range(0, 4)) k FROM px)",
)
def packed_samples(spark, sf_dir):
    return pixels.unpacked(derived(spark, sf_dir), "r", 2)


@register(
    "palette_resolve",
    f"""WITH {PX}, pal AS (SELECT CAST(n_nationkey AS BIGINT) i, CAST(5 + 10 * n_nationkey AS BIGINT) r, CAST(250 - 10 * n_nationkey AS BIGINT) g, CAST(7 * n_nationkey AS BIGINT) b FROM nation)
SELECT image_id, y, x, px.r % 32 AS i, coalesce(pal.r, 0) AS r, coalesce(pal.g, 0) AS g, coalesce(pal.b, 0) AS b FROM px LEFT JOIN pal ON pal.i = px.r % 32""",
)
def palette_resolve(spark, sf_dir):
    i = F.col("n_nationkey").cast("bigint")
    palette = table(spark, sf_dir, "nation").select(i.alias("i"), (5 + 10 * i).alias("r"), (250 - 10 * i).alias("g"), (7 * i).alias("b"))
    indexed = derived(spark, sf_dir).select("image_id", "y", "x", (F.col("r") % 32).alias("i"))
    return pixels.palette_resolved(indexed, palette)


@register(
    "interlace_passes",
    f"""WITH {PX} SELECT image_id, CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 1 WHEN x % 8 = 4 AND y % 8 = 0 THEN 2 WHEN x % 4 = 0 AND y % 8 = 4 THEN 3
WHEN x % 4 = 2 AND y % 4 = 0 THEN 4 WHEN x % 2 = 0 AND y % 4 = 2 THEN 5 WHEN x % 2 = 1 AND y % 2 = 0 THEN 6 ELSE 7 END AS pass, count(*) AS n, CAST(sum(r) AS BIGINT) AS total FROM px GROUP BY ALL""",
)
def interlace_passes(spark, sf_dir):
    return derived(spark, sf_dir).groupBy("image_id", pixels.interlace_pass(F.col("x"), F.col("y")).alias("pass")).agg(F.count("*").alias("n"), F.sum("r").alias("total"))


#: Neighbours of the alpha plane.
NEAR = """n1 AS (SELECT *, lag(a) OVER (PARTITION BY image_id, y ORDER BY x) l, lag(a) OVER (PARTITION BY image_id, x ORDER BY y) t FROM px),
n2 AS (SELECT *, lag(l) OVER (PARTITION BY image_id, x ORDER BY y) tl FROM n1)"""


@register(
    "alpha_residuals",
    f"""WITH {PX}, {NEAR} SELECT image_id, y, x, (a - coalesce(l, t, 0)) & 255 AS horizontal, (a - coalesce(t, l, 0)) & 255 AS vertical,
(a - CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 0 THEN t WHEN y = 0 THEN l ELSE least(greatest(l + t - tl, 0), 255) END) & 255 AS gradient FROM n2""",
)
def alpha_residuals(spark, sf_dir):
    return pixels.alpha_residuals(derived(spark, sf_dir))


@register("alpha_round_trip", f"WITH {PX} SELECT image_id, y, x, a FROM px")
def alpha_round_trip(spark, sf_dir):
    return pixels.undo_horizontal(pixels.alpha_residuals(derived(spark, sf_dir)))


@register("transparent_images", f"WITH {PX} SELECT image_id, bool_and(a = 255) AS opaque, count(*) FILTER (WHERE a < 128) AS n_clear FROM px GROUP BY image_id")
def transparent_images(spark, sf_dir):
    return expansion.opacity(derived(spark, sf_dir))


@register("colour_key", f"WITH {PX} SELECT image_id, y, x, CASE WHEN r = 127 AND g >= 120 THEN 0 ELSE 255 END AS alpha FROM px")
def colour_key(spark, sf_dir):
    return derived(spark, sf_dir).select("image_id", "y", "x", expansion.keyed_alpha((F.col("r") == 127) & (F.col("g") >= 120)).alias("alpha"))


@register(
    "plane_psnr",
    f"""WITH {PX} SELECT image_id, count(*) AS n, CAST(sum((r - g) * (r - g)) AS BIGINT) AS sse,
CASE WHEN sum((r - g) * (r - g)) = 0 THEN CAST('inf' AS DOUBLE) ELSE round(10 * log10(6.5025e4 * count(*) / CAST(sum((r - g) * (r - g)) AS DOUBLE)), 6) END AS psnr FROM px GROUP BY image_id""",
)
def plane_psnr(spark, sf_dir):
    return pixels.psnr(derived(spark, sf_dir), "r", "g")


KNOT_ROWS = ", ".join(f"({k}, {v})" for k, v in blocks.knots())
QI = f"""k(q, i) AS (VALUES {KNOT_ROWS}), seg AS (SELECT lag(q) OVER (ORDER BY q) lo, q hi, lag(i) OVER (ORDER BY q) ilo, i ihi FROM k),
qi AS (SELECT p_partkey, p_size, 2 * p_size AS quality, CAST(round(CASE WHEN hi = least(2 * p_size, 100) THEN ihi ELSE ilo + (least(2 * p_size, 100) - lo) * 1e0 / (hi - lo) * (ihi - ilo) END) AS INTEGER) AS q_index
FROM part JOIN seg ON least(2 * p_size, 100) > coalesce(lo, -1) AND least(2 * p_size, 100) <= hi)"""


def qualities(spark, sf_dir):
    return blocks.quality_index(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2).alias("quality")))


@register("quality_index", f"WITH {QI} SELECT p_partkey, quality, q_index FROM qi")
def quality_index(spark, sf_dir):
    return qualities(spark, sf_dir)


STEPS = "st(q_index, dc, ac) AS (VALUES " + ", ".join(map(str, blocks.steps())) + ")"


@register(
    "quantiser_steps",
    f"WITH {QI}, {STEPS} SELECT p_partkey, quality, qi.q_index, dc AS y_dc, ac AS y_ac, dc * 2 AS y2_dc, greatest(8, ac * 155 // 100) AS y2_ac, least(dc, 132) AS uv_dc, ac AS uv_ac FROM qi JOIN st ON st.q_index = qi.q_index",
)
def quantiser_steps(spark, sf_dir):
    return blocks.quantiser_steps(qualities(spark, sf_dir))


@register(
    "quantised_samples",
    f"WITH {PX} SELECT image_id, y, x, sign(r - 128) * ((abs(r - 128) + 20 - 13) // 20) AS q FROM px",
)
def quantised_samples(spark, sf_dir):
    return derived(spark, sf_dir).select("image_id", "y", "x", blocks.quantised(F.col("r") - 128, F.lit(20)).alias("q"))


SCORES = """bl AS (SELECT p.image_id, p.y // 16 mby, p.x // 16 mbx, p.r s, coalesce(t.r, 127) a, coalesce(l.r, 129) lf, coalesce(c.r, CASE WHEN p.y // 16 = 0 THEN 127 ELSE 129 END) pc
FROM px p LEFT JOIN px t ON t.image_id = p.image_id AND t.x = p.x AND t.y = (p.y // 16) * 16 - 1
LEFT JOIN px l ON l.image_id = p.image_id AND l.y = p.y AND l.x = (p.x // 16) * 16 - 1
LEFT JOIN px c ON c.image_id = p.image_id AND c.y = (p.y // 16) * 16 - 1 AND c.x = (p.x // 16) * 16 - 1),
ed AS (SELECT image_id, y // 16 + 1 mby, x // 16 mbx, r s FROM px WHERE y % 16 = 15 UNION ALL SELECT image_id, y // 16, x // 16 + 1, r FROM px WHERE x % 16 = 15),
mn AS (SELECT image_id, mby, mbx, (2 * sum(s) + count(*)) // (2 * count(*)) mean FROM ed GROUP BY ALL),
sc AS (SELECT image_id, mby, mbx, m AS mode, CAST(sum(abs(s - CASE m WHEN 0 THEN coalesce(mean, 128) WHEN 1 THEN a WHEN 2 THEN lf ELSE least(greatest(lf + a - pc, 0), 255) END)) AS BIGINT) AS sad
FROM bl LEFT JOIN mn USING (image_id, mby, mbx), (VALUES (0), (1), (2), (3)) v(m) GROUP BY ALL)"""


@register("mode_scores", f"WITH {PX}, {SCORES} SELECT * FROM sc")
def mode_scores(spark, sf_dir):
    return blocks.mode_scores(derived(spark, sf_dir))


@register("best_modes", f"WITH {PX}, {SCORES} SELECT image_id, mby, mbx, mode, sad FROM sc QUALIFY row_number() OVER (PARTITION BY image_id, mby, mbx ORDER BY sad, mode) = 1")
def best_modes(spark, sf_dir):
    return blocks.best_mode(blocks.mode_scores(derived(spark, sf_dir)))


@register(
    "pruned_modes",
    f"WITH {PX}, {SCORES} SELECT *, CAST(row_number() OVER (PARTITION BY image_id, mby, mbx ORDER BY sad, mode) AS INTEGER) AS place FROM sc QUALIFY place <= 2",
)
def pruned_modes(spark, sf_dir):
    return blocks.pruned_modes(blocks.mode_scores(derived(spark, sf_dir)), 2)


def symbols(spark, sf_dir):
    return derived(spark, sf_dir).select(F.col("x").alias("slot"), (F.col("r") > 120).cast("int").alias("bit"))


COUNTS = "ct AS (SELECT x AS slot, count(*) FILTER (WHERE r <= 120) AS n0, count(*) FILTER (WHERE r > 120) AS n1 FROM px GROUP BY x)"


@register("symbol_counts", f"WITH {PX}, {COUNTS} SELECT * FROM ct")
def symbol_counts(spark, sf_dir):
    return entropy.symbol_counts(symbols(spark, sf_dir))


@register(
    "adapted_probabilities",
    f"""WITH {PX}, {COUNTS}, p AS (SELECT *, CAST(least(greatest(round(256e0 * n0 / (n0 + n1)), 8), 247) AS INTEGER) np FROM ct),
s AS (SELECT *, round(-(n0 * log2(128 / 256e0) + n1 * log2(1 - 128 / 256e0)) + (n0 * log2(np / 256e0) + n1 * log2(1 - np / 256e0)), 6) sv FROM p)
SELECT slot, n0, n1, CASE WHEN n0 + n1 >= 16 AND sv > -log2(1 - 250 / 256e0) + 8 + log2(250 / 256e0) + 8 THEN np ELSE 128 END AS p,
CASE WHEN n0 + n1 >= 16 AND sv > -log2(1 - 250 / 256e0) + 8 + log2(250 / 256e0) + 8 THEN sv ELSE 0e0 END AS saved FROM s""",
)
def adapted_probabilities(spark, sf_dir):
    return entropy.adapted(entropy.symbol_counts(symbols(spark, sf_dir)), F.lit(128), F.lit(250))


@register(
    "skip_probability",
    f"WITH {PX}, m AS (SELECT image_id, bool_or(r > 140) has FROM px GROUP BY image_id, y // 16, x // 16) SELECT image_id, CAST(least(greatest(round(256e0 * count(*) FILTER (WHERE has) / count(*)), 1), 255) AS INTEGER) AS skip_prob FROM m GROUP BY image_id",
)
def skip_probability(spark, sf_dir):
    return entropy.skip_probability(blocks.macroblock_stats(derived(spark, sf_dir)), F.col("high") > 140)


LENGTHS = "ln AS (SELECT r AS symbol, CAST(least(greatest(ceil(log2(sum(count(*)) OVER () / CAST(count(*) AS DOUBLE))), 1), 15) AS INTEGER) AS length FROM px GROUP BY r)"


@register("level_histogram", f"WITH {PX} SELECT r AS symbol, count(*) AS freq FROM px GROUP BY r")
def level_histogram(spark, sf_dir):
    return derived(spark, sf_dir).groupBy(F.col("r").alias("symbol")).agg(F.count("*").alias("freq"))


@register(
    "canonical_codes",
    f"""WITH {PX}, {LENGTHS}, f AS (SELECT a.length, CAST(coalesce(sum(CASE WHEN b.length < a.length THEN CAST(1 AS BIGINT) << greatest(a.length - b.length, 0) END), 0) AS BIGINT) first FROM (SELECT DISTINCT length FROM ln) a, ln b GROUP BY a.length),
c AS (SELECT symbol, length, first + row_number() OVER (PARTITION BY length ORDER BY symbol) - 1 AS code FROM ln JOIN f USING (length))
SELECT symbol, length, code, reverse(right(concat('000000000000000', bin(code)), length)) AS reversed FROM c""",
)
def canonical_codes(spark, sf_dir):
    freq = level_histogram(spark, sf_dir)
    total = freq.agg(F.sum("freq").alias("total"))  # one row
    length = F.least(F.greatest(F.ceil(F.log2(F.col("total") / F.col("freq"))), F.lit(1)), F.lit(15)).cast("int")
    return entropy.canonical_codes(freq.crossJoin(F.broadcast(total)).select("symbol", length.alias("length")))


@register(
    "row_runs",
    f"""WITH {PX}, m AS (SELECT image_id * 16 + y line, x, r // 8 AS level FROM px), i AS (SELECT *, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END new FROM m WINDOW w AS (PARTITION BY line ORDER BY x)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY line ORDER BY x) AS BIGINT) run FROM i) SELECT line, run, level, count(*) AS length FROM s GROUP BY ALL""",
)
def row_runs(spark, sf_dir):
    lines = derived(spark, sf_dir).select((F.col("image_id") * 16 + F.col("y")).alias("line"), "x", F.floor(F.col("r") / 8).cast("bigint").alias("level"))
    return entropy.runs(lines, "line", "x", "level")


@register(
    "prefix_codes",
    """WITH sg AS (SELECT p prefix, CASE WHEN p < 4 THEN 0 ELSE (p - 2) >> 1 END eb FROM (SELECT CAST(unnest(range(0, 40)) AS INTEGER) p)),
sr AS (SELECT prefix, eb, CASE WHEN prefix < 4 THEN prefix ELSE CAST(2 + (prefix & 1) AS BIGINT) << eb END lo, CAST(1 AS BIGINT) << eb span FROM sg)
SELECT p_partkey, p_partkey + 1 AS value, prefix, eb AS extra_bits, p_partkey - lo AS extra, CASE WHEN prefix IS NULL THEN 'error' ELSE 'ok' END AS status FROM part LEFT JOIN sr ON p_partkey >= lo AND p_partkey < lo + span""",
)
def prefix_codes(spark, sf_dir):
    return entropy.prefix_codes(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") + 1).alias("value")))


@register(
    "webp_containers",
    r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) p, doc_id % 3 = 1 ic FROM documents),
k AS (SELECT *, len(p) // 2 n FROM t), le AS (SELECT *, right(concat('00000000', hex(n)), 8) h FROM k),
c AS (SELECT doc_id, CASE WHEN ic THEN '565038580A00000020000000' || '3F0000' || '0F0000' || '49434350' || '03000000' || '616263' || '00' ELSE '' END
 || '56503820' || substring(h, 7, 2) || substring(h, 5, 2) || substring(h, 3, 2) || substring(h, 1, 2) || p || CASE WHEN n % 2 = 1 THEN '00' ELSE '' END body FROM le),
s AS (SELECT doc_id, body, right(concat('00000000', hex(len(body) // 2 + 4)), 8) z FROM c)
SELECT doc_id, CAST(12 + len(body) // 2 AS BIGINT) AS n_bytes, md5('52494646' || substring(z, 7, 2) || substring(z, 5, 2) || substring(z, 3, 2) || substring(z, 1, 2) || '57454250' || body) AS digest FROM s""",
)
def webp_containers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    profile = F.when(F.col("doc_id") % 3 == 1, F.lit(b"abc"))
    out = docs.select("doc_id", container.webp(F.col("payload"), F.lit(64), F.lit(16), F.lit(None).cast("binary"), profile).alias("file"))
    return out.select("doc_id", F.octet_length("file").cast("bigint").alias("n_bytes"), F.md5(F.hex("file").cast("binary")).alias("digest"))


@register(
    "page_file_types",
    "SELECT page_id, CASE WHEN starts_with(html, 'BM') THEN 'bmp' END AS type, CASE WHEN starts_with(html, 'BM') THEN 'ok' ELSE 'error' END AS status FROM pages",
)
def page_file_types(spark, sf_dir):
    head = container.head_facts(F.encode(F.substring("html", 1, container.HEAD_BYTES), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", head.alias("h")).select("page_id", "h.type", "h.status")


#: The doubled plane: along rows, then along columns.
DOUBLED = """hf AS (SELECT image_id, y // 2 y, x // 2 x, CAST(sum(g) AS BIGINT) // 4 s FROM px GROUP BY ALL),
h1 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY image_id, y ORDER BY x), s) p, coalesce(lead(s) OVER (PARTITION BY image_id, y ORDER BY x), s) n FROM hf),
h2 AS (SELECT image_id, y, 2 * x + k x, (3 * s + CASE k WHEN 0 THEN p ELSE n END + 2) >> 2 s FROM h1, (VALUES (0), (1)) v(k)),
v1 AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY image_id, x ORDER BY y), s) p, coalesce(lead(s) OVER (PARTITION BY image_id, x ORDER BY y), s) n FROM h2),
v2 AS (SELECT image_id, 2 * y + k y, x, (3 * s + CASE k WHEN 0 THEN p ELSE n END + 2) >> 2 s FROM v1, (VALUES (0), (1)) v(k))"""


@register("chroma_upsampling", f"WITH {PX}, {DOUBLED} SELECT image_id, y, x, s FROM v2 JOIN sz USING (image_id) WHERE x < w AND y < h")
def chroma_upsampling(spark, sf_dir):
    px = derived(spark, sf_dir)
    return resample.upsampled(resample.chroma_plane(px), pixels.sizes(px))


@register("nearest_upsampling", f"WITH {PX} SELECT image_id, y * 2 + j AS y, x * 3 + i AS x, b AS s FROM px, (VALUES (0), (1)) u(j), (VALUES (0), (1), (2)) v(i)")
def nearest_upsampling(spark, sf_dir):
    return resample.repeated(derived(spark, sf_dir).select("image_id", "y", "x", F.col("b").alias("s")), 3, 2)


NEAR_ROWS = "nb(near, dx, dy) AS (VALUES " + ", ".join(map(str, metadata.neighbours())) + ")"


@register(
    "distance_codes",
    f"""WITH {NEAR_ROWS}, d AS (SELECT p_partkey, p_size AS width, p_partkey % 400 + 1 AS distance FROM part),
t AS (SELECT width, greatest(dx + dy * width, 1) AS distance, min(near) near FROM (SELECT DISTINCT width FROM d), nb GROUP BY ALL)
SELECT d.p_partkey, d.width, d.distance, CAST(coalesce(near, d.distance + 120) AS BIGINT) AS code FROM d LEFT JOIN t ON t.width = d.width AND t.distance = d.distance""",
)
def distance_codes(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("width"), (F.col("p_partkey") % 400 + 1).alias("distance"))
    return metadata.distance_codes(d).withColumn("code", F.col("code").cast("long"))


@register(
    "png_formats",
    """SELECT p_partkey, p_size % 8 AS color_type, CAST(1 << (p_partkey % 6) AS INTEGER) AS depth, (p_size % 8 = 0 AND p_partkey % 6 < 5) OR (p_size % 8 = 3 AND p_partkey % 6 < 4)
OR (p_size % 8 IN (2, 4, 6) AND p_partkey % 6 IN (3, 4)) AS legal FROM part""",
)
def png_formats(spark, sf_dir):
    formats = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("color_type"), F.expr("CAST(shiftleft(1, CAST(p_partkey % 6 AS INT)) AS INT)").alias("depth"))
    return metadata.png_format_legal(formats)


@register(
    "profile_assembly",
    """WITH s AS (SELECT conv_id, max(turn) + 1 total, count(DISTINCT turn) n, string_agg(coalesce(text, ''), '' ORDER BY turn) t FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS path, CASE WHEN n = total THEN md5(t) END AS digest FROM s""",
)
def profile_assembly(spark, sf_dir):
    seq = F.col("turn") + 1  # each turn says that it is the last; the greatest total of a path counts. Conversations know no limit
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), seq.alias("seq"), seq.alias("total"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return metadata.assembled_profiles(parts, most=None).select("path", F.md5("profile").alias("digest"))
