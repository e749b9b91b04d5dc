"""Synthetic files: heads by content, exact-length raw input, pixels by the built-in decoder, containers, streams."""

import struct
import zlib

from pyspark.sql import functions as F

from rasterflow.operators import blocks, container, pixels
from rasterflow.sources import files
from rasterflow.streaming import bands


def png(w, h, rgb):
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + rgb[y * w * 3 : (y + 1) * w * 3] for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def bmp(w, h, rgb):
    stride = -(-w * 3 // 4) * 4
    body = b"".join(b"".join(rgb[(y * w + x) * 3 : (y * w + x) * 3 + 3][::-1] for x in range(w)).ljust(stride, b"\0") for y in reversed(range(h)))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_heads_and_pixels(spark, tmp_path):
    w, h = 5, 3
    rgb = bytes((7 * k) % 256 for k in range(w * h * 3))
    webp = lambda kind, body: b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body
    made = {
        "a.webp": png(w, h, rgb),  # content decides, not the name
        "b.bmp": bmp(w, h, rgb),
        "c.jpg": webp(b"VP8X", b"\x10\0\0\0" + b"\x3f\0\0" + b"\x0f\0\0"),
        "d": webp(b"VP8L", b"\x2f" + struct.pack("<I", 95 | 63 << 14)),
        "e": webp(b"VP8 ", b"\x10\x02\x00\x9d\x01\x2a" + struct.pack("<HH", 320, 240)),
        "f": b"RIFF1234WAVE",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.head for r in files.heads(spark, f"file://{tmp_path}").collect()}
    facts = {k: (v.type, v.width, v.height, v.status) for k, v in got.items()}
    assert facts == {
        "a.webp": ("png", 5, 3, "ok"), "b.bmp": ("bmp", 5, 3, "ok"), "c.jpg": ("webp", 64, 16, "skipped_webp"), "d": ("webp", 96, 64, "skipped_webp"),
        "e": ("webp", 320, 240, "skipped_webp"), "f": (None, None, None, "error"),
    }
    out = files.pixels(files.decoded(spark, f"file://{tmp_path}")).collect()
    for name in ("a.webp", "b.bmp"):
        own = sorted((r.y, r.x, r.r, r.g, r.b) for r in out if r.path.endswith(name))
        assert own == [(k // w, k % w, *rgb[3 * k : 3 * k + 3]) for k in range(w * h)]


def test_raw_input_needs_its_exact_length(spark, tmp_path):
    (tmp_path / "good").write_bytes(bytes(12))
    (tmp_path / "short").write_bytes(bytes(11))
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.content and len(r.content)) for r in files.raw_rgb(spark, f"file://{tmp_path}", 2, 2).collect()}
    assert got == {"good": ("ok", 12), "short": ("error", None)}


def test_container_chunks(spark):
    row = spark.range(1).select(
        container.webp(F.lit(b"abc"), F.lit(96), F.lit(64), F.lit(b"\x01\x02"), F.lit(b"p")).alias("full"),
        container.webp(F.lit(b"abcd"), F.lit(96), F.lit(64), F.lit(None).cast("binary"), F.lit(None).cast("binary")).alias("plain"),
        container.frame_tag(F.lit(1000)).alias("tag"), container.frame_tag(F.lit(1 << 19)).alias("none"),
    ).first()
    data, names, at = bytes(row.full), [], 12
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    while at < len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        names.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    assert names == [(b"VP8X", b"\x30\0\0\0\x5f\0\0\x3f\0\0"), (b"ICCP", b"p"), (b"ALPH", b"\x01\x02"), (b"VP8 ", b"abc")]
    assert bytes(row.plain) == b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"
    assert bytes(row.tag) == (1000 * 32 + 16).to_bytes(3, "little") and row.none is None


def test_odd_sizes_repeat_their_edge(spark):
    px = spark.createDataFrame([(1, y, x, 10 * x, 20 * y, 7, 255) for y in range(3) for x in range(5)], "image_id long, y long, x long, r long, g long, b long, a long")
    at = {(y, x): (10 * min(x, 4), 20 * min(y, 2), 7) for y in range(4) for x in range(6)}
    want = {}
    for cy in range(2):
        for cx in range(3):
            four = [at[2 * cy + j, 2 * cx + i] for j in (0, 1) for i in (0, 1)]
            u, v = (sum(sum(k * c for k, c in zip(ks, p)) for p in four) for ks in ((-9719, -19081, 28800), (28800, -24116, -4684)))
            want[cy, cx] = tuple(min(max((((s + 2) >> 2) + (128 << 16) + 32768) >> 16, 0), 255) for s in (u, v))
    assert {(r.cy, r.cx): (r.u, r.v) for r in pixels.chroma(px).collect()} == want
    grown = pixels.padded(px.select("image_id", "y", "x", F.col("r").alias("s")), 8)
    assert {(r.y, r.x): r.s for r in grown.collect()} == {(y, x): 10 * min(x, 4) for y in range(8) for x in range(8)}


def test_band_reads_prune_and_streams_agree(spark, tmp_path):
    rows = spark.createDataFrame([(i, p, y, bytes([i, y])) for i in range(3) for p in "yu" for y in range(32)], "image_id int, plane string, row int, samples binary")
    files.stage_planes(rows, f"file://{tmp_path}/planes")
    got = files.band(spark, f"file://{tmp_path}/planes", 16, 4)
    assert {(r.image_id, r.plane, r.row) for r in got.collect()} == {(i, p, y) for i in range(3) for p in "yu" for y in range(16, 20)}
    px = pixels.embedding_pixels(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    px.write.parquet(f"file://{tmp_path}/px")
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/px")
    query = bands.running_block_stats(stream).writeStream.outputMode("complete").format("memory").queryName("blocks").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("blocks").collect())) == sorted(map(str, blocks.macroblock_stats(px).collect()))
