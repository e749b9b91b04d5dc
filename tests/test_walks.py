"""Walks over files against plain walkers, on sound, broken and random files; files of many segments and long gaps."""

import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rasterflow.operators import heads, metadata, walks

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind, data, crc=0):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) ^ crc)


def ihdr(w=3, h=2, depth=8, color=2):
    return chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0))


def plain_png(b):
    """(status, chunks read)"""
    if b[:8] != SIGNATURE:
        return "not_png", 0
    at, n, head, data = 8, 0, False, False
    while at + 12 <= len(b):
        size, kind = struct.unpack(">I", b[at : at + 4])[0], b[at + 4 : at + 8]
        if size > len(b) - at - 12:
            return "truncated", n
        n += 1
        if zlib.crc32(b[at + 4 : at + 8 + size]) != struct.unpack(">I", b[at + 8 + size : at + 12 + size])[0]:
            return "bad_checksum", n
        at += 12 + size
        if kind == b"IHDR":
            if head or size != 13:
                return "bad_header", n
            head = True
        data |= kind == b"IDAT" and size > 0
        if kind == b"IEND":
            return ("ok" if data else "no_data") if head else "bad_header", n
    return ("truncated" if head else "bad_header"), n


def plain_jpeg(b):
    """(status, [(marker, at, length)])"""
    if b[:2] != b"\xff\xd8":
        return "not_jpeg", []
    at, out = 2, []
    while True:
        while at < len(b) and b[at] != 0xFF:
            at += 1
        first = at
        while at < len(b) and b[at] == 0xFF:
            first, at = at, at + 1
        if at >= len(b):
            return "truncated", out
        marker, at = b[at], at + 1
        if marker == 1 or 0xD0 <= marker <= 0xD9:
            continue
        if marker == 0xDA:
            return "ok", out
        if at + 2 > len(b) or struct.unpack(">H", b[at : at + 2])[0] < 2:
            return "truncated", out
        size = struct.unpack(">H", b[at : at + 2])[0] - 2
        out.append((f"{marker:02X}", first, size))
        at += 2 + size


def png_files():
    r, out = random.Random(1), []
    parts = [ihdr(), ihdr(), chunk(b"IDAT", b"xyz"), chunk(b"IDAT", b""), chunk(b"tRNS", b"\0\1"), chunk(b"IEND", b""), chunk(b"tEXt", b"k" * 40), chunk(b"PLTE", b"abc", 1), chunk(b"IHDR", b"short")]
    out += [SIGNATURE + ihdr() + b"".join(r.choice(parts) for _ in range(r.randint(0, 7))) + r.choice([b"", chunk(b"IEND", b""), b"\0" * 5]) for _ in range(300)]
    out += [f[: r.randint(0, len(f))] for f in out[:100]]
    for n in (63, 64, 65, 500):  # over the rounds
        body = SIGNATURE + ihdr() + chunk(b"tEXt", b"a") * n + chunk(b"IDAT", b"x")
        out += [body + chunk(b"IEND", b""), body + ihdr() + chunk(b"IEND", b""), body]
    return [*out, b"", SIGNATURE, None]


def jpeg_files():
    r, out = random.Random(2), []
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    parts = [seg(0xE0, b"JFIF"), seg(0xC0, b"\x08\0\x05\0\x07\x01"), seg(0xC4, b"\0" * 19), b"\xff\xff\xff", b"\xff\x01", b"\xff\xd0\xff\xd7", b"\0\0junk", b"\xff\0\0\x03x", b"\xff\xe1\0\x01", seg(0xFE, b"c" * 300), b"\xff\xda"]
    for _ in range(400):
        out.append(b"\xff\xd8" + b"".join(r.choice(parts[:-1] if r.random() < 0.95 else parts) for _ in range(r.randint(0, 12))) + r.choice([b"", b"\xff\xda\0\x02", b"\xff"]))
    out += [f[: r.randint(0, len(f))] for f in out[:100]]
    out += [b"\xff\xd8" + bytes(r.randrange(256) for _ in range(3000)) for _ in range(30)]
    out += [b"\xff\xd8" + seg(0xE5, b"") * 300 + b"\xff\xda", b"\xff\xd8" + b"\0" * (walks.WINDOW - 3) + seg(0xC2, b"x"), b"\xff\xd8" + b"\0" * (walks.WINDOW - 2) + seg(0xC2, b"x") + b"\xff\xda", b"\xff\xd8" + b"\xff" * 40_000 + b"\xda"]
    return [*out, b"", b"\xff\xd8", None]


def frame(spark, files):
    return spark.createDataFrame(list(enumerate(files)), "path long, content binary").repartition(4)


def test_png_chunks_equal_a_plain_walk(spark):
    files = png_files()
    got = walks.file_facts(walks.walked(frame(spark, files), ("png",))).collect()
    assert {r.path: (r.status, r.n_parts) for r in got} == {i: plain_png(b or b"") for i, b in enumerate(files)}


def test_jpeg_segments_equal_a_plain_walk(spark):
    files = jpeg_files()
    walk = walks.walked(frame(spark, files), ("jpeg",))
    found = {}
    for r in walks.segments(walk).orderBy("path", "place").collect():
        found.setdefault(r.path, []).append((r["name"], r["at"], r["length"]))
    want = {i: plain_jpeg(b or b"") for i, b in enumerate(files)}
    assert {r.path: r.status for r in walks.file_facts(walk).collect()} == {i: s for i, (s, _) in want.items()}
    assert found == {i: p for i, (_, p) in want.items() if p}


def test_five_megabytes_without_a_scan_end_in_seconds(spark):
    r = random.Random(3)
    noise = bytes(r.choices(range(256), k=5_000_000))
    files = [b"\xff\xd8" + noise, b"\xff\xd8" + bytes(5_000_000), b"\xff\xd8" + b"\xff" * 5_000_000, SIGNATURE + ihdr() + chunk(b"IDAT", b"z" * 8000) * 600 + chunk(b"IEND", b"")]
    made = frame(spark, files).withColumn("kind", F.when(F.col("path") == 3, "png").otherwise("jpeg"))
    began = time.time()
    got = {r.path: (r.status, r.n_parts) for r in walks.file_facts(walks.walked(made, ("jpeg", "png"), kind=F.col("kind"))).collect()}
    assert time.time() - began < 40
    want = plain_jpeg(files[0])
    assert got == {0: (want[0], len(want[1])), 1: ("truncated", 0), 2: ("truncated", 0), 3: ("ok", 602)}


def plain_bmp(b):
    """status, width, height, offset, stride, alpha"""
    u = lambda at, n: int.from_bytes(b[at : at + n], "little")
    if len(b) < 26 or b[:2] != b"BM":
        return ("not_bmp",)
    size = u(14, 4)
    if size not in (12, 40, 52, 56, 108, 124) or len(b) < 14 + size:
        return ("bad_header",)
    if size == 12:
        w, h, bits, packing = u(18, 2), u(20, 2), u(24, 2), 0
    else:
        w, h = struct.unpack("<ii", b[18:26])
        bits, packing = u(28, 2), u(30, 4)
    masks = [u(54 + 4 * i, 4) if size >= (52, 52, 52, 56)[i] else 0 for i in range(4)]
    if not (0 < w <= 16384 and 0 < abs(h) <= 16384 and w * abs(h) <= 40_000_000):
        return ("bad_size",)
    if bits not in (1, 4, 8, 16, 24, 32):
        return ("bad_depth",)
    start = 14 + size
    if packing in (3, 6) and not any(masks):
        n = 4 if packing == 6 else 3
        if len(b) < start + 4 * n:
            return ("bad_masks",)
        masks[:n] = [u(start + 4 * i, 4) for i in range(n)]
        start += 4 * n
    if packing == 0 or bits == 24:
        masks = [0, 0, 0, 0]
    offset = max(u(10, 4), start)
    if offset > len(b):
        return ("bad_offset",)
    if (packing == 1 and bits != 8) or (packing == 2 and bits != 4):
        return ("bad_depth",)
    if packing not in (0, 1, 2, 3, 6):
        return ("bad_compression",)
    stride = 0 if packing in (1, 2) else (w * bits + 31) // 32 * 4
    if stride and len(b) - offset < stride * abs(h):
        return ("truncated",)
    return "ok", w, abs(h), offset, stride, bits in (16, 32) and masks[3] != 0 and masks[3] >> bits == 0


def test_bmp_headers_equal_plain_rules(spark):
    r, files = random.Random(4), []
    for _ in range(3000):
        size = r.choice([12, 12, 40, 40, 40, 52, 56, 108, 124, 13, 64])
        w, h = r.choice([0, 1, 2, 5, 16384, 16385, -1]), r.choice([0, 1, 3, -3, -16384, 2500])
        bits, packing = r.choice([1, 4, 8, 16, 24, 32, 7]), r.choice([0, 0, 0, 1, 2, 3, 6, 4])
        if size == 12:
            body = struct.pack("<IHHHH", 12, w % 65536, h % 65536, 1, bits)
        else:
            body = struct.pack("<IiiHHI", size, w, h, 1, bits, packing) + bytes(16) + struct.pack("<I", 0)
            body += bytes(r.choice([0, 0, 0, 1, 255]) for _ in range(max(0, size - 40)))
        tail = bytes(r.choice([0, 255]) for _ in range(r.choice([0, 3, 12, 16, 40, 200])))
        files.append(b"BM" + bytes(8) + struct.pack("<I", r.choice([0, 26, 54, 70, 100, 9999])) + body + tail)
    files += [b"", b"BM", b"BM" + bytes(30), b"PM" + bytes(60), files[0][:25], files[1][:40]]
    for head in (F.col("content"), F.substring("content", 1, 160)):
        got = frame(spark, files).select("path", walks.bmp_header(head, F.octet_length("content")).alias("h")).collect()
        for x in got:
            want, h = plain_bmp(files[x.path]), x.h
            assert h.status == want[0], (files[x.path], want)
            if want[0] == "ok":
                assert (h.status, h.width, h.height, h.offset, h.stride, h.alpha) == want, files[x.path]


def test_bmp_profiles_are_offered_at_both_offsets(spark):
    body = bytearray(struct.pack("<IiiHHI", 124, 1, 1, 1, 24, 0) + bytes(104))
    body[56:60], body[112:120] = b"DEBM", struct.pack("<II", 150, 132)
    file = b"BM" + bytes(8) + struct.pack("<I", 138) + bytes(body) + bytes(4 + 160)
    h = frame(spark, [file]).select(walks.bmp_header(F.col("content")).alias("h")).first().h
    assert [(p["at"], p["length"]) for p in h.profiles] == [(164, 132), (150, 132)] and h.status == "ok"


def test_heads_know_sizes_keys_and_profiles(spark):
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    icc = lambda s, n, d: seg(0xE2, b"ICC_PROFILE\0" + bytes([s, n]) + d)
    jpeg = b"\xff\xd8" + seg(0xE0, b"JFIF\0")
    files = {
        1: jpeg + icc(2, 2, b"old") + icc(1, 2, b"one") + icc(2, 2, b"2") + seg(0xC1, b"\x08\x01\0\x02\0\x03") + b"\xff\xda",  # the later part counts
        2: jpeg + icc(1, 3, b"a") + icc(3, 3, b"c") + icc(1, 2, b"b") + seg(0xC0, b"\x08\0\x05\0\x07\x03"),  # two numbers, and the last total is two
        3: jpeg + icc(1, 3, b"a") + seg(0xC0, b"\x08\0\x05\0\x07\x03") + b"\xff\xda",
        4: jpeg + b"\xff\xda",
        5: SIGNATURE + ihdr(9, 4, 16, 0) + chunk(b"tRNS", b"\x12\x34") + chunk(b"IDAT", b""),
        6: SIGNATURE + ihdr(9, 4, 8, 3) + chunk(b"IDAT", b"") + chunk(b"tRNS", b"\x12\x34"),  # behind the picture: not seen
        7: SIGNATURE + chunk(b"tEXt", b"") + ihdr(),
        8: None,
        9: SIGNATURE + ihdr(9, 4, 8, 6),
    }
    made = spark.createDataFrame(list(files.items()), "path long, content binary")
    got = {r.path: r for r in heads.file_heads(made, "flatten").collect()}
    facts = {k: (r.head.status, r.head.width, r.head.height, r.head.alpha_status, r.key_levels, r.profile and bytes(r.profile), r.description) for k, r in got.items()}
    assert facts == {
        1: ("ok", 512, 256, "none", None, b"one2", "jpeg icc 4B"), 2: ("ok", 7, 5, "none", None, b"bc", "jpeg icc 2B"), 3: ("ok", 7, 5, "none", None, None, "jpeg"), 4: ("error", None, None, None, None, None, None),
        5: ("ok", 9, 4, "flattened", [0x12], None, "png/ct0/bd16 trns(key)"), 6: ("ok", 9, 4, "none", None, None, "png/ct3/bd8"), 7: ("error", None, None, None, None, None, None), 8: ("error", None, None, None, None, None, None),
        9: ("ok", 9, 4, "flattened", None, None, "png/ct6/bd8"),
    }


@pytest.mark.parametrize("kind", list(walks.WALKS))
def test_no_files(spark, kind):
    assert walks.file_facts(walks.walked(frame(spark, [b""]).where("path > 0"), (kind,))).collect() == []
    assert metadata.assembled_profiles(walks.profile_parts(walks.walked(frame(spark, [b""]), (kind,))), place="place").collect() == []
