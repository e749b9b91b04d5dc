"""Images of all PNG formats, JPEG, BMP and WebP files by the reader that fits, against what was drawn."""

import random
import struct
import zlib

import pytest

from rasterflow.operators.metadata import PNG_DEPTHS
from rasterflow.sources.images import png_pixels, read_images
from tests.test_files import bmp

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def packed_rows(px, w, depth, n):
    """Rows of samples as bytes."""
    out = []
    for row in px:
        flat = [s for p in row for s in p]
        bits = "".join(f"{s:0{depth}b}" for s in flat)
        bits += "0" * (-len(bits) % 8)
        out.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)))
    return out


def filtered(rows, bpp, kinds):
    out, before = b"", bytes(len(rows[0])) if rows else b""
    for row, f in zip(rows, kinds):
        left = bytes(bpp) + row[:-bpp] if len(row) > bpp else bytes(len(row))
        guess = {0: bytes(len(row)), 1: left[: len(row)], 2: before, 3: bytes((a + b) // 2 for a, b in zip(left, before))}[f]
        out += bytes([f]) + bytes((a - b) & 255 for a, b in zip(row, guess))
        before = row
    return out


def make(r, kind, depth, w, h, filters=(0, 1, 2), clear=None, palette=None, interlaced=0, cut=0):
    n, top = CHANNELS[kind], 2**depth if kind != 3 else min(2**depth, len(palette))
    px = [[[r.randrange(top) for _ in range(n)] for _ in range(w)] for _ in range(h)]
    if clear is not None and kind in (0, 2):
        px[0][0] = list(clear)
    passes = [(0, 0, 1, 1)] if not interlaced else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    raw = b""
    for x0, y0, dx, dy in passes:
        rows = packed_rows([line[x0::dx] for line in px[y0::dy] if line[x0::dx]], w, depth, n)
        raw += filtered(rows, max(1, n * depth // 8), [r.choice(filters) for _ in rows])
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced))
    if palette:
        body += chunk(b"PLTE", bytes(c for p in palette for c in p))
    if clear is not None:
        body += chunk(b"tRNS", bytes(clear) if kind == 3 else struct.pack(f">{len(clear)}H", *clear))
    data = zlib.compress(raw)
    data = data[: len(data) - cut]
    body += chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:])
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IEND", b""), px


def shown(px, kind, depth, clear, palette):
    level = lambda s: s >> 8 if depth == 16 else s * (255 // (2**depth - 1))
    out = {}
    for y, row in enumerate(px):
        for x, p in enumerate(row):
            if kind == 3:
                out[y, x] = (*palette[p[0]], clear[p[0]] if clear and p[0] < len(clear) else 255)
            else:
                c = [level(s) for s in p]
                a = c[-1] if kind in (4, 6) else 0 if clear is not None and list(clear) == p else 255
                out[y, x] = (*(c[:3] if kind in (2, 6) else [c[0]] * 3), a)
    return out


@pytest.fixture(scope="module")
def drawn():
    r, files, want = random.Random(5), {}, {}
    palette = [tuple(r.randrange(256) for _ in range(3)) for _ in range(11)]
    for kind, depths in PNG_DEPTHS.items():
        for depth in depths:
            for k in range(2):
                w, h = r.randint(1, 19), r.randint(1, 9)
                own = palette[: 2**depth] if kind == 3 else None
                clear = None if k == 0 or kind in (4, 6) else [0, 128] if kind == 3 else [r.randrange(2**depth) for _ in range(CHANNELS[kind])]
                name = f"c{kind}d{depth}k{k}.png"
                files[name], px = make(r, kind, depth, w, h, (0, 1, 2), clear, own)
                want[name] = shown(px, kind, depth, clear, own)
    return files, want


def test_all_png_formats(spark, drawn):
    files, want = drawn
    px, told = png_pixels(spark.createDataFrame(list(files.items()), "path string, content binary").repartition(4))
    assert {x.path: x.status for x in told.collect()} == dict.fromkeys(files, "ok")
    got = {}
    for x in px.collect():
        got.setdefault(x.path, {})[x.y, x.x] = (x.r, x.g, x.b, x.a)
    assert got == want


def test_broken_png_files_have_a_status(spark):
    r = random.Random(6)
    good = make(r, 2, 8, 4, 3)[0]
    files = {
        "serial": make(r, 2, 8, 9, 4, (3,))[0], "interlaced": make(r, 2, 8, 9, 9, interlaced=1)[0], "bad_data": make(r, 2, 8, 30, 9, cut=12)[0], "truncated": good[:-12], "not_png": b"no",
        "bad_index": make(r, 3, 8, 9, 9, (0,), None, [(1, 2, 3)])[0].replace(b"", b"", 0), "bad_format": good[:24] + b"\x07" + good[25:],
    }
    # an index beyond a palette of one colour
    raw = zlib.compress(b"\0\5")
    files["bad_index"] = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 3, 0, 0, 0)) + chunk(b"PLTE", b"abc") + chunk(b"IDAT", raw) + chunk(b"IEND", b"")
    head = struct.pack(">IIBBBBB", 4, 3, 7, 2, 0, 0, 0)
    files["bad_format"] = good[:8] + chunk(b"IHDR", head) + good[33:]
    px, told = png_pixels(spark.createDataFrame(list(files.items()), "path string, content binary"))
    assert {x.path: x.status for x in told.collect()} == {k: k for k in files} and px.collect() == []


def test_files_of_mixed_types(spark, tmp_path, drawn):
    files, want = drawn
    r = random.Random(7)
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["c0d16k1.png", "c2d16k1.png", "c3d4k1.png", "c6d8k0.png"]
    made = {n: files[n] for n in names}
    made["serial.png"], serial = make(r, 2, 8, 6, 5, (3,))
    made["seven.png"], seven = make(r, 6, 8, 11, 13, interlaced=1)
    rgb = bytes(r.randrange(256) for _ in range(5 * 3 * 3))
    made["b.bmp"] = bmp(5, 3, rgb)
    made["w.webp"] = b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes(10)
    made["broken.png"], made["text"] = make(r, 2, 8, 40, 9, cut=12)[0], b"hello"
    for n, data in made.items():
        (folder / n).write_bytes(data)
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(8):
        for x in range(16):
            picture.setRGB(x, y, 0x4080C0)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(folder / "p.jpg")))
    expected = spark.createDataFrame([(f"file:{folder}/c6d8k0.png", 99, None)], "path string, width int, height int")
    px, report = read_images(spark, f"file://{folder}", expected=expected)
    told = {x.path.rsplit("/", 1)[1]: (x.type, x.reader, x.status) for x in report.collect()}
    assert told == {
        "c0d16k1.png": ("png", "own", "ok"), "c2d16k1.png": ("png", "own", "ok"), "c3d4k1.png": ("png", "own", "ok"), "c6d8k0.png": ("png", None, "unexpected"), "serial.png": ("png", "built-in", "ok"),
        "seven.png": ("png", "built-in", "ok"), "b.bmp": ("bmp", "own", "ok"), "p.jpg": ("jpeg", "built-in", "ok"), "w.webp": ("webp", None, "skipped_webp"), "broken.png": ("png", None, "error"), "text": (None, None, "error"),
    }
    got = {}
    for x in px.collect():
        got.setdefault(x.path.rsplit("/", 1)[1], {})[x.y, x.x] = (x.r, x.g, x.b, x.a)
    assert {n: got.get(n) for n in names[:3]} == {n: want[n] for n in names[:3]} and "c6d8k0.png" not in got
    assert got["serial.png"] == shown(serial, 2, 8, None, None) and got["seven.png"] == shown(seven, 6, 8, None, None)
    assert got["b.bmp"] == {(k // 5, k % 5): (*rgb[3 * k : 3 * k + 3], 255) for k in range(15)}
    assert len(got["p.jpg"]) == 128 and all(abs(a - b) < 12 for p in got["p.jpg"].values() for a, b in zip(p, (0x40, 0x80, 0xC0, 255)))
