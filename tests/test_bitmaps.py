"""Bitmaps of all depths, masks, palettes and run lengths against a plain reader; broken files have a status and no pixels."""

import random
import struct

from rasterflow.sources.bitmaps import bmp_pixels


def widened(value, mask):
    if mask == 0:
        return 0
    shift = (mask & -mask).bit_length() - 1
    return (((value & mask) >> shift) * 255 + ((mask >> shift) >> 1)) // (mask >> shift)


def file(w, h, bits, rows, *, packing=0, masks=(), head=40, top_down=False, palette=(), gap=0, used=0):
    """A file of stored rows (bytes); masks lie in the header where it has room, else behind it."""
    if head == 12:
        info, entry = struct.pack("<IHHHH", 12, w, h, 1, bits), 3
    else:
        info, entry = struct.pack("<IiiHHIIIIII", head, w, -h if top_down else h, 1, bits, packing, 0, 0, 0, used, 0), 4
        info += struct.pack(f"<{len(masks)}I", *masks)
        info += bytes(max(0, head - len(info)))
    colours = b"".join(bytes(reversed(c)) + bytes(entry - 3) for c in palette)
    at = 14 + len(info) + len(colours) + gap
    return b"BM" + bytes(8) + struct.pack("<I", at) + info + colours + bytes(gap) + b"".join(rows)


def stored(samples, bits):
    """A row of samples, padded to four bytes."""
    if bits < 8:
        text = "".join(f"{s:0{bits}b}" for s in samples)
        text += "0" * (-len(text) % 8)
        row = bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))
    else:
        row = b"".join(s.to_bytes(bits // 8, "little") for s in samples)
    return row + bytes(-len(row) % 4)


def coded(r, rows, nibbles):
    """Rows as runs and literal stretches of random length; a row may stop early, its rest being 0."""
    out = b""
    for row in rows:
        k = 0
        while k < len(row):
            n = min(r.randint(3, 9), len(row) - k)
            part = row[k : k + n]
            if n < 3 or len(set(part)) == 1:
                n = 1 if len(set(part)) > 1 else n
                out += bytes([n, part[0] * 16 + part[0] if nibbles else part[0]])
            else:
                data = bytes(a * 16 + b for a, b in zip(part[::2], [*part[1::2], 0])) if nibbles else bytes(part)
                out += bytes([0, n]) + data + bytes(len(data) % 2)
            k += n
        out += b"\0\0"
    return out + b"\0\1"


def drawn():
    r, files, want = random.Random(11), {}, {}

    def add(name, content, px, top_down):
        files[name] = content
        px = px if top_down else px[::-1]
        want[name] = {(y, x): p for y, row in enumerate(px) for x, p in enumerate(row)}

    colours = [tuple(r.randrange(256) for _ in range(3)) for _ in range(256)]
    for k in range(40):
        w, h, top = r.randint(1, 23), r.randint(1, 9), r.random() < 0.5
        kind = ("index", "masks", "plain", "runs")[k % 4]
        if kind == "index":
            bits, core = r.choice((1, 4, 8)), k % 8 == 0
            n = 2**bits if core else r.choice((1, 2, 2**bits))
            have = min(n, r.choice((n, 1)))  # fewer are stored than are claimed
            s = [[r.randrange(2**bits) for _ in range(w)] for _ in range(h)]
            px = [[(*(colours[v] if v < have else (0, 0, 0)), 255) for v in row] for row in s]
            content = file(w, h, bits, [stored(row, bits) for row in s], head=12 if core else 40, top_down=top, palette=colours[:have], used=n)
            add(f"index{k}", content, px, top and not core)
        elif kind == "masks":
            bits = r.choice((16, 32))
            masks = r.choice([(0xF800, 0x7E0, 0x1F, 0), (0xF00, 0xF0, 0xF, 0xF000), (0x7C00, 0x3E0, 0x1F, 0x8000)] if bits == 16 else [(0xFF, 0xFF00, 0xFF0000, 0xFF000000), (0x3FF, 0xFFC00, 0x3FF00000, 0xC0000000), (0xFF000000, 0xFF0000, 0xFF00, 0), (0x1, 0, 0x80000000, 0)])
            head = r.choice((40, 52, 56, 108))
            packing = 6 if head == 40 else 3
            masks = masks if head != 52 else (*masks[:3],)
            s = [[r.randrange(2**bits) for _ in range(w)] for _ in range(h)]
            alpha = masks[3] if len(masks) > 3 else 0
            px = [[(*(widened(v, m) for m in masks[:3]), widened(v, alpha) if alpha else 255) for v in row] for row in s]
            add(f"masks{k}", file(w, h, bits, [stored(row, bits) for row in s], packing=packing, masks=masks, head=head, top_down=top, gap=r.choice((0, 6))), px, top)
        elif kind == "plain":
            bits = r.choice((16, 24, 32))
            masks = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
            s = [[r.randrange(2**bits) for _ in range(w)] for _ in range(h)]
            add(f"plain{k}", file(w, h, bits, [stored(row, bits) for row in s], top_down=top), [[(*(widened(v, m) for m in masks), 255) for v in row] for row in s], top)
        else:
            bits = r.choice((4, 8))
            s = [[v for v in [r.randrange(2**bits) for _ in range(w)] for _ in range(r.randint(1, 4))][: w + r.randint(-3, 3) if w > 3 else w] for _ in range(h)]
            px = [[(*colours[v], 255) for v in [*row, *[0] * w][:w]] for row in s]
            content = file(w, h, bits, [coded(r, s, bits == 4)], packing=1 if bits == 8 else 2, palette=colours[: 2**bits], top_down=top)
            add(f"runs{k}", content, px, top)
    return files, want


def test_bitmaps_equal_a_plain_reader(spark):
    files, want = drawn()
    px, told = bmp_pixels(spark.createDataFrame(list(files.items()), "path string, content binary").repartition(4))
    assert {x.path: x.status for x in told.collect()} == dict.fromkeys(files, "ok")
    got = {}
    for x in px.collect():
        assert (x.y, x.x) not in got.setdefault(x.path, {})
        got[x.path][x.y, x.x] = (x.r, x.g, x.b, x.a)
    assert {k for k in want if got.get(k) != want[k]} == set() and got.keys() == want.keys()


def test_long_streams_and_skipped_places(spark):
    """A stream over many chunks, with steps over places and lines, and rows outside the image."""
    w, h, colours = 300, 200, [(i, 255 - i, i ^ 85) for i in range(256)]
    body, want = b"", {}
    for y in range(h):
        if y % 5 == 4:
            body += b"\0\2\0\1"  # a line down, nothing written
            continue
        body += b"\0\2\7\0" + b"".join(bytes([1, (x * y) % 256]) for x in range(7, 290)) + b"\0\0"
        want |= {(h - 1 - y, x): (x * y) % 256 for x in range(7, 290)}
    body += bytes([9, 9]) + b"\0\1"
    px, told = bmp_pixels(spark.createDataFrame([("a", file(w, h, 8, [body], packing=1, palette=colours))], "path string, content binary"))
    assert told.first().status == "ok"
    got = {(x.y, x.x): (x.r, x.g, x.b) for x in px.collect()}
    assert len(got) == w * h and all(got[y, x] == colours[want.get((y, x), 0)] for y in range(h) for x in range(w))


def test_broken_bitmaps_have_a_status(spark):
    row = stored([1, 2, 3], 8)
    good = file(3, 1, 8, [row], palette=[(1, 2, 3)] * 4, used=4)
    files = {
        "truncated": good[:-1], "not_bmp": b"no", "bad_depth": file(3, 1, 7, [row]), "bad_compression": file(3, 1, 8, [row], packing=4), "bad_header": good[:14] + b"\x0d" + good[15:],
        "bad_size": file(0, 1, 8, [row]), "bad_masks": file(3, 1, 16, [], packing=3)[:60], "cut": file(3, 1, 8, [b"\3\1"], packing=1), "empty": b"", "null": None,
    }
    px, told = bmp_pixels(spark.createDataFrame(list(files.items()), "path string, content binary"))
    named = {x.path: x.status for x in told.collect()}
    assert named == {**{k: k for k in files}, "cut": "truncated", "empty": "not_bmp", "null": "not_bmp"} and px.collect() == []
    nothing = spark.createDataFrame([], "path string, content binary")
    assert [d.collect() for d in bmp_pixels(nothing)] == [[], []]
