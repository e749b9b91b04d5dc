"""Run-length streams against a plain walk: absolute runs, deltas, line ends, truncation, across chunks of any size."""

import random

import pytest

from rasterflow.operators.rle import rle_pixels, rle_runs


def plain(data, w, h, top_down, nibbles):
    """(status, pixels written by place)"""
    out, x, y, at = {}, 0, 0, 0

    def plot(v):
        nonlocal x
        if x < w and y < h:
            out[(y if top_down else h - 1 - y), x] = v
        x += 1

    while at + 2 <= len(data):
        a, b = data[at], data[at + 1]
        at += 2
        if a:
            for i in range(a):
                plot((b >> 4 if i % 2 == 0 else b & 15) if nibbles else b)
        elif b == 0:
            x, y = 0, y + 1
        elif b == 1:
            return "ok", out
        elif b == 2:
            if at + 2 > len(data):
                break
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = (b + 1) // 2 if nibbles else b
            samples = [s for v in data[at : at + size] for s in ((v >> 4, v & 15) if nibbles else (v,))][:b]
            if at + size + size % 2 > len(data):
                return "truncated", None
            for s in samples:
                plot(s)
            at += size + size % 2
    return "truncated", None


def stream(r, nibbles):
    out = b""
    for _ in range(r.randint(0, 40)):
        k = r.random()
        if k < 0.4:
            out += bytes([r.randint(1, 255 if r.random() < 0.1 else 20), r.randrange(256)])
        elif k < 0.6:
            out += b"\0\0"
        elif k < 0.75:
            out += b"\0\2" + bytes([r.randrange(9), r.randrange(3)])
        else:
            n = r.choice([3, 4, 5, 6, 7, 9, 16, 255])
            size = (n + 1) // 2 if nibbles else n
            out += bytes([0, n]) + bytes(r.choice([0, 0, 1, 2, r.randrange(256)]) for _ in range(size)) + b"\0" * (size % 2)
    out += r.choice([b"\0\1", b"\0\1", b"\0\1", b"\0\1junk", b"\0", b"", b"\0\2\1"])
    return out if r.random() < 0.8 else out[: r.randint(0, len(out))]


@pytest.mark.parametrize("words", [1, 2, 5, 64, 4096])
def test_runs_equal_a_plain_walk(spark, words):
    r = random.Random(words)
    made = []
    for i in range(150):
        nibbles = r.random() < 0.5
        made.append((i, stream(r, nibbles), nibbles, r.randint(1, 60), r.randint(1, 12), r.random() < 0.5))
    made += [(900, b"", False, 3, 3, True), (901, None, True, 3, 3, True), (902, b"\0\1", False, 3, 3, True), (903, b"\0", False, 1, 1, False)]
    df = spark.createDataFrame(made, "image_id long, data binary, nibbles boolean, w long, h long, top_down boolean").repartition(3)
    runs, verdicts = rle_runs(df.select("image_id", "data", "nibbles"), words)
    got, told = {}, {x.image_id: x.status for x in verdicts.collect()}
    for x in rle_pixels(runs, df.select("image_id", "w", "h", "top_down")).collect():
        assert (x.y, x.x) not in got.setdefault(x.image_id, {})
        got[x.image_id][x.y, x.x] = x.level
    for i, data, nibbles, w, h, top_down in made:
        status, want = plain(data or b"", w, h, top_down, nibbles)
        assert told[i] == status, (i, data)
        if want is not None:
            assert got.get(i, {}) == want, (i, nibbles, data)
