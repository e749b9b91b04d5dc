"""Mixed scanline filters against a plain walk."""

import random

from rasterflow.operators.scanlines import unfiltered

SCHEMA = "image_id long, y long, filter int, channels int, data binary"


def plain(rows, channels):
    out, before = {}, None
    for y, kind, data in rows:
        line = []
        for k, v in enumerate(data):
            left = line[k - channels] if k >= channels else 0
            up = before[k] if before else 0
            line.append((v + (0, left, up)[kind]) & 255)
        out |= {(y, k): v for k, v in enumerate(line)}
        before = line
    return out


def test_any_mix_of_none_sub_and_up(spark):
    r, rows, want = random.Random(1), [], {}
    for i in range(40):
        channels, width = r.choice([1, 2, 3, 4, 6, 8]), r.randint(1, 9)
        kinds = r.choice([(0, 1, 2), (2,), (1, 2, 2, 2), (0, 2), (1,)])
        own = [(y, r.choice(kinds), bytes(r.randrange(256) for _ in range(channels * width))) for y in range(r.randint(1, 20))]
        want |= {(i, *at): v for at, v in plain(own, channels).items()}
        rows += [(i, y, f, channels, d) for y, f, d in own]
    rows += [(90, 0, 0, 3, b"abc"), (90, 1, 4, 3, b"abc"), (91, 0, None, 3, b"abc"), (92, 0, 1, 3, b""), (92, 1, 2, 3, None), (93, 0, 1, 3, b"\xff\x01\x02\x03")]
    want |= {(93, 0, k): v for k, v in enumerate([255, 1, 2, 2])}
    r.shuffle(rows)
    got, verdicts = unfiltered(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert {(x.image_id, x.y, x.k): x.v for x in got.collect()} == want
    told = {x.image_id: x.status for x in verdicts.collect()}
    assert told == {**dict.fromkeys(range(40), "ok"), 90: "serial", 91: "serial", 92: "ok", 93: "ok"}


def test_no_rows(spark):
    got, verdicts = unfiltered(spark.createDataFrame([], SCHEMA))
    assert got.collect() == verdicts.collect() == []
