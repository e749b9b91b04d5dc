"""Mode scores by block rows with a halo, and slot tables by image, against plain walks."""

import math
import random

import pytest

from rasterflow.operators import halo, slots
from tests.test_modes import scored


def test_scores_of_planes_equal_a_plain_walk(spark):
    r, rows, want = random.Random(1), [], {}
    for image, plane, size, w, h in ((1, "y", 16, 48, 64), (1, "u", 8, 24, 32), (2, "y", 16, 16, 16), (2, "v", 8, 8, 40), (3, "y", 16, 64, 16)):
        s = [[r.randrange(256) for _ in range(w)] for _ in range(h)]
        rows += [(image, plane, size, y, x, s[y][x]) for y in range(h) for x in range(w)]
        want |= {(image, plane, by, bx, m): v for (by, bx), vs in scored(s, w, h, size).items() for m, v in enumerate(vs)}
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id long, plane string, size int, y long, x long, s long").repartition(5)
    got = halo.halo_scores(df).collect()
    assert {(x.image_id, x.plane, x.mby, x.mbx, x.mode): x.sad for x in got} == want and len(got) == len(want)
    assert halo.halo_scores(df.limit(0)).collect() == []


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, "y", 16, 0, 0, 1)], "image_id long, plane string, size int, y long, x long, s long")
    plan = halo.halo_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Join" not in plan


def plain_tables(symbols, dimension):
    counts, tables = {}, {}
    for image, p, b, c, n, bit in symbols:
        if 0 <= p < 4 and 0 <= b < 8 and 0 <= c < 3 and 0 <= n < 11:
            counts.setdefault(image, {}).setdefault(p * 264 + b * 33 + c * 11 + n, [0, 0])[bit] += 1
    for image, own in counts.items():
        table, saved = [o for o, _ in dimension], 0
        for slot, (n0, n1) in own.items():
            old, odds = dimension[slot]
            p = min(max(round(256 * n0 / (n0 + n1)), 8), 247)
            bits = lambda q: -(n0 * math.log2(q / 256) + n1 * math.log2(1 - q / 256))
            if n0 + n1 >= 16 and bits(old) - bits(p) > -math.log2(1 - odds / 256) + 8 + math.log2(odds / 256) + 8:
                table[slot], saved = p, saved + bits(old) - bits(p)
        tables[image] = (table, saved)
    return tables


def test_tables_equal_a_plain_walk(spark):
    r = random.Random(2)
    dimension = [(r.randint(1, 255), r.randint(1, 255)) for _ in range(slots.SLOTS)]
    symbols = [(i, r.randrange(5), r.randrange(8) % 3, r.randrange(3), r.randrange(12), int(r.random() < (i + 1) / 5)) for i in range(4) for _ in range(8000)]
    df = spark.createDataFrame(symbols, "image_id long, plane int, band int, context int, node int, bit int")
    dim = spark.createDataFrame([(k, *v) for k, v in enumerate(dimension)] + [(-1, 5, 5), (2000, 5, 5)], "slot int, old int, odds int")
    counts = slots.image_slot_counts(df)
    updates = slots.slot_updates(counts, dim)
    images = spark.createDataFrame([(k,) for k in range(5)], "image_id long")
    got = {x.image_id: x for x in slots.image_tables(images, updates, dim).collect()}
    want = plain_tables(symbols, dimension)
    for i in range(4):
        assert got[i].probabilities == want[i][0] and got[i].saved == pytest.approx(want[i][1], abs=1e-2)
        assert got[i].updates == sum(a != b for a, (b, _) in zip(want[i][0], dimension))
    assert got[4].probabilities == [o for o, _ in dimension] and (got[4].updates, got[4].saved) == (0, 0.0)
    assert any(got[i].updates for i in range(4))
