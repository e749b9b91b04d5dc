"""Decode tables of table segments against a plain table builder."""

import random

from pyspark.sql import functions as F

from rasterflow.operators import huffman


def plain(counts, symbols):
    """(codes, prefix table)"""
    codes, code, k = [], 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            codes.append((length, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    fast = {p: (n, s) for n, c, s in codes if n <= 8 for p in range(c << (8 - n), (c + 1) << (8 - n))}
    return codes, fast


def random_table(r):
    counts, left = [], 1
    for length in range(1, 17):
        left *= 2
        n = r.randint(0, min(left, 12)) if length > 2 else r.randint(0, min(left - 1, 1))
        counts.append(n)
        left -= n
    return counts, [r.randrange(256) for _ in range(sum(counts))]


def test_tables_equal_a_plain_builder(spark):
    r, rows, want = random.Random(1), [], {}
    for path in range(60):
        for place in range(r.randint(1, 3)):
            data = b""
            for _ in range(r.randint(1, 4)):
                kind, number = r.randrange(2), r.randrange(4)
                counts, symbols = random_table(r)
                data += bytes([kind << 4 | number, *counts, *symbols])
                want[path, kind, number] = (counts, symbols)
            rows.append((path, place, data))
    r.shuffle(rows)
    codes = huffman.table_codes(huffman.table_definitions(spark.createDataFrame(rows, "path long, place long, data binary").repartition(4))).cache()
    found, quick = {}, {}
    for x in codes.collect():
        found.setdefault((x.path, x["class"], x.id), []).append((x.length, x.code, x.symbol))
    for x in huffman.prefix_table(codes).collect():
        quick.setdefault((x.path, x["class"], x.id), {})[x.prefix] = (x.length, x.symbol)
    for k, v in want.items():
        codes_, fast = plain(*v)
        assert sorted(found.get(k, [])) == codes_ and quick.get(k, {}) == fast
    ends = {(x.path, x["class"], x.id, x.length): (x.low, x.high) for x in huffman.long_codes(codes).collect()}
    for k, v in want.items():
        for n in range(9, 17):
            own = [c for m, c, _ in plain(*v)[0] if m == n]
            assert ends.get((*k, n)) == ((own[0], own[-1]) if own else None)


def test_unsound_definitions_have_a_status(spark):
    good = bytes([0x00, 1, 1, *[0] * 14, 7, 8])
    rows = [(1, 0, good[:-1]), (2, 0, bytes([0x11, 3, *[0] * 15, 1, 2, 3])), (3, 0, None), (4, 0, b""), (5, 0, good + b"\x10"), (6, 0, good)]
    got = huffman.table_definitions(spark.createDataFrame(rows, "path long, place long, data binary"))
    assert sorted((x.path, x["class"], x.status) for x in got.collect()) == [(1, 0, "truncated"), (2, 1, "overfull"), (5, 0, "ok"), (5, 1, "truncated"), (6, 0, "ok")]
    assert huffman.table_codes(got).where(F.col("path") < 5).collect() == []
