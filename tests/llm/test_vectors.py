"""Vector codes and centroid clusters against plain integer walks; pruning on vectors of spread norms."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.llm import centroids, vector_codes
from rasterflow.llm.centroids import Clusters, cluster_vectors, nearest_centroids
from rasterflow.llm.vector_codes import Codec, compress_vectors, decode_codes, nearest_entries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster int, _label int, n long"
NAN, INF = float("nan"), float("inf")


def make(dim, n, seed, spread=1.0):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, spread * r.choice([0.1, 1, 3])) for _ in range(dim)], r.choice([None, 0, 0, 0, 1])) for i in range(n)]
    rows += [(i, list(rows[i % 7][1]), 0) for i in range(n, n + 40)]  # copies
    rows += [(5, list(rows[5][1]), 0), (5, rows[6][1], 2), (None, list(rows[3][1]), 1)]  # repeated and null ids
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * (dim - 1), 0), (903, [NAN] + [0.0] * (dim - 1), 0), (904, [INF] + [0.0] * (dim - 1), 0), (905, [None] + [0.0] * (dim - 1), 0), (906, [1e30] + [0.0] * (dim - 1), 0), (-4, [0.25] * dim, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    f32 = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], y, "x", 9, 9, 9) for i, v, y in rows]
    return spark.createDataFrame(f32, SCHEMA).repartition(5)


def usable(rows, dim, scale):
    out = []
    for i, v, y in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) and abs(x) < 1e6 for x in v):
            out.append((i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v), y))
    return out


def dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def near(x, book):
    return min((dist(x, e), k) for k, e in enumerate(book))


def averaged(book, groups):
    return [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if groups[k] else e for k, e in enumerate(book)]


def plain_codes(rows, c):
    kept = usable(rows, c.dim, c.scale)
    w, seeds = c.width, sorted(r[:2] for r in kept if r[0] is not None)[: c.entries]
    books = [[v[w * p : w * p + w] for _, v in seeds] for p in range(c.parts)]
    for _ in range(c.rounds):
        for p in range(c.parts):
            groups = [[] for _ in books[p]]
            for _, v, _ in kept:
                groups[near(v[w * p : w * p + w], books[p])[1]].append(v[w * p : w * p + w])
            books[p] = averaged(books[p], groups)
    out = []
    for i, v, y in kept:
        found = [near(v[w * p : w * p + w], books[p]) for p in range(c.parts)]
        out.append((i, y, bytes(k for _, k in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("codec", [Codec(dim=12, parts=3, entries=5, rounds=3), Codec(dim=4, parts=4, entries=16, rounds=2), Codec(dim=6, parts=1, entries=300 // 2, rounds=1)])
def test_codes_equal_a_plain_walk(spark, codec):
    rows = make(codec.dim, 120, codec.dim)
    got, books = compress_vectors(frame(spark, rows), codec)
    want, plain = plain_codes(rows, codec)
    assert books.tolist() == [[list(e) for e in b] for b in plain]
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error) for r in got.collect()) == Counter(want)


def test_decoded_vectors_are_off_by_their_error(spark):
    codec = Codec(dim=8, parts=2, entries=4, rounds=2)
    rows = make(8, 60, 3)
    got, books = compress_vectors(frame(spark, rows), codec)
    ints = Counter((i, v) for i, v, _ in usable(rows, 8, codec.scale))
    for r in decode_codes(got, books, codec.scale).collect():
        assert any(i == r.vec_id and dist(v, [round(x * codec.scale) for x in r.vec]) == r.error for i, v in ints)


def test_entries_outside_the_annulus_are_not_measured_and_ties_go_low():
    r = np.random.default_rng(1)
    entries = (r.normal(size=(64, 2)) * np.geomspace(10, 1e5, 64)[:, None]).astype(np.int64)
    x = np.concatenate([(entries[r.integers(0, 64, 3000)] * r.uniform(0.9, 1.1, (3000, 1))).astype(np.int64), entries, [[0, 0]]])
    at, d, measured = nearest_entries(x, entries)
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all() and measured < 0.4 * full.size
    same = np.array([[3, 4], [5, 0], [-5, 0], [0, 5], [3, 4], [4, 3]])  # one norm, equal entries, ties of distance
    grid = np.array([[a, b] for a in range(-9, 10) for b in range(-9, 10)])
    assert (nearest_entries(grid, same)[0] == ((grid[:, None] - same[None]) ** 2).sum(2).argmin(1)).all()


def plain_clusters(rows, to):
    kept = usable(rows, to.dim, to.scale)
    key = lambda i: hashlib.sha256(f"{to.salt}{i}".encode()).hexdigest()
    book = [v for _, v in sorted((key(i), v) for i, v, _ in kept if i is not None)[: to.count]]
    for _ in range(to.rounds):
        groups = [[] for _ in book]
        for _, v, _ in kept:
            groups[near(v, book)[1]].append(v)
        book = averaged(book, groups)
    return [(i, *reversed(near(v, book))) for i, v, _ in kept], book


@pytest.mark.parametrize("to", [Clusters(count=6, dim=8, width=4, rounds=3), Clusters(count=500, dim=4, width=1, rounds=2)])
def test_clusters_equal_a_plain_walk(spark, to):
    rows = make(to.dim, 150, 5)
    got, book = cluster_vectors(frame(spark, rows), to)
    want, plain = plain_clusters(rows, to)
    assert book.tolist() == [list(c) for c in plain]
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == Counter(want)


def test_block_norms_screen_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(2)
    c = (r.normal(size=(30, 16)) * r.choice([1, 30, 900], (30, 4)).repeat(4, 1)).astype(np.int64)
    x = c[r.integers(0, 30, 4000)] + r.integers(-3, 4, (4000, 16))
    at, d, measured = nearest_centroids(x, c, 4)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all() and measured < 0.5 * full.size
    twice = np.concatenate([c, c])
    assert (nearest_centroids(x, twice, 4)[0] == full.argmin(1)).all()


def test_whole_queries(spark, tmp_path):
    rows = make(64, 90, 8)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = plain_codes(rows, Codec())
    label = Counter()
    for _, y, _, e in want:
        label[y] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = vector_codes.op11(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((i, c.hex(), e, label[y], digest) for i, y, c, e in want)
    want, book = plain_clusters(rows, Clusters())
    inside = Counter()
    for _, c, d in want:
        inside[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    got = centroids.op12(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((i, c, d, inside[c], sum(inside.values()), sha[c]) for i, c, d in want)


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [NAN] * 64, None), (3, [], 0)]])
def test_nothing_usable(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op11(spark, str(tmp_path)).collect() == [] and centroids.op12(spark, str(tmp_path)).collect() == []


def test_sums_beyond_a_long_are_null(spark):
    from rasterflow.llm.vectors import sum_long

    df = spark.createDataFrame([(1 << 62,), (1 << 62,), (5,)], "v long")
    assert df.agg(sum_long(F.col("v")).alias("s")).first().s is None and df.where("v < 9").agg(sum_long(F.col("v")).alias("s")).first().s == 5
