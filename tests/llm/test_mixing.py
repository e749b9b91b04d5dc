"""Mixing: targets by the written rule, copies by a plain walk, nearness, reruns, nulls, ties and empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterflow.llm.mixing import UNIT_BITS, Mix, mix_sources, mixed_documents, op13
from tests.llm.test_operators import words

SCHEMA = "doc_id long, text string, source string, size long, target double, copies int, place long, n_chars long"


def make(seed, n=600):
    r = random.Random(seed)
    names = [None, "", "a", "B", "é", "z\U0001f600", "￮", "tiny", "blank"]
    rows = []
    for i in range(n):
        s = r.choices(names, [3, 1, 60, 4, 9, 2, 2, 1, 1])[0]
        text = None if i % 50 == 7 else "" if s == "blank" or i % 50 == 8 else r.choice([" ", "\n\t", "\x0b"]).join(f"w{k}" for k in range(r.choice([1, 1, 5, 20, 60])))
        rows.append((i, text, s))
    rows.append((n, "long " * 3000, "a"))
    rows += [rows[3]] * 30 + [(None, "no id", "a"), (None, "no id", None)]
    return rows


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, 7, 1.0, 5, 3, 2) for r in rows], SCHEMA).repartition(parts)


def plain_targets(sizes, mix):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    left, open_, target = mix.share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > mix.most * sizes[s]}
        for s in over or open_:
            target[s] = float(mix.most * sizes[s]) if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


def plain_mix(rows, mix=Mix()):
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((-len(words(t or "")), i is None, i or 0))
    sizes = {s: -sum(x[0] for x in v) for s, v in by.items()}
    target, out = plain_targets(sizes, mix), []
    for s, docs in by.items():
        rate = math.floor(target[s] / sizes[s] * 2**UNIT_BITS) if sizes[s] else 0
        name = mix.seed + ("" if s is None else ":" + s)
        at = int(hashlib.sha256(name.encode()).hexdigest()[:5], 16) << (UNIT_BITS - 20)
        for size, none, i in sorted(docs):
            out.append((None if none else i, s, -size, sizes[s], ((at + rate) >> UNIT_BITS) - (at >> UNIT_BITS)))
            at += rate
    return out, target


@pytest.mark.parametrize("mix", [Mix(), Mix(share=2.0), Mix(weights=(1,), share=0.5, seed="other"), Mix(weights=(1, 100), share=1.0, most=3), Mix(share=0.0)])
def test_mix_equals_a_plain_walk(spark, mix):
    rows = make(4)
    got = mix_sources(frame(spark, rows), mix).collect()
    want, target = plain_mix(rows, mix)
    assert Counter((r.doc_id, r.source, r["size"], r.source_size, r.copies) for r in got) == Counter(want)
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    assert all(0 <= r.copies <= mix.most for r in got)


def test_sources_come_near_their_targets(spark):
    got = mix_sources(frame(spark, make(9, 3000))).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= max(r["size"] for r in own) + 1


def test_reruns_agree_however_rows_are_dealt(spark):
    df = make(6)
    one, two = (Counter(map(tuple, mix_sources(frame(spark, random.Random(p).sample(df, len(df)), p)).collect())) for p in (1, 9))
    assert one == two


def test_query_and_documents(spark, tmp_path):
    rows = [r for r in make(2) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (size, whole, size * c) for i, _, size, whole, c in plain_mix(rows)[0]}
    got = op13(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r["size"], r.source_size, r.taken) for r in got} == want and len(got) == len(rows)
    copies = {i: c for i, _, _, _, c in plain_mix(rows)[0]}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = mixed_documents(docs.drop("copy"))
    assert mixed.columns == [*docs.columns, "copy"]
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: c for i, c in copies.items() if c})


def test_empty_and_wordless_tables(spark):
    none = frame(spark, make(1)).where(F.lit(False))
    assert mix_sources(none).collect() == []
    blank = mix_sources(frame(spark, [(1, None, "a"), (2, " \n", None), (3, "", "a")])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.copies) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)]


def test_sizes_of_the_callers_own(spark):
    got = mix_sources(spark.createDataFrame([(1, "x", 10), (2, "x", None), (3, "y", 5)], "doc_id long, source string, n long"), sizes=F.col("n")).collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in got) == [(1, 10, 10), (2, 0, 10), (3, 5, 5)]
