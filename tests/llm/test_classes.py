"""Classes of equal sets: broadcast and shuffled ones together equal a plain join, at any threshold; many buckets share few
partitions without a change of the result."""

import random

from pyspark.sql import functions as F

from rasterflow.llm import lm_scoring, ngram_join


def test_classes_equal_a_plain_join(spark):
    r = random.Random(3)
    rows = [(k, *r.choice([(1, 1)] * 6 + [(1, 2), (2, 1)] + [(3, j) for j in range(20)])) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, hi long, lo long").repartition(5)
    classes = df.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("many")).where("many > 1")
    least = {}
    for k, *d in rows:
        least.setdefault(tuple(d), []).append(k)
    want = sorted((k, min(least[tuple(d)])) for k, *d in rows if len(least[tuple(d)]) > 1)
    for bound in (0, 30, 100, 10_000):
        got = ngram_join.on_classes(df, classes, len(rows), least=bound)
        assert sorted((x.id, x.rep) for x in got.collect()) == want
    assert ngram_join.on_classes(df.limit(0), classes.limit(0), 0).collect() == []


def test_many_buckets_in_few_partitions(spark, monkeypatch):
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnopqrstuvw") * r.randint(1, 3) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(w if r.random() > 0.01 else "x" for w in b) for b in base for _ in range(6)] + [" ".join(base[0])] * 5 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def both():
        links = sorted(map(tuple, ngram_join.ngram_join(docs, ngram_join.Similarity(words=4, part=85)).collect()))
        return links, sorted(map(tuple, lm_scoring.lm_scores(docs, F.col("doc_id") % 7 == 2, block_bytes=400).collect()))

    plain = both()
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 60)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", 30)
    for module in (ngram_join, lm_scoring):
        monkeypatch.setattr(module, "MOST_PARTITIONS", 3)
    assert both() == plain
