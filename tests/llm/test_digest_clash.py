"""Texts whose digests clash are classes of their own."""

from pyspark.sql import functions as F

from rasterflow.llm import exact_dedup


def weak(bare):
    return F.unhex(F.sha2(F.substring(bare, 1, 1), 256)), F.xxhash64(F.substring(bare, 1, 1))


def test_clashing_digests_give_a_class_a_text(spark):
    rows = [(1, "aab"), (2, "aac"), (3, "a a b"), (4, "aac"), (5, "b"), (6, "b "), (7, None), (8, " "), (9, "abb"), (10, "axx€"), (None, "aab"), (2, "aac")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = exact_dedup.exact_dedup(docs).drop("row", "text_sha256").collect()
    got = exact_dedup.exact_dedup(docs, hashes=weak).drop("row", "text_sha256").collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(r.id, r.keep_id, r.group_size) for r in got if r.id is not None} >= {(1, 3, 3), (3, 3, 3), (2, 2, 3), (4, 2, 3), (5, 6, 2), (7, 8, 2), (9, 9, 1), (10, 10, 1)}


def test_a_clash_of_other_lengths_is_none(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "abc")], "doc_id long, text string")
    assert {r.id: r.keep_id for r in exact_dedup.exact_dedup(docs, hashes=weak).collect()} == {1: 1, 2: 2}
