import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterflow.llm import secrets
from tests.llm.test_operators import brute_components, words
from tests.llm.test_quality_plain import plain_kept

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("extra")).withColumn("q", F.lit(1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near duplicates", "secret scans", "best-fit packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.q for r in spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q")).collect()}
    verdict, _ = plain_kept([(i, r.text, r.lang) for i, r in rows.items()], labels)
    out = corpus_pipeline.quality(spark, docs, SF).cache()
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == verdict
    assert all(len(words(rows[i].text)) >= 10 for i in verdict)

    groups = defaultdict(list)
    for i in verdict:
        groups[re.sub("[\x20\x09-\x0d]", "", rows[i].text or "")].append((-len(rows[i].text), i))
    want = {min(g)[1] for g in groups.values()}
    out = corpus_pipeline.exact(spark, out, SF).cache()
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want

    ids = sorted(want)
    label = brute_components([rows[i].text for i in ids], 5, 80)
    want = {i for k, i in enumerate(ids) if label[k][1] == k}
    out = corpus_pipeline.near(spark, out, SF).cache()
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want

    out = corpus_pipeline.secrets(spark, out, SF).cache()
    assert out.columns == docs.columns
    for r in out.collect():
        assert not secrets.find_secrets(r.text) and (r.text == rows[r.doc_id].text) == (not secrets.find_secrets(rows[r.doc_id].text))
        assert r.n_chars == len(r.text)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, at = {}, Counter()
    for r in out.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        pieces |= {(r.doc_id, k): (2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(np.array(ids[2048 * k : 2048 * k + 2048], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))}
    packed = corpus_pipeline.pack(spark, out, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == pieces and len(packed) == len(pieces)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) <= 1.02 * sum(at.values()) / 2048 + 2
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((i, k, c) for (i, k), (_, _, c) in pieces.items())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
