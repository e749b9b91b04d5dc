"""The queries themselves, every column they return, against the plain libraries and plain scans; rows with nulls, ties,
repeated rows, a very long text and a column whose name clashes."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rasterflow.llm import lm_scoring, packing, pieces, pii, secrets, token_blocks
from tests.llm.test_operators import base_pii, base_secrets, lower, sha, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, start int, spans string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    latin = "".join(map(chr, range(32, 256)))
    out = [None, "", " \n", "km² 50 km² of land ½cup x¹ m²", "x <|endoftext|> y", "<|startoftext|>a<|endoftext|>", "mail a.b@c.org, call +1 (415) 555-0100", "ip 10.0.0.1 and 300.1.1.1"]
    out += ["card 4111 1111 1111 1111 ok", "password: hunter22 token=abc AKIA" + "A1" * 10, "hash " + "deadbeef" * 4, "same text here", "same text here", "two  spaces   here"]
    out += ["".join(r.choice(latin) for _ in range(r.randint(1, 80))) for _ in range(60)]
    out += [" ".join(r.choice(["the", "city", "of", "a", "river", "İx", "x²", "don't", "e@f.gh"]) for _ in range(r.randint(1, 400))) for _ in range(30)]
    out.append(" ".join(f"w{r.randrange(500)}" for _ in range(60_000)))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contracts"))
    made = [(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows]
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def library(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folder, rows):
    ids, got, start = library("byte_bpe_50k.json"), {r.doc_id: r for r in token_blocks.op1(spark, folder).collect()}, 0
    assert len(got) == len(rows)
    for i, t in rows:
        own = [*ids(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(own), crc(own)), t
        start += len(own)


def test_op2(spark, folder, rows):
    ids, got = library("word_bpe_49k.json"), packing.op2(spark, folder).collect()
    want = {}
    for i, t in rows:
        own = [*ids(t), 0]
        want |= {(i, k): (2048 * k, len(own[2048 * k : 2048 * k + 2048]), crc(own[2048 * k : 2048 * k + 2048])) for k in range(-(-len(own) // 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) <= 1.02 * sum(at.values()) / 2048 + 2


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.mark.parametrize("query,base,names,kinds", [(pii.op3, base_pii, pii.BASE, pii.KINDS), (secrets.op7, base_secrets, secrets.BASE, None)])
def test_op3_and_op7(spark, folder, rows, query, base, names, kinds):
    got = {r.doc_id: r for r in query(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        spans = base(t or "")
        count = Counter(k for k, _, _ in spans)
        assert [got[i][f"n_{k}"] for k in names] == [count[k] for k in names], t
        assert got[i].base_sha256 == sha(spans_text(spans))
        found = [x for x in got[i].spans.split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found)
        assert [int(x.split(":")[1]) for x in found] == sorted(int(x.split(":")[1]) for x in found)
        assert all(0 <= int(a) < int(b) <= len(t) for _, a, b in (x.split(":") for x in found))


def test_op8(spark, folder, rows):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.op8(spark, folder).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), t


def test_op10(spark, folder, rows):
    got = {r.doc_id: r for r in lm_scoring.op10(spark, folder).collect()}
    toks = {i: [*words(lower(t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert math.isfinite(r.score) and r.score < 0


def test_null_ids_and_repeated_rows(spark):
    """Null ids and repeated rows keep their rows in every operator that returns one row a document."""
    made = spark.createDataFrame([(None, "call +1 415 555 0100 now"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    piece_model, ids = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    for out in (pii.pii_spans(made), secrets.secret_spans(made), pieces.piece_ids(made, piece_model), lm_scoring.lm_scores(made, F.lit(False)), packing.best_fit_packing(made, ids, 0), token_blocks.read_blocks(token_blocks.token_blocks(made, ids, 0, 49408))):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 1), (False, 2), (True, 0)]
