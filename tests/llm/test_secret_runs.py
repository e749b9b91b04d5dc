"""Long token runs: as many keywords as they may hold, time stays linear, and results stay those of the plain pattern."""

import base64
import json
import random
import re
import time

import pytest

from rasterflow.llm.secrets import find_secrets, header_holds, redact_secrets

PLAIN = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def b64(x):
    return base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")


TOKEN = f"{b64({'alg': 'HS256'})}.{b64({'sub': 'x'})}.c2lnbmF0dXJl"


def long_texts():
    r = random.Random(3)
    objects = "".join(b64({"a": r.randrange(10)}) for _ in range(420_000))[:5_000_000]
    return {"objects": objects, "repeated": "eyJ" * 1_600_000, "dotted": "eyJab." * 800_000, "pairs": "eyJa.eyJb " * 500_000, "lower": "eyj" * 1_600_000, "heads": "-----BEGIN PRIVATE KEY-----A" * 150_000, "blanks": ("token" + " " * 5000) * 900}


@pytest.mark.parametrize("name", long_texts())
def test_five_megabytes_take_seconds(name):
    text, began = long_texts()[name] + " ", time.time()
    spans = find_secrets(text + TOKEN)
    assert ("web_token", len(text), len(text) + len(TOKEN)) in spans and time.time() - began < 20


def test_redaction_of_long_runs(spark):
    text = "".join(b64({"a": k % 9}) for k in range(200_000))
    docs = spark.createDataFrame([(1, text + " " + TOKEN), (2, None), (3, "")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert got == {1: text + " [WEB_TOKEN]", 2: None, 3: ""} and time.time() - began < 40


def test_spans_are_those_of_the_plain_pattern():
    r = random.Random(5)
    parts = ["eyJ", ".", "-", "a", "eyj", " ", b64({"alg": "x"}), b64({"b": 1}), "..", "eyJeyJ"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want = [("web_token", m.start(), m.end()) for m in PLAIN.finditer(text) if header_holds(m[1])]
        assert [s for s in find_secrets(text) if s[0] == "web_token"] == want, text
