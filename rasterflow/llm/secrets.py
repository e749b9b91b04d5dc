"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns only near hits, embedded checksums.

One automaton pass over the text, lower-cased, finds where keywords begin; only there the pattern of that keyword is
tried, anchored. Runs of hex digits have no keyword and are found by a run of their own class. Tokens that carry a
checksum (six base-62 digits of a CRC-32) count only if it holds; signed web tokens only if their header decodes.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

from pyspark.sql import functions as F

from rasterflow.llm.common import table
from rasterflow.llm.spans import joined, of_kinds, ordered, replaced, span_rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked_token", "web_token", "private_key")
#: Fixed values of the formats: keyword, kind.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "checked_token"),
    "eyj": "web_token",
    "-----begin ": "private_key",
}
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "checked_token": re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "web_token": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
}
#: Kinds whose pattern, once it fails inside a run of these characters, fails at every later place of the run too: all such
#: places see the same end of the run and the same text behind it. So each run is tried once, however many keywords it holds.
RUNS = {"web_token": re.compile(r"[A-Za-z0-9_-]*+")}
HEX = re.compile(r"[0-9a-f]{24,}")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_AUTOMATON: list = []


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of the body."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(6, "0")


def header_holds(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


def valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind == "checked_token":
        return checksum(m[1]) == m[2]
    return kind != "web_token" or header_holds(m[1])


def find_secrets(text: str) -> list:
    """Spans by start, then kind. Leftmost, non-overlapping within a kind; a match that fails its test is passed over whole.
    Work is linear in the text, whatever it holds."""
    if not _AUTOMATON:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            automaton.add_word(word, (len(word), kind))
        automaton.make_automaton()
        _AUTOMATON.append(automaton)
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(LOWER)
    spans, until = [], dict.fromkeys(KINDS, 0)
    for last, (size, kind) in _AUTOMATON[0].iter(low):
        start = last - size + 1
        if start < until[kind]:
            continue
        if m := PATTERNS[kind].match(text, start):
            until[kind] = m.end()
            if valid(kind, m):
                spans.append((kind, start, m.end()))
        elif kind in RUNS and text.startswith("eyJ", start):
            until[kind] = RUNS[kind].match(text, start).end()
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(spans, KINDS)


def secret_spans(docs, id_col="doc_id", text_col="text"):
    """Rows (doc_id, spans). Null and empty texts have none; null ids and repeated rows keep their rows; texts are read whole,
    in time that grows with their length; no rows in, no rows out; other columns are not read."""
    return span_rows(docs, find_secrets, id_col, text_col)


def redact_secrets(docs, text_col="text"):
    """docs with every secret put as its kind in brackets; n_chars, if there, follows. Null and empty texts stay as they are;
    repeated rows and null ids are treated like any other; all columns stay, in their order. No rows in, no rows out."""
    return replaced(docs, find_secrets, text_col)


def op7(spark, sf_dir):
    """Secrets of all documents: counts and digest of the base spans, and all spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *(F.size(of_kinds(spans, (k,))).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(joined(of_kinds(spans, BASE)), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
