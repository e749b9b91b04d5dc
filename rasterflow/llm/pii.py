"""PII: candidate gradient boosting.

High-recall generators propose overlapping spans of any form that personal data takes. Boosted trees score each by its
format and context; a threshold calibrated for each kind selects. Spans of the four base formats always stay.

Training rows come from a bounded sample of the texts: base spans where they stand, and the same spans rewritten in the wider
forms (their own context with another format), as positives; look-alikes that fail a base check as negatives. Written rows
from a fixed seed join them, for kinds and contexts that the texts may not have: personal data with and without a hint, and
look-alikes behind a word against or of a broken format. Half of the rows train; on the other half the threshold of a kind
is the lowest score above which the share of personal data has an exact-binomial lower bound of at least
``Training.precision``. A kind that never reaches it adds nothing.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import table, whole_text
from rasterflow.llm.spans import joined, of_kinds, ordered, span_rows
from rasterflow.llm.trees import BoostedTrees

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "iban")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider forms, by kind. Bounded repeats and possessive runs keep every scan linear.
WIDE = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9][\w.]{0,63}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z]{2,20})+"),
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
}
CONTEXT = re.compile(r"\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|credit|address|host|server|ssn|social|iban|account|reach)\b", re.I | re.A)
AGAINST = re.compile(r"\b(?:version|release|order|invoice|isbn|figure|table|page|section|ratio|score|serial|part)\b", re.I | re.A)
LAST_LETTERS = re.compile(r"[A-Za-z]*\Z")


@dataclass(frozen=True)
class Training:
    """Most texts in the sample (on average of the hash), most of their candidates (those of least hash), template rows,
    least precision, and its error."""

    texts: int = 2000
    candidates: int = 5000
    templates: int = 3000
    precision: float = 0.95
    delta: float = 0.05


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern, from each '@' outwards, so that long runs cost one look each."""
    out, until, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > until and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            until = m.end()
        else:
            until = at  # no later match begins before this '@'
        at = text.find("@", max(until, at + 1))
    return out


def base_checks(text: str) -> tuple[list, list]:
    """(spans that pass, spans that fail) of the base formats."""
    good, bad = [("email", *s) for s in emails(text)], []
    for m in IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
        (good if ok else bad).append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        (good if 14 <= len(d) <= 19 and luhn(d) else bad).append(("card", *m.span()))
    for m in PHONE.finditer(text):
        (good if 10 <= len(digits_of(m[0])) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def wide_spans(text: str) -> list:
    return [(kind, *m.span()) for kind, p in WIDE.items() for m in p.finditer(text)]


def features(text: str, span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    return [
        KINDS.index(kind), b - a, len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), sum(c.isalpha() for c in s), s.count("."), s.count("-"), s.count(" "),
        s.count("(") + s.count("["), float("+" in s), len(set(d)), float(len(d) > 8 and luhn(d)), float(kind == "iban" and iban_holds(s)),
        len(CONTEXT.findall(before)), len(AGAINST.findall(before)), len(CONTEXT.findall(after)), float(before[-1:].isspace()), float(after[:1].isspace() or after[:1] in ".,;"),
        len(LAST_LETTERS.search(s)[0]),
    ]


def template_rows(n: int) -> list[tuple[str, tuple, int]]:
    """(text, span, label) of n written rows; the same rows every time."""
    r = random.Random(7)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    local = lambda: r.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{word()}{num(2)}"])
    lead = ["call me at ", "phone: ", "my email is ", "contact ", "mail to ", "tel. ", "reach us on ", "server address ", "ssn ", "account iban ", "the server is "]
    odd = ["order ", "invoice no. ", "version ", "see table ", "isbn ", "serial ", "part ", "score of ", "section ", "ratio "]

    def iban():
        body = "".join(r.choice("0123456789") for _ in range(18))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check:02d}{body}"

    makers = {
        "email": lambda: f"{local()} {r.choice(['[at]', '(at)'])} {r.choice(['', 'mail.'])}{word()}{r.choice(['', '7'])}{r.choice(['.', '.', ' [dot] ', ' (dot) '])}{r.choice(['com', 'org', 'net'])}",
        "ip": lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)),
        "phone": lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(num(3), num(3), num(4)),
        "national_id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": iban,
    }
    fakes = {
        "email": lambda: f"{local()} {r.choice(['[at]', '(at)'])} {word()}.{word()}{word()}",  # prose, not a domain
        "ip": lambda: ":".join(f"{r.randrange(10):02d}" for _ in range(8)),
        "phone": lambda: r.choice(["{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(num(3), num(3), num(4)),
        "national_id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "iban": lambda: f"{r.choice(['AB', 'XY', 'KL'])}{num(18)}",
    }
    rows = []
    for _ in range(n):
        kind = r.choice(tuple(makers))
        label = int(r.random() < 0.5)
        plain = " ".join(word() for _ in range(4)) + " "
        # a look-alike of sound format is told by a word against it, one of broken format by itself
        intro = r.choice([*lead, *[plain] * len(lead)]) if label else r.choice([*odd, plain] if kind in ("email", "ip", "iban") else odd)
        body = (makers if label else fakes)[kind]()
        text = f"{word()} {word()} {intro}{body}{r.choice(['.', ' ', ', '])}{word()} {word()}"
        a = text.index(body)
        rows.append((text, (kind, a, a + len(body)), label))
    return rows


def lower_bound(n: int, k: int, delta: float) -> float:
    """Exact lower bound of a share of which k of n are seen, wrong with chance delta."""
    low, high = 0.0, k / n
    for _ in range(40):
        p = (low + high) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p or 1e-300) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
        low, high = (p, high) if tail < delta else (low, p)
    return low


def rewritten(text: str, span: tuple) -> list[tuple[str, tuple]]:
    """(text, span) with a base span put into the wider forms of its kind; other text stays."""
    kind, a, b = span
    d, forms = digits_of(text[a:b]), []
    if kind == "email":
        name, _, host = text[a:b].rpartition("@")
        forms = [f"{name} [at] {host}", f"{name}(at){host.replace('.', ' (dot) ')}"]
    elif kind == "phone":
        x, y, z = d[-10:-7], d[-7:-4], d[-4:]
        forms = [f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}"]
    made = [(text[max(0, a - 60) : a] + f + text[b : b + 60], (kind, min(a, 60), min(a, 60) + len(f))) for f in forms]
    return [(t, s) for t, s in made if s in wide_spans(t)]


def sample_rows(text: str) -> list[list[float]]:
    """Feature rows of a text, the label last."""
    good, bad = base_checks(text)
    out = [[*features(text, s), y] for y, spans in ((1, good), (0, bad)) for s in spans]
    return out + [[*features(t, w), 1] for s in good for t, w in rewritten(text, s)]


def train(docs: DataFrame, id_col: str, text_col: str, how: Training) -> tuple[BoostedTrees, dict[str, float]]:
    """(trees, least margin of each kind). The sample is every text whose id hash falls under a share of the hash range, and
    of its rows those of least hash, so that it is the same however the texts lie in partitions."""
    share = min(1.0, how.texts / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(whole_text(text_col).alias("text"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = [row for t in batch.column(0).to_pylist() for row in sample_rows(t)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["row"])

    found = picked.mapInArrow(rows, "row array<double>").orderBy(F.xxhash64("row"), "row").limit(how.candidates)
    return train_rows([r.row for r in found.collect()], how)


def train_rows(seen: list[list[float]], how: Training) -> tuple[BoostedTrees, dict[str, float]]:
    """(trees, least margin of each kind) from rows of the sample and the written ones."""
    made = [[*features(t, s), y] for t, s, y in template_rows(how.templates)]
    data = np.array(sorted(seen) + made)
    order = np.random.default_rng(3).permutation(len(data))
    fit, hold = data[order[::2]], data[order[1::2]]
    trees = BoostedTrees().fit(fit[:, :-1], fit[:, -1])
    margin = trees.margin(hold[:, :-1])
    least = dict.fromkeys(KINDS, math.inf)
    for i, kind in enumerate(KINDS):
        own = hold[:, 0] == i
        for cut in sorted(set(np.quantile(margin[own], np.linspace(0, 1, 21))) if own.any() else []):
            above = own & (margin >= cut)
            if lower_bound(int(above.sum()), int(hold[above, -1].sum()), how.delta / 21) >= how.precision:
                least[kind] = float(cut)
                break
    return trees, least


class Taken:
    """Spans that do not overlap, by start; merged ones for the base spans, which may."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b) - 1  # the last span that starts before b
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def finder(trees: BoostedTrees, least: dict[str, float]):
    def find(text: str) -> list:
        good, _ = base_checks(text)
        taken = Taken(good)
        wide = [s for s in wide_spans(text) if not taken.meets(s[1], s[2])]
        if wide:
            margin = trees.margin(np.array([features(text, s) for s in wide]))
            # of overlapping candidates the best stays
            for _, s in sorted((-m, s) for m, s in zip(margin.tolist(), wide) if m >= least[s[0]]):
                if not taken.meets(s[1], s[2]):
                    taken.add(s[1], s[2])
                    good.append(s)
        return ordered(good, KINDS)

    return find


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Training = Training()) -> DataFrame:
    """Rows (doc_id, spans, base): all spans by start, and those of the base formats.

    Null and empty texts have none; null ids and repeated rows keep their rows; without documents the templates alone train.
    """
    find = finder(*train(docs, id_col, text_col, how))
    out = span_rows(docs, lambda t: [*find(t), *(("base:" + k, a, b) for k, a, b in ordered(base_checks(t)[0], KINDS))], id_col, text_col)
    named = F.transform(F.filter("spans", lambda s: s["kind"].startswith("base:")), lambda s: F.struct(F.substring(s["kind"], 6, 99).alias("kind"), s["start"], s["end"]))
    return out.select("doc_id", F.filter("spans", lambda s: ~s["kind"].startswith("base:")).alias("spans"), named.alias("base"))


def op3(spark, sf_dir):
    found = pii_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(F.size(of_kinds(F.col("base"), (k,))).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )
