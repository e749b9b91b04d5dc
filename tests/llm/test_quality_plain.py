"""Quality rules against a plain version: written rows of several strata whose rules differ, and the pipeline's first stage."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from rasterflow.llm.quality_rules import GRID, Risk, quality_rules
from tests.llm.test_operators import words

SF = "/root/testdata/sf0.01"


def plain_stats(text):
    t = text or ""
    w = words(t)
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    many = Counter(wins)
    lines = [x for x in t.split("\n") if words(x)]
    repeat = len({k + j for k, x in enumerate(wins) if many[x] > 1 for j in range(5)})
    n = max(len(w), 1)
    values = {
        "symbol_ratio": sum(t.count(c) for c in "#*$%&|<>") / n,
        "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "repeat_ratio": repeat / n,
        "word_length": sum(map(len, w)) / n,
        "mark_ratio": len(re.findall("[!?]", t)) / n,
    }
    return len(w) < 10 or 100 * repeat > 20 * len(w), values


def tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def plain_kept(rows, labels):
    """(ids that stay, rules) of rows (id, text, lang) and labels {id: quality}; ids are unique."""
    stats = {i: plain_stats(t) for i, t, _ in rows}
    good = defaultdict(list)
    for i, _, lang in rows:
        if labels.get(i) == 1 and not stats[i][0]:
            good[lang or ""].append(stats[i][1])
    rules = {}
    for stratum, held in good.items():
        for feature, cutoffs in GRID.items():
            for c in cutoffs:  # loosest first, until one fails
                if tail(len(held), sum(v[feature] > c for v in held), Risk().risk) > Risk().delta / (len(good) * len(GRID)):
                    break
                rules[stratum, feature] = c
    return {i for i, _, lang in rows if not stats[i][0] and not any(stats[i][1][f] > rules.get((lang or "", f), math.inf) for f in GRID)}, rules


def test_written_strata(spark):
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["river", "stone", "cloud", "meadow", "lantern", "a", "of", "the"]) + str(r.randrange(50)) for _ in range(n))
    rows, labels = [], {}
    for i in range(4500):
        lang = ["en", "fr", None][i % 3]
        bad = r.random() < 0.2
        t = say(r.randint(12, 40))
        if bad or lang == "fr" and r.random() < 0.1:  # in fr good texts have symbols too
            t += " ###" * r.randint(3, 9)
        if bad and lang is None:
            t += "\nsame line here\nsame line here\nsame line here" + " ?!" * 20
        rows.append((i, t, lang))
        if i % 2:
            labels[i] = int(not bad)
    made = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, lang string, q int, kept string").repartition(3)
    said = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    want, rules = plain_kept(rows, labels)
    assert {s for s, _ in rules} == {"en", "fr", ""} and rules["en", "symbol_ratio"] < rules.get(("fr", "symbol_ratio"), math.inf)
    failed = {i for i, t, _ in rows if plain_stats(t)[0]}
    assert len(want) < len(rows) - len(failed)  # rules reject, not the base alone
    for carry in (True, False):
        assert {x.doc_id for x in quality_rules(made, said, carry=carry).where("kept").collect()} == want


def test_first_stage_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {x.doc_id: x.q for x in spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q")).collect()}
    want, _ = plain_kept([(x.doc_id, x.text, x.lang) for x in docs.collect()], labels)
    assert {x.doc_id for x in corpus_pipeline.quality(spark, docs, SF).collect()} == want
