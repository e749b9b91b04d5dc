"""Quality rules [native]: risk-controlled thresholds.

Features of every text are DataFrame expressions over arrays, so nothing is shuffled but the labelled rows. For each
stratum and feature the cutoffs of a fixed grid are tested from the loosest on: cutoff c passes when the exact
binomial tail P(Bin(n, risk) <= k) is at most delta / (number of stratum-feature pairs), n being the labelled good
documents of the stratum and k those that c would reject. As the tail grows with k, the cutoffs that pass are a prefix
of the sequence, so testing them in order needs no further correction (fixed-sequence testing inside a pair,
Bonferroni over pairs). The tightest passing cutoff rejects; a pair with none rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import SPACE_CLASS, pinned, staged, table, whole_text

#: Feature -> cutoffs, loosest first; a document is rejected above the cutoff.
GRID = {
    "symbol_ratio": (1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "dup_line_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.18, 0.15, 0.12, 0.1),
    "word_length": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "mark_ratio": (1.5, 1.0, 0.5, 0.3),
}


@dataclass(frozen=True)
class Risk:
    """risk: tolerated share of good documents rejected by one rule in a stratum; delta: chance that any rule exceeds it."""

    risk: float = 0.02
    delta: float = 0.05


def _window(words: Column, i: Column) -> list[Column]:
    """The five words from place i (from 0); element access, as slice() copies the whole array at each call."""
    return [F.get(words, i + j) for j in range(5)]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the array.

    A hash set of window hashes tells documents without a repeat; only the others have their windows, as text, sorted.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*_window(words, i)))
    return F.when(n < 5, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n - 4, F.lit(0))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column ``q``: n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words."""
    text = whole_text(text_col)
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.withColumn("_w", pinned(words)).withColumn("_l", pinned(lines))
    quick = _repeat_words(F.col("_w"))
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.struct(F.concat_ws(" ", *_window(F.col("_w"), i)).alias("t"), i.alias("p")))
    b = a.withColumn("_quick", pinned(quick)).withColumn("_s", pinned(F.when(F.col("_quick").isNull(), F.sort_array(windows))))
    # a window is repeated if a neighbour in sorted order is the same
    at = lambda i: F.get(F.col("_s"), i)["t"]
    same = F.filter(F.col("_s"), lambda x, i: F.coalesce(x["t"] == at(i - 1), F.lit(False)) | F.coalesce(x["t"] == at(i + 1), F.lit(False)))
    c = b.withColumn("_p", pinned(F.sort_array(F.transform(same, lambda x: x["p"]))))
    covered = F.aggregate(
        F.col("_p"),
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return c.withColumn(
        "q",
        pinned(F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.col("_quick"), covered).cast("long").alias("n_repeat_words"),
        )),
    ).drop("_w", "_l", "_quick", "_s", "_p")


def features(q: str = "q") -> dict[str, Column]:
    c = lambda x: F.col(f"{q}.{x}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    return {
        "symbol_ratio": c("n_symbols") / words,
        "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        "repeat_ratio": c("n_repeat_words") / words,
        "word_length": c("word_chars") / words,
        "mark_ratio": c("n_marks") / words,
    }


def base_failed(q: str = "q") -> Column:
    return (F.col(f"{q}.n_words") < 10) | (100 * F.col(f"{q}.n_repeat_words") > 20 * F.col(f"{q}.n_words"))


def log_factorial(x: Column) -> Column:
    """ln x! for integer x >= 0: Stirling's series at x + 10, then ten factors taken off."""
    z = x + F.lit(11.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    down = F.lit(1.0)
    for i in range(1, 11):
        down = down * (x + F.lit(float(i)))
    return series - F.log(down)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to double precision, for k up to n * p; beyond that 1 (it is over a third there).

    The terms fall from k downwards; as many are added as can matter.
    """
    n, k = n.cast("double"), k.cast("double")
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(F.lit(40.0) * F.sqrt(n * p)) + 60).cast("int")
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), k.alias("i"), n.alias("n")),
        lambda a, _: F.struct(
            (a["t"] * a["i"] * (1 - p) / ((a["n"] - a["i"] + 1) * p)).alias("t"),
            (a["s"] + a["t"] * a["i"] * (1 - p) / ((a["n"] - a["i"] + 1) * p)).alias("s"),
            (a["i"] - 1).alias("i"),
            a["n"].alias("n"),
        ),
        lambda a: a["s"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def fit_cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Rows (stratum, feature, cutoff) of the rules that may reject.

    labelled: stratum and the features, one row per labelled good document; features are null for those that the base
    rules reject, which don't count. All labelled rows count; the grid is fixed beforehand, so all of them are
    holdout. A stratum without good rows, or no row at all, gives no rule.
    """
    counts = labelled.groupBy("stratum").agg(
        F.count("symbol_ratio").alias("n"), *(F.count_if(F.col(f) > c).alias(f"{f}_{i}") for f, cs in GRID.items() for i, c in enumerate(cs))
    )
    cells = F.array(
        *(F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cutoff"), F.col(f"{f}_{i}").alias("k")) for f, cs in GRID.items() for i, c in enumerate(cs))
    )
    counts = staged(counts.where("n > 0"), "quality-counts")  # a row for each stratum
    pairs = counts.count() * len(GRID)
    flat = counts.select("stratum", "n", F.inline(cells))
    passed = flat.where(binomial_tail(F.col("n"), F.col("k"), risk.risk) <= F.lit(risk.delta) / F.lit(float(max(pairs, 1))))
    return passed.groupBy("stratum", "feature").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    risk: Risk = Risk(),
    carry: bool = True,
) -> DataFrame:
    """docs with the struct ``q`` of counts, base_failed, reasons ('base', or features whose rule rejects) and kept.

    carry=False leaves the text out: the counts are then staged, so that labelled texts are analysed once, not twice.

    A null text has no words and fails the base rules. A null stratum is a stratum of its own, named ''. Labels that are
    null, or name no document, are not used; a document labelled more than once counts as good if any label says so.
    Repeated rows are judged alike. Empty tables give no rows, or no rules. The columns named q, base_failed, reasons and
    kept are replaced if ``docs`` has them; a column of ``labels`` never clashes.
    """
    docs = docs.drop("q", "base_failed", "reasons", "kept")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    good = known.where(F.col("_y") == 1).select("_id")
    if carry:
        named = docs.select(id_col, text_col, stratum_col).join(good, F.col(id_col) == F.col("_id"), "left_semi")
        seen, stats = text_stats(named, text_col), text_stats(docs, text_col)
    else:
        stats = staged(text_stats(docs, text_col).drop(text_col), "quality-counts")
        seen = stats.join(good, F.col(id_col) == F.col("_id"), "left_semi")
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    labelled = seen.select(stratum.alias("stratum"), *(F.when(~base_failed(), c).alias(f) for f, c in features().items()))
    rules = fit_cutoffs(labelled, risk).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("_rules"))
    stats = stats.withColumn("base_failed", base_failed()).withColumn("_stratum", stratum)
    judged = stats.join(rules.withColumnRenamed("stratum", "_stratum"), "_stratum", "left")
    over = [F.when(c > F.coalesce(F.col("_rules")[f], F.lit(float("inf"))), F.lit(f)) for f, c in features().items()]
    hits = pinned(F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *over)))
    return judged.withColumn("reasons", hits).withColumn("kept", F.size("reasons") == 0).drop("_rules", "_stratum")


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules(docs, table(spark, sf_dir, "labels"), carry=False)
    return out.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept")


def _cases() -> str:
    return ", ".join(f"{{'f': '{f}', 'c': CAST({c} AS DOUBLE), 'x': {f}}}" for f, cs in GRID.items() for c in cs)


#: The statistics, the cutoffs and the verdicts. Documents d(doc_id, text, lang); labels l(doc_id, quality).
VERDICT_CTES = r"""
wd AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') ws,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM wd WHERE len(ws) >= 5)),
reps AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) n FROM reps, (SELECT unnest(range(0, 5)) j) GROUP BY doc_id),
st AS (SELECT wd.*, CAST(len(ws) AS BIGINT) n_words, CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) word_chars,
       CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
       CAST(length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g')) AS BIGINT) n_marks,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) n_repeat_words
       FROM wd LEFT JOIN cov USING (doc_id)),
ft AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(lang, '') stratum,
       n_symbols / greatest(n_words, 1e0) symbol_ratio, n_dup_lines / greatest(len(ls), 1e0) dup_line_ratio, n_repeat_words / greatest(n_words, 1e0) repeat_ratio,
       word_chars / greatest(n_words, 1e0) word_length, n_marks / greatest(n_words, 1e0) mark_ratio FROM st),
lab AS (SELECT ft.* FROM ft JOIN (SELECT doc_id FROM l WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id) WHERE NOT base_failed),
cell AS (SELECT stratum, count(*) n, s.f feature, s.c cutoff, count(*) FILTER (WHERE s.x > s.c) k
         FROM (SELECT stratum, unnest([@CASES@]) s FROM lab) GROUP BY ALL),
tail AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(@RISK@) + (n - i) * ln(1 - @RISK@)))
                    FROM (SELECT unnest(range(0, k + 1)) i)) p FROM cell),
ok AS (SELECT stratum, feature, min(cutoff) cutoff FROM tail, (SELECT count(DISTINCT stratum) * @NF@ pairs FROM cell) WHERE p <= @DELTA@ / pairs GROUP BY ALL),
bad AS (SELECT DISTINCT ft.doc_id FROM ft JOIN ok USING (stratum) WHERE
        CASE feature WHEN 'symbol_ratio' THEN symbol_ratio WHEN 'dup_line_ratio' THEN dup_line_ratio WHEN 'repeat_ratio' THEN repeat_ratio
        WHEN 'word_length' THEN word_length ELSE mark_ratio END > cutoff),
verdict AS (SELECT ft.*, NOT base_failed AND bad.doc_id IS NULL AS kept FROM ft LEFT JOIN bad ON bad.doc_id = ft.doc_id)
"""
VERDICT_CTES = (
    VERDICT_CTES.replace("@CASES@", _cases()).replace("@RISK@", "2e-2").replace("@DELTA@", "5e-2").replace("@NF@", str(len(GRID)))
)
OP4_SQL = f"""WITH d AS (SELECT * FROM documents), l AS (SELECT * FROM labels), {VERDICT_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"""
