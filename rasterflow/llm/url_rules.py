"""URL filters [native]: association-rule filtering.

URLs become baskets of tokens (host labels with their distance from the end, path segments, parameters of the query);
those labelled "block" get a class item too. URLs without a label stay in as background, so that a token which is merely
common among the labels gains no confidence. FP-growth finds the frequent combinations; rules "tokens => block" pruned by
support and confidence decide the other URLs. Matching goes through an inverted index: a rule is filed under one of its
tokens, a URL looks up its own tokens and then tests the rest of each rule found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import ascii_lower, pinned, table

#: (rule, verdict) of the contract: host and path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BLOCK = "=block"


@dataclass(frozen=True)
class Mining:
    """Least share of all URLs that a rule and the class have together, and least confidence."""

    support: float = 0.002
    confidence: float = 0.95


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty where the URL is null or has no '://'; only A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def query_of(url: Column) -> Column:
    """The query between '?' and '#': empty where the URL is null, has no '://' or no query."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: host labels as h<distance from the end>:<label>, path segments as p<place>:<segment>, from the third
    on without their place as p:<segment>, and parameters of the query as q:<parameter>."""
    filled = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    labels, parts = F.reverse(filled(host, r"\.")), filled(path, "/")
    name = lambda kind: lambda x, i: F.concat(F.lit(kind), i.cast("string"), F.lit(":"), x)
    plain = lambda kind: lambda x: F.concat(F.lit(kind), x)
    deep = F.transform(F.slice(parts, 3, F.size(parts)), plain("p:"))
    return F.array_distinct(F.concat(F.transform(labels, name("h")), F.transform(F.slice(parts, 1, 2), name("p")), deep, F.transform(filled(query, "&"), plain("q:"))))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules from rows (tokens, blocked): tokens, key (the token that files it). No rows, no rules.

    Rules of all lengths stay, but for those that are a rule without one of their tokens too: that one decides the same URLs.
    """
    baskets = labelled.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BLOCK).select(F.sort_array("antecedent").alias("rule_tokens"))
    parts = found.select("rule_tokens", F.explode(F.transform("rule_tokens", lambda t: F.array_remove("rule_tokens", t))).alias("part"))
    longer = parts.join(found.select(F.col("rule_tokens").alias("part")), "part", "left_semi").select("rule_tokens")
    return found.join(longer, "rule_tokens", "left_anti").withColumn("key", F.element_at("rule_tokens", -1))


def labelled_tokens(labels: DataFrame) -> DataFrame:
    """Rows (tokens, blocked) of labelled URLs (url, blocked); a null label counts as not blocked."""
    host, path = split_url(F.col("url"))
    return labels.select(tokens(host, path, query_of(F.col("url"))).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def url_rules(pages: DataFrame, url_col: str = "url", rules=RULES, mining: Mining = Mining(), labels: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict, n_mined (mined rules that match).

    Rules are mined from ``labels`` (url, blocked) alone where they are given. Without, the URLs that a fixed rule decides
    are the labels and the others the background. A mined rule blocks a URL that no fixed rule fits, else it is allowed.
    Null URLs and those without '://' have an empty host and path, no tokens, and are allowed. Repeated rows are judged
    alike. Columns of ``pages`` with the names of new ones are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "n_mined")
    host, path = split_url(F.col(url_col))
    cut = pages.withColumn("host", pinned(host)).withColumn("path", pinned(path))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("_said", verdict).withColumn("_tokens", pinned(tokens(F.col("host"), F.col("path"), query_of(F.col(url_col)))))
    own = cut.select(F.col("_tokens").alias("tokens"), (F.col("_said") == "block").alias("blocked"))
    mined = mine(own if labels is None else labelled_tokens(labels), mining)
    # one index entry for each filing token: its rules; their number is bounded by 1 / support and the tokens of a URL
    index = mined.groupBy("key").agg(F.collect_list("rule_tokens").alias("rules"))
    index = index.agg(F.map_from_entries(F.collect_list(F.struct("key", "rules"))).alias("_index"))
    judged = cut.crossJoin(F.broadcast(index))  # one row
    hits = lambda t: F.filter(F.coalesce(F.col("_index")[t], F.array().cast("array<array<string>>")), lambda r: F.size(F.array_except(r, F.col("_tokens"))) == 0)
    n = F.aggregate(F.col("_tokens"), F.lit(0), lambda a, t: a + F.size(hits(t)))
    out = judged.withColumn("n_mined", pinned(n).cast("long"))
    return out.withColumn("verdict", F.coalesce("_said", F.when(F.col("n_mined") > 0, F.lit("block")).otherwise("allow"))).drop("_said", "_tokens", "_index")


def op5(spark, sf_dir):
    """Every URL of pages: page_id, host, path, rule, verdict."""
    return url_rules(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _fits() -> str:
    cases = []
    for text, _ in sorted(RULES, key=lambda r: -len(r[0])):
        at = text.index("/")
        cases.append(f"WHEN (host = '{text[:at]}' OR ends_with(host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}') THEN '{text}'")
    return "CASE " + " ".join(cases) + " END"


#: Any subset of a URL's tokens that is a rule blocks it, so rules need no pruning here; only tokens that are frequent among
#: blocked URLs can be in a rule, and subsets are the bits of a number.
OP5_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) query FROM u),
r AS (SELECT *, {_fits()} rule, list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')) hs, list_filter(string_split(path, '/'), lambda x: x <> '') ps,
      list_filter(string_split(query, '&'), lambda x: x <> '') qs FROM p),
t AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END said FROM r),
tk AS (SELECT page_id, said, 'h' || (i - 1) || ':' || hs[i] tok FROM (SELECT *, unnest(range(1, len(hs) + 1)) i FROM t)
       UNION SELECT page_id, said, CASE WHEN i <= 2 THEN 'p' || (i - 1) ELSE 'p' END || ':' || ps[i] FROM (SELECT *, unnest(range(1, len(ps) + 1)) i FROM t)
       UNION SELECT page_id, said, 'q:' || unnest(qs) FROM t),
least AS (SELECT ceil(2e-3 * count(*)) k FROM t),
often AS (SELECT tok FROM tk GROUP BY tok HAVING count(*) FILTER (WHERE said = 'block') >= (SELECT k FROM least)),
own AS (SELECT page_id, any_value(said) said, list(tok ORDER BY tok) s FROM tk SEMI JOIN often USING (tok) GROUP BY page_id),
sets AS (SELECT page_id, said, list_filter(s, lambda x, i: (m >> CAST(i - 1 AS BIGINT)) & 1 = 1) s FROM (SELECT *, unnest(range(1, 1 << len(s))) m FROM own)),
freq AS (SELECT s, count(*) n, count(*) FILTER (WHERE said = 'block') k FROM sets GROUP BY s),
mined AS (SELECT s FROM freq WHERE k >= (SELECT k FROM least) AND k >= 95e-2 * n),
hit AS (SELECT DISTINCT page_id FROM sets JOIN mined USING (s))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) verdict FROM t LEFT JOIN hit USING (page_id)
"""
