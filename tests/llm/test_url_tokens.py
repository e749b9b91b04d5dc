import pytest

from rasterflow.llm import url_rules

RULES = (("bad.org/", "block"), ("good.org/", "allow"))


def verdicts(spark, groups, **mining):
    """Verdict of the URL of each group (url, count)."""
    rows = [(u,) for u, n in groups for _ in range(n)]
    out = url_rules.url_rules(spark.createDataFrame(rows, "url string").repartition(4), rules=RULES, mining=url_rules.Mining(**mining))
    return {r.url: r.verdict for r in out.collect()}


@pytest.mark.parametrize("good, bad", [("a/b/fine", "a/b/spam"), ("a/b/c/d/fine", "a/b/c/d/spam"), ("a/b?x=1&to=fine", "a/b?x=1&to=spam#z")])
def test_rules_reach_deep_segments_and_the_query(spark, good, bad):
    got = verdicts(spark, [(f"http://bad.org/{bad}", 100), (f"http://good.org/{good}", 100), (f"http://new.net/{bad}", 2), (f"http://new.net/{good}", 2)], support=0.1)
    assert got[f"http://new.net/{bad}"] == "block"
    assert got[f"http://new.net/{good}"] == "allow"
