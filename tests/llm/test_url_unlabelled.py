from rasterflow.llm import url_rules


def test_mined_rules_decide_unlabelled_urls(spark):
    groups = [("http://bad.org/spam", 100), ("http://good.org/fine", 100), ("http://new.net/spam", 2), ("http://new.net/fine", 2)]
    pages = spark.createDataFrame([(u,) for u, n in groups for _ in range(n)], "url string")
    out = url_rules.url_rules(pages, rules=(("bad.org/", "block"), ("good.org/", "allow")), mining=url_rules.Mining(support=0.1))
    assert {r.url: (r.rule, r.verdict) for r in out.collect()} == {
        "http://bad.org/spam": ("bad.org/", "block"), "http://good.org/fine": ("good.org/", "allow"),
        "http://new.net/spam": (None, "block"), "http://new.net/fine": (None, "allow"),
    }
