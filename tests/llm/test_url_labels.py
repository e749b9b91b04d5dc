"""Rules mined from labelled URLs of their own decide URLs that no fixed rule fits."""

from rasterflow.llm import url_rules


def test_mined_rules_block_and_spare(spark):
    made = [(f"http://s{k % 5}.biz/pills/buy{k}?ref=x", True) for k in range(60)] + [(f"http://s{k % 5}.biz/news/n{k}?ref=x", False) for k in range(60)]
    made += [(f"http://s{k % 5}.biz/pills/study/s{k}", False) for k in range(40)] + [(None, True), ("no url", None)]
    labels = spark.createDataFrame(made, "url string, blocked boolean").repartition(3)
    want = {
        "http://s1.biz/pills/new?ref=x": "block",  # pills and ref=x together: neither is a rule by itself
        "http://s1.biz/news/new?ref=x": "allow",
        "http://s1.biz/pills/study/new": "allow",
        "http://quiet.info/about": "allow",
        "http://a.net/es/pills": "block",  # a fixed rule
        "http://x.com/pills/a?ref=x": "allow",  # a fixed rule comes first
    }
    pages = spark.createDataFrame([(u, 1) for u in want] + [("http://s1.biz/pills/new?ref=x", 2)], "url string, host int")
    got = url_rules.url_rules(pages, mining=url_rules.Mining(0.05, 0.95), labels=labels).collect()
    assert {r.url: r.verdict for r in got} == want and len(got) == len(want) + 1
    mined = {tuple(r.rule_tokens) for r in url_rules.mine(url_rules.labelled_tokens(labels), url_rules.Mining(0.05, 0.95)).collect()}
    assert ("p0:pills", "q:ref=x") in mined and not any("h0:biz" in t for t in mined if len(t) == 1)
    none = url_rules.url_rules(pages, labels=labels.limit(0)).where("rule IS NULL").collect()
    assert {r.verdict for r in none} == {"allow"}
