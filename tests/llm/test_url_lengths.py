from itertools import combinations

from pyspark.sql import functions as F

from rasterflow.llm import url_rules


def test_rules_of_four_tokens_stay_and_shorter_parts_decide_alike(spark):
    four = ("a", "b", "c", "d")
    rows = [(list(four), True)] * 100 + [(list(three), False) for three in combinations(four, 3) for _ in range(20)]
    rows += [(["x", "y"], True)] * 50
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), url_rules.Mining(support=0.05))
    assert sorted(tuple(r.rule_tokens) for r in mined.collect()) == [four, ("x",), ("y",)]
    assert mined.where(F.element_at("rule_tokens", -1) != F.col("key")).count() == 0
