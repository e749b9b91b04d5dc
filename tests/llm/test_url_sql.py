"""The SQL of URL rules against the operator on deep paths, queries and rules of several tokens."""

import random

import duckdb

from rasterflow.llm import url_rules


def test_sql_and_operator_agree_on_deep_paths(spark, tmp_path):
    rng = random.Random(11)
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/a?x=1#y", "http://a.net/es/?&&q=1", "http://..net//es//x"]
    for k in range(400):
        host = rng.choice(["a.org", "b.a.org", "c.net", "example.com", "www.example.com", "d.e.com"])
        path = "/".join(rng.choice(["en", "es", "fr", "x", "spam", "deep"]) for _ in range(rng.randrange(5)))
        urls.append(f"http://{host}/{path}" + rng.choice(["", "?ad=1", "?ad=1&b=2", "#f?ad=1"]))
    urls += [f"http://s{k}.net/es/x/spam/{k}?ad=1" for k in range(300)] + ["http://t.org/en/x/spam/9?ad=1", "http://t.org/es/x/spam/9?ad=1", "http://t.org/es/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in url_rules.op5(spark, f"file://{tmp_path}").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = set(con.execute(url_rules.OP5_SQL).fetchall())
    assert got == want and len(got) == len(urls)
    open_ones = {r[4] for r in got if r[3] is None}
    assert open_ones == {"allow", "block"}  # mined rules decide here
