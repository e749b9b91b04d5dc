import duckdb
import pytest

from rasterflow.plans.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "part", "nation", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_its_sql(spark, duck, name):
    got = all_queries()[name](spark, SF)
    want = duck.sql(all_oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect())))
    assert rows == sorted(map(str, want.select(*cols).fetchall()))
    assert rows


def wire_form(lengths):
    """Code lengths as tokens, walked one by one."""
    out, i = [], 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i]:
            out.append((lengths[i], 0, 0))
            n -= 1
        for token, least, most, bits in ((18, 11, 138, 7), (17, 3, 10, 3)) if not lengths[i] else ((16, 3, 6, 2),):
            while n >= least:
                out.append((token, min(n, most) - least, bits))
                n -= min(n, most)
        out += [(lengths[i], 0, 0)] * n
        i = j
    return out


def test_code_length_tokens(spark):
    import random

    from rasterflow.operators import entropy

    r = random.Random(1)
    rows, want = [], {}
    for key in range(60):
        lengths = [v for _ in range(r.randint(1, 8)) for v in [r.choice([0, 0, 1, 5])] * r.choice([1, 2, 3, 7, 10, 11, 12, 138, 139, 141, 148, 149, 150, 290])]
        rows += [(key, i, v) for i, v in enumerate(lengths)]
        want[key] = wire_form(lengths)
    found = entropy.runs(spark.createDataFrame(rows, "key int, at int, value int"), "key", "at", "value")
    got = {}
    for t in sorted(entropy.code_length_tokens(found).collect()):
        got.setdefault(t.key, []).append((t.token, t.extra, t.bits))
    assert got == want
