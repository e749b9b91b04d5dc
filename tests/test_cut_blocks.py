import duckdb
import pytest

from rasterflow.operators import transforms
from rasterflow.plans.catalog import all_oracles, all_queries

ROWS = "vec_id bigint, embedding array<float>"


def component(i, k):
    return ((i * 37 + k * 11) % 200 - 100) / 150


@pytest.mark.parametrize("query", ["forward_dct", "inverse_dct", "forward_wht", "inverse_wht"])
def test_blocks_cut_off_by_the_edge_are_as_in_the_sql(spark, tmp_path, query):
    """A last image of two rows, one of 62 columns, and one without a sample: all their blocks have rows in the SQL."""
    made = [(i, [component(i, k) for k in range(64)]) for i in range(18)] + [(i, [component(i, k) for k in range(62)]) for i in range(32, 36)]
    made += [(i, [None] * 8) for i in range(48, 52)] + [(64, None)]
    spark.createDataFrame(made, ROWS).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = con.execute(all_oracles()[query]).fetchall()
    got = [tuple(r) for r in all_queries()[query](spark, str(tmp_path)).select("image_id", "by", "bx", "s").collect()]
    assert len(got) == 64 + 16 + 16 + 2
    assert sorted(got, key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])


def test_cut_blocks_are_dropped_unless_asked_for(spark):
    pixels = spark.createDataFrame([(0, y, x, 1 + y * 6 + x) for y in range(4) for x in range(6)], "image_id bigint, y bigint, x bigint, v bigint")
    s = lambda cut: {r.bx: r.s for r in transforms.block_arrays(pixels, "v", cut=cut).collect()}
    whole = [1 + y * 6 + x for y in range(4) for x in range(4)]
    assert s("drop") == {0: whole}
    assert s("null") == {0: whole, 1: [v for y in range(4) for v in (5 + 6 * y, 6 + 6 * y, None, None)]}
    assert s("zero") == {0: whole, 1: [v for y in range(4) for v in (5 + 6 * y, 6 + 6 * y, 0, 0)]}
