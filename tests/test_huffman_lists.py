"""Lists of codes are made in their row, not collected from rows."""

from rasterflow.plans.catalog import all_queries


def test_huffman_lists_are_made_in_their_row(spark, tmp_path):
    spark.createDataFrame([(k, 1 + k) for k in range(4)], "p_partkey bigint, p_size bigint").write.parquet(str(tmp_path / "part.parquet"))
    assert "collect_list" not in all_queries()["huffman_tables"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
