"""A header is read from a file that is fetched from its row once."""

from pyspark.sql import functions as F

from rasterflow.operators import walks


def test_bmp_header_fetches_its_file_once(spark):
    files = spark.createDataFrame([(b"BM",)], "content binary")
    assert files.select(walks.bmp_header(F.col("content")).alias("h"))._jdf.queryExecution().optimizedPlan().toString().count("content#") <= 4
