"""Shared helpers: table access, white space, staged tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The same class as a Java and RE2 pattern.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def pinned(c: Column) -> Column:
    """c, computed once where it stands: the optimiser neither copies it into its consumers nor moves filters below it.

    Filters on costly expressions are otherwise pushed through every projection, and copied into lambdas, which then
    compute them again for each array element. The condition always holds; being non-deterministic it only pins.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


#: Most partitions of a shuffle by bucket or block; beyond it a task walks several of them, one after the other.
MOST_PARTITIONS = 20_000


def work_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir. Where that is unset, a local folder will do for a session of
    one process; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rasterflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the written table: a lineage cut that survives lost executors.

    The folder is the job's; whoever runs the job removes it afterwards, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/rasterflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this write go with its end: nothing reads them again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
