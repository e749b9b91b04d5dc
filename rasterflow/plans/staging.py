"""Lineage cuts: rows that several later steps read are written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed to the folder that spark.checkpoint.dir or the context names, so that it is computed once and a lost
    executor repeats no earlier step; df itself, computed again by each reader, where no folder is named."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            return df
        context.setCheckpointDir(named)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share. Where none is named, a local one does for a session of one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rasterflow-")
    return f"{root.rstrip('/')}/rasterflow/{uuid.uuid4().hex}"
