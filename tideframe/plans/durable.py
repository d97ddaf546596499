"""Reliable intermediate tables.

Iterative jobs and chunk maps must not change when an executor is lost, so their
intermediate tables are written to the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context); a scratch folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tideframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
