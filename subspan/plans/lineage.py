"""Cutting lineage and naming scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the checkpoint folder set; a temporary one only where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (see durable)."""
    return f"{_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint, which survives lost executors.

    The folder is spark.checkpoint.dir. A session without one gets a temporary folder if it runs on
    one machine (a test), and an error if it runs on a cluster. The shuffle files of the plan go as
    soon as the checkpoint stands; else they stay until the driver happens to collect its garbage,
    and on a large input the disk holds those of all steps.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_root(spark))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        spark.conf.set(CLEANUP, before)
