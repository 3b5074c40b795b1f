"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark remove the shuffle files of a query when it ends, not when the driver collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a session on one machine may go without that setting."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kilnworks-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for plans that read it more than once; its shuffle files go at once."""
    path, conf = work_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
