"""Tables between the steps of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark remove the shuffle files of a query when it ends, not when the driver collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session on one machine may go without that setting."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kilnworks-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so later steps don't repeat its lineage; its shuffle files go at once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that `cut` returned and that no later step reads; others are left alone."""
    for table in tables:
        if "written_to" in vars(table):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
