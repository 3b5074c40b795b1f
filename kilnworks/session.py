"""Session settings that every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable between engines; NTZ matches Parquet files without a zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    conf = SETTINGS | {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
    }
    return SparkSession.builder.appName("kilnworks").config(map=conf | extra).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
