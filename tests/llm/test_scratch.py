"""Tables between steps."""

import os
import time

from pyspark.sql import functions as F

from kilnworks.llm.scratch import FREED, cut, drop, shared_dir


def _shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_shuffle_files_of_a_written_step_are_removed(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(FREED, None)
    made = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert made.count() == 7 and spark.conf.get(FREED, None) == setting


def test_only_written_tables_are_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    own, made, other = spark.read.parquet(f"{tmp_path}/own"), cut(spark.range(5), "made"), cut(spark.range(7), "other")
    drop(own, made, spark.range(2))
    left = os.listdir(shared_dir(spark).removeprefix("file:"))
    assert made.written_to.rpartition("/")[2] not in left and other.written_to.rpartition("/")[2] in left
    assert own.count() == 3 and other.count() == 7
