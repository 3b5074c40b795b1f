"""Streaming forms of the causal telemetry operators; each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def binned(stream: DataFrame, entity: str, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, spread and bounds of each closed bin; rows later than `late` are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp_ltz")).withWatermark(ts, late)
    made = timed.groupBy(entity, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return made.select(entity, F.col("w.start").alias("bin"), "n", "mean", "std", "least", "most")


def distinct_rows(stream: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp_ltz")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def k_of_n_alerts(stream: DataFrame, entity: str, ts: str, flag: str, k: int, n: int) -> DataFrame:
    """Rows with alert (k of the last n flags of the entity) and start (first alert of a run), in order of time inside a batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags, before = list(state.get[0]) if state.exists else [], bool(state.get[1]) if state.exists else False
        rows = pd.concat(list(parts)).sort_values(ts)
        alerts, starts = [], []
        for hot in rows[flag]:
            flags = [*flags, int(bool(hot))][-n:]
            alert = len(flags) == n and sum(flags) >= k
            alerts.append(alert)
            starts.append(alert and not before)
            before = alert
        state.update((flags, before))
        yield pd.DataFrame({entity: [key[0]] * len(rows), ts: list(rows[ts]), "alert": alerts, "start": starts})

    kind = dict(stream.dtypes)
    out = f"{entity} {kind[entity]}, {ts} {kind[ts]}, alert boolean, start boolean"
    return stream.select(entity, ts, flag).groupBy(entity).applyInPandasWithState(step, out, "flags array<int>, before boolean", "append", GroupStateTimeout.NoTimeout)


def upsert_daily(stream: DataFrame, path: str, keys: list[str], sums: list[str], checkpoint: str, day: str = "day"):
    """Starts a stream that adds the sums of each batch to the daily rows at path, partitioned by day.

    A batch rewrites only the days that it touches. Rows remember the last batch that they hold, so a batch that runs
    again after a lost driver or executor is not added twice.
    """
    part = [day, *keys]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(*part).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("batch", F.lit(number).cast("long"))
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            held = spark.read.schema(fresh.schema).parquet(path).join(fresh.select(day).distinct(), day, "left_semi")
            new = fresh.withColumnsRenamed({c: f"new_{c}" for c in [*sums, "batch"]})
            again = F.col("batch") >= number
            total = {c: F.when(F.coalesce(again, F.lit(False)), F.col(c)).otherwise(F.coalesce(F.col(c) + F.col(f"new_{c}"), F.col(c), F.col(f"new_{c}"))) for c in sums}
            both = held.join(new, part, "full").withColumns(total | {"batch": F.greatest("batch", "new_batch")})
            fresh = both.select(*part, *sums, "batch")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return stream.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
