"""Streaming operators run over the event table until it is read; their rows equal the batch forms up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.plans.manufacturing import query
from kilnworks.sources import snapshots
from kilnworks.sources.fixtures import PROJECTION, Plant
from kilnworks.sources.shared import work_folder
from kilnworks.streaming import stateful

LATE_H, IDLE_S = 1, 30 * 86_400


def events(p: Plant) -> DataFrame:
    """The telemetry projection of a stream over the event table."""
    path = f"{p.sf_dir}/events.parquet"  # a stream reads folders or patterns, no single file
    p.spark.readStream.schema(p.spark.read.parquet(path).schema).parquet(f"{path}*").createOrReplaceTempView("events_stream")
    return p.spark.sql(PROJECTION["telemetry"].replace("from events", "from events_stream"))


def ran(p: Plant, stream: DataFrame, name: str) -> DataFrame:
    """What a stream writes until its source is read."""
    folder = work_folder(p.spark, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return p.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def closed_bins(p: Plant) -> DataFrame:
    tie = F.lpad(F.col("event_id").cast("string"), 20, "0")
    made = ran(p, stateful.closed_bins(events(p), "equipment_id", "event_timestamp", 3600, ["tp2"], ["comp"], 3, tie=tie, late=f"{LATE_H} hours", idle_s=IDLE_S), "st1")
    last = F.max(F.when(F.col("samples") > 0, F.col("bin"))).over(Window.partitionBy("equipment_id"))  # bins after the last row are no part of the batch form
    return made.withColumn("_last", last).filter("bin <= _last").withColumnRenamed("samples", "n")


_CLOSED = f"(select to_timestamp(floor((epoch(max(event_timestamp)) - {LATE_H} * 3600) / 3600) * 3600)::timestamp from telemetry)"
query(
    "st1_closed_bins",
    "equipment_id bin n tp2_mean~ tp2_std~ tp2_min~ tp2_max~ tp2_last~ tp2_first~ tp2_move~ comp_active~ comp_transitions",
    f"""select equipment_id, bin, n, m tp2_mean, sd tp2_std, lo tp2_min, hi tp2_max, la tp2_last, fi tp2_first, mv tp2_move, ac comp_active, cast(trs as bigint) comp_transitions
  from (select *, max(case when n > 0 then bin end) over (partition by equipment_id) last_bin from bins where bin < {_CLOSED}) b where bin <= last_bin""",
)(closed_bins)

query(
    "st2_ordered_alerts",
    "equipment_id event_timestamp alert start",
    f"""select equipment_id, event_timestamp, alert, alert and not coalesce(lag(alert) over (partition by equipment_id order by event_timestamp, comp), false) start from
  (select *, sum(comp) over w >= 2 and count(*) over w = 3 alert from telemetry where event_timestamp is not null window w as (partition by equipment_id order by event_timestamp, comp rows between 2 preceding and current row)) a
  where epoch_us(event_timestamp) <= (select floor((epoch_us(max(event_timestamp)) - {LATE_H} * 3600000000) / 1000) * 1000 from telemetry)""",
)(lambda p: ran(p, stateful.ordered_alerts(events(p).withColumn("hot", F.col("comp") == 1), "equipment_id", "event_timestamp", "hot", 2, 3, late=f"{LATE_H} hours", idle_s=IDLE_S), "st2").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz")))


def daily_upsert(p: Plant) -> DataFrame:
    """Daily units of each equipment, added up by a stream in a versioned table."""
    folder = work_folder(p.spark, "st4")
    table = snapshots.SnapshotTable(p.spark, f"{folder}/table", "day")
    rows = events(p).select(F.to_date("event_timestamp").alias("day"), "equipment_id", F.lit(1).cast("long").alias("events"), F.col("comp").cast("long").alias("errors"))
    snapshots.upsert_stream(rows, table, ["equipment_id"], ["events", "errors"], f"{folder}/checkpoint").awaitTermination()
    return table.read().select(F.col("day").cast("string").alias("day"), "equipment_id", "events", "errors")


query("st4_daily_upsert", "day equipment_id events errors", "select cast(cast(event_timestamp as date) as varchar) as day, equipment_id, count(*) events, cast(sum(comp) as bigint) errors from telemetry group by 1, 2")(daily_upsert)
