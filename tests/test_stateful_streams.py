"""Stateful streams against their batch forms, on rows that arrive in any order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import telemetry
from kilnworks.sources.fixtures import Plant
from kilnworks.streaming import stateful

SF = "/root/testdata/sf0.001"
FAR = dt.datetime(2030, 1, 1)


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def parts_of(spark, rows, schema, folder, files):
    """Files of the given rows, one after the other."""
    for k, some in enumerate(files):
        made = spark.createDataFrame([rows[i] for i in some], schema).coalesce(1)
        made.write.parquet(f"{folder}/{k:03d}")
    return f"{folder}/*"


def run(spark, build, schema, source, where, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, spark.table(name)


SCHEMA = "e long, t timestamp_ntz, hot boolean"


def test_alerts_are_the_same_in_any_order(spark, tmp_path):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 1, 0, 1]
    rows = [(1, at(k), bool(f)) for k, f in enumerate(flags)] + [(2, at(3 * k), k % 4 != 0) for k in range(12)]
    batch = spark.createDataFrame(rows, SCHEMA)
    want = batch.withColumn("alert", telemetry.k_of_n(batch, "e", "t", F.col("hot"), 2, 3))
    want = want.withColumn("start", telemetry.episode_starts("e", "t", "alert")).select("e", "t", "alert", "start")
    # Three files: even rows, then odd ones, then a row far ahead that lets the watermark pass all others.
    files = [list(range(0, len(rows), 2)), list(range(1, len(rows), 2)), [len(rows)]]
    source = parts_of(spark, [*rows, (9, FAR, True)], SCHEMA, tmp_path / "in", files)
    _, got = run(spark, lambda s: stateful.ordered_alerts(s, "e", "t", "hot", 2, 3, late="2 hours"), SCHEMA, source, f"{tmp_path}/c", "ordered")
    made = sorted((r.e, r.t.replace(tzinfo=None), r.alert, r.start) for r in got.collect())
    assert made == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_and_state_goes_away(spark, tmp_path):
    rows = [(1, at(0), True), (1, at(1), True), (1, at(2), True), (2, at(600), False), (1, at(1), True), (2, at(5000), True), (2, at(9000), True), (2, at(9001), True)]
    source = parts_of(spark, rows, SCHEMA, tmp_path / "in", [[0, 1, 2], [3], [4], [5], [6], [7]])
    query, got = run(spark, lambda s: stateful.ordered_alerts(s, "e", "t", "hot", 2, 2, late="1 minute", idle_s=3600), SCHEMA, source, f"{tmp_path}/c", "expiring")
    made = sorted((r.e, r.alert, r.start) for r in got.collect())
    assert [r for r in made if r[0] == 1] == [(1, False, False), (1, True, False), (1, True, True)]
    dropped = [sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert sum(dropped) == 1
    # Entity 1 has been idle for more than an hour of event time: only entity 2 still has memory.
    state = spark.read.format("statestore").option("stateVarName", "memory").load(f"{tmp_path}/c")
    assert {r[0][0] for r in state.select("key").collect()} == {2}


@pytest.mark.parametrize("late", ["400 days"])
def test_bins_equal_the_batch_form(spark, tmp_path, late):
    rows = Plant(spark, SF).telemetry.select("equipment_id", "event_timestamp", "event_id", "tp2", "comp")
    schema = rows.schema
    rows = rows.withColumn("tp2", F.when(F.col("event_id") % 7 != 0, F.col("tp2")))  # some values are missing
    rows.repartition(3, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/in/a")
    ahead = spark.createDataFrame([(77, dt.datetime(2090, 1, 1), 1, 0.0, 0)], schema)
    ahead.write.parquet(f"{tmp_path}/in/b")
    build = lambda s: stateful.closed_bins(s, "equipment_id", "event_timestamp", 3600, ["tp2"], ["comp"], 3, tie=F.lpad(F.col("event_id").cast("string"), 20, "0"), late=late, idle_s=7200)
    _, got = run(spark, build, schema, f"{tmp_path}/in/*", f"{tmp_path}/c", "bins_seen")
    clean = telemetry.clean_series(spark.read.parquet(f"{tmp_path}/in/a"), "equipment_id", "event_timestamp", ["event_id"])
    want = telemetry.bin_features(clean, "equipment_id", "event_timestamp", "1 hour", ["tp2"], ["comp"], 3)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    mine = {(r.equipment_id, r.bin): tuple(plain(r[c]) for c in columns) for r in got.collect()}
    theirs = {(r.equipment_id, r.bin): tuple(plain(r[c]) for c in columns) for r in want.collect()}
    seen = {k: v for k, v in theirs.items() if k in mine}
    assert {k: mine[k] for k in seen} == seen
    # Gaps longer than the idle time end a grid, all other bins of the batch form are there.
    missing = [k for k in theirs if k not in mine]
    assert all(theirs[k][columns.index("samples")] == 0 for k in missing)
