"""Versioned tables: losses at each step, two writers, repeated batches and removal of old versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kilnworks.sources import snapshots

KIND = "day date, site long, units long"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


class Lost(Exception):
    pass


class Fragile(snapshots.SnapshotTable):
    """Loses the driver at the named step."""

    lose = None

    def _step(self, name):
        if name == self.lose:
            raise Lost(name)


def rows_of(table, number=None):
    made = table.read(number)
    return None if made is None else sorted(map(tuple, made.collect()), key=str)


def test_a_loss_at_any_step_leaves_the_old_rows_or_the_new(spark, tmp_path):
    table = Fragile(spark, f"{tmp_path}/t", "day")
    assert rows_of(table) is None
    first = [(day(0), 1, 5), (day(1), 1, 6), (None, 2, 7)]
    table.commit(spark.createDataFrame(first, KIND), table.version())
    old = rows_of(table)
    assert old == sorted(first, key=str)
    new = spark.createDataFrame([(day(1), 1, 60), (day(2), None, 8)], KIND)
    for step in ("data", "version"):
        table.lose = step
        with pytest.raises(Lost):
            table.commit(new, table.version())
        assert rows_of(Fragile(spark, f"{tmp_path}/t", "day")) == old
    table.lose = None
    made = table.commit(new, table.version())
    assert rows_of(table) == sorted([first[0], first[2], (day(1), 1, 60), (day(2), None, 8)], key=str)
    assert made.number == 3  # the half-written second version is passed over
    assert rows_of(table, 1) == old  # the earlier version can still be read
    gone = table.vacuum(keep=1)
    assert len(gone) == 2  # what the lost commits had written
    assert rows_of(table) == sorted([first[0], first[2], (day(1), 1, 60), (day(2), None, 8)], key=str)


def test_a_second_writer_is_told_and_update_tries_again(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, f"{tmp_path}/t", "day")
    table.commit(spark.createDataFrame([(day(0), 1, 1)], KIND), table.version())
    base = table.version()
    table.commit(spark.createDataFrame([(day(1), 1, 2)], KIND), base)
    with pytest.raises(snapshots.Conflict):
        table.commit(spark.createDataFrame([(day(2), 1, 3)], KIND), base)
    calls = []

    def change(held, version):
        calls.append(version.number)
        if len(calls) == 1:  # somebody else commits meanwhile
            table.commit(spark.createDataFrame([(day(5), 1, 9)], KIND), version)
        return held.filter(F.col("day") == F.lit(day(0))).withColumn("units", F.col("units") + 100), [str(day(0))]

    table.update(change)
    assert calls == [2, 3]
    assert rows_of(table) == [(day(0), 1, 101), (day(1), 1, 2), (day(5), 1, 9)]


def test_stream_batches_count_once_whatever_is_lost(spark, tmp_path):
    src, where = f"{tmp_path}/in", f"{tmp_path}/t"
    files = [[(day(0), 1, 5), (day(0), None, 1), (day(1), 1, 2)], [(day(0), 1, 10), (None, 1, 4)], [(day(1), 1, 1), (day(0), None, 2)]]
    want = {}
    for k, some in enumerate(files):
        spark.createDataFrame(some, KIND).coalesce(1).write.parquet(f"{src}/{k}")
        for d, s, u in some:
            want[d, s] = want.get((d, s), 0) + u
    lost = iter(["data", "version", None, "data", None, None, None])

    class Unlucky(Fragile):
        def commit(self, *args, **marks):
            self.lose = next(lost)
            return super().commit(*args, **marks)

    for _ in range(8):
        table = Unlucky(spark, where, "day")
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        query = snapshots.upsert_stream(stream, table, ["site"], ["units"], f"{tmp_path}/c")
        try:
            query.awaitTermination()
            break
        except Exception as e:
            assert "Lost" in str(e)
    assert {(r.day, r.site): r.units for r in table.read().collect()} == want
    # The same batches again, as after a checkpoint that was lost once they were committed: nothing is added twice.
    snapshots.upsert_stream(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{src}/*"), snapshots.SnapshotTable(spark, where, "day"), ["site"], ["units"], f"{tmp_path}/c2").awaitTermination()
    assert {(r.day, r.site): r.units for r in table.read().collect()} == want
