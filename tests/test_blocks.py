"""Windows in blocks, sliding quantiles, selection and prefix sums against plain Python and plain windows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kilnworks.operators import blocks, ranks, telemetry

KIND = "e long, t timestamp_ntz, v double"


def series(seed=1, sizes=((1, 700), (2, 130), (None, 40), (3, 1))):
    rng, rows = random.Random(seed), []
    for entity, n in sizes:
        t = dt.datetime(2024, 1, 1)
        for _ in range(n):
            t += dt.timedelta(minutes=rng.choice([1, 5, 60, 60 * 24 * 9]))
            rows.append((entity, t, None if rng.random() < 0.1 else rng.choice([rng.random(), 0.5])))
    rng.shuffle(rows)
    return rows


def by_entity(rows):
    out = {}
    for e, t, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(e, []).append((t, v))
    return out


def test_places_are_those_of_the_whole_series(spark):
    rows = series()
    got = {(r.e, r.t): r.place for r in blocks.numbered(spark.createDataFrame(rows, KIND).repartition(5), "e", "t", "place").collect()}
    assert got == {(e, t): k for e, line in by_entity(rows).items() for k, (t, _) in enumerate(line)}


@pytest.mark.parametrize(("block", "halo"), [(10, 3), (7, 20), (1000, 1)])
def test_blocks_equal_windows_over_the_entity(spark, block, halo):
    df = spark.createDataFrame(series(), KIND)

    def looks(rows, keys):
        order = Window.partitionBy(*keys).orderBy("t")
        return rows.withColumns({"mean": F.avg("v").over(order.rowsBetween(-halo, 0)), "past": F.lag("v", halo).over(order), "n": F.count(F.lit(1)).over(order.rowsBetween(-halo, 0))})

    made = blocks.in_blocks(df, "e", "t", halo, looks, block=block)
    want = looks(df, ["e"])
    assert made.columns == want.columns
    key = lambda r: str(r)
    near = lambda rows: sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows), key=key)
    assert near(made.collect()) == near(want.collect())


def test_a_long_series_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("e"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id") * 10)).cast("timestamp_ntz").alias("t"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sized = lambda rows, keys: rows.withColumn("task", F.spark_partition_id()).withColumn("m", F.max("v").over(Window.partitionBy(*keys).orderBy("t")))
        seen = blocks.in_blocks(df, "e", "t", 5, lambda rows, keys: sized(rows.repartition(32, *keys), keys), block=500)
        held = [r["count"] for r in seen.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(held) == 20_000
    assert max(held) < 20_000 / 5


def test_sliding_quantiles_equal_numpy():
    rng = random.Random(4)
    for _ in range(40):
        values = [None if rng.random() < 0.1 else rng.choice([rng.random(), 0.5]) for _ in range(rng.randrange(1, 300))]
        lag, lookback, least = rng.randrange(20), rng.randrange(1, 60), rng.randrange(20)
        got = blocks.sliding_quantiles(values, [0, 0.5, 0.985, 1], lag, lookback, least)
        for i, made in enumerate(got):
            frame = [v for v in values[max(0, i - lag - lookback + 1) : max(0, i - lag + 1)] if v is not None]
            if len(frame) < max(least, 1):
                assert made is None
            else:
                assert made == pytest.approx(np.quantile(frame, [0, 0.5, 0.985, 1]).tolist(), abs=1e-12)


def test_sliding_order_splits_and_empties():
    order, held, rng = blocks.SlidingOrder(load=4), [], random.Random(2)
    for _ in range(2000):
        if held and rng.random() < 0.5:
            order.remove(held.pop(rng.randrange(len(held))))
        else:
            held.append(rng.randrange(50) / 7)
            order.add(held[-1])
        assert [order[k] for k in range(order.n)] == sorted(held)
    with pytest.raises(IndexError):
        order[order.n]


def test_thresholds_and_alerts_across_blocks(spark):
    rows = series(seed=9)
    df = spark.createDataFrame(rows, KIND)
    made = blocks.trailing_quantiles(df, "e", "t", "v", [0.9], 3, 20, 5, "q", block=30)
    got = {(r.e, r.t): r.q and r.q[0] for r in made.collect()}
    for e, line in by_entity(rows).items():
        for (t, _), want in zip(line, blocks.sliding_quantiles([v for _, v in line], [0.9], 3, 20, 5), strict=True):
            assert got[e, t] == (want and pytest.approx(want[0], abs=1e-12))
    hot = df.withColumn("hot", F.coalesce(F.col("v") > 0.45, F.lit(False)))
    small = telemetry.persistent_alerts(hot, "e", "t", "hot", 2, 3, block=10)
    plain = hot.withColumn("alert", telemetry.k_of_n(hot, "e", "t", F.col("hot"), 2, 3))
    plain = plain.withColumn("start", telemetry.episode_starts("e", "t", "alert"))
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert blocks.trailing_quantiles(df.limit(0), "e", "t", "v", [0.9], 3, 20, 5, "q").collect() == []


@pytest.mark.parametrize(("cells", "few"), [(4, 3), (1024, 10), (8, 100_000)])
def test_selection_equals_numpy(spark, cells, few):
    rng = random.Random(6)
    rows = [(rng.choice([1.5, rng.gauss(0, 1), 1e300 * rng.random()]), float(k % 3), None if k % 5 else -7.0, None) for k in range(900)] + [(float("nan"), 1.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = ranks.exact_quantiles(df, ["a", "b", "c", "d"], probabilities, cells=cells, few=few)
    for k, c in enumerate("abc"):
        known = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        assert got[c] == pytest.approx(np.quantile(known, probabilities).tolist(), rel=1e-12)
    assert got["d"] == [None] * 5


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_window(spark, descending):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("score"), F.col("id").alias("n"), (F.col("id") % 3).alias("pos")).dropDuplicates(["score"])
    order = F.desc("score") if descending else F.asc("score")
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("score", "n", "pos", F.sum("pos").over(window).alias("run_pos"), F.sum("n").over(window).alias("run_n"))
    made = ranks.running_totals(df, "score", ["pos", "n"], descending, ranges=16)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert ranks.running_totals(df.limit(0), "score", ["pos"]).collect() == []
    one = ranks.running_totals(df.limit(1), "score", ["n"]).first()
    assert one.run_n == one.n


def test_average_precision_of_ties_nulls_and_nothing(spark):
    kind = "hit boolean, z double"
    rows = [(True, 3.0), (False, 3.0), (True, 2.0), (False, 1.0), (True, 1.0), (True, None)]
    want = (1 / 4) * (1 / 2) + (1 / 4) * (2 / 3) + (1 / 4) * (3 / 5)
    known = [r for r in rows if r[1] is not None]
    got = telemetry.average_precision(spark.createDataFrame(known, kind), "hit", "z").first()[0]
    assert got == pytest.approx(want * 4 / 3)
    assert telemetry.average_precision(spark.createDataFrame([(False, 1.0)], kind), "hit", "z").first()[0] is None
    assert telemetry.average_precision(spark.createDataFrame([], kind), "hit", "z").first()[0] is None


def test_split_by_first_month_with_exclusions(spark):
    t = lambda d, h=0, month=1: dt.datetime(2024, month, d, h)
    rows = [(1, t(d), d in (2, 9)) for d in range(1, 11)] + [(1, t(1, 0, 2), True), (1, t(5, 0, 3), False), (1, None, False)]
    rows += [(None, t(20, h), None) for h in range(10)]
    df = spark.createDataFrame(rows, "e long, t timestamp_ntz, out boolean")
    got = {(r.e, r.t): r.part for r in telemetry.split_by_month(df, "e", "t", "out", least=10).collect()}
    want = {(1, t(d)): "EXCLUDED" if d in (2, 9) else "TRAIN" if d < 8 else "CALIBRATION" for d in range(1, 11)}
    want |= {(1, t(1, 0, 2)): "HOLDOUT", (1, t(5, 0, 3)): "HOLDOUT", (1, None): None}
    want |= {(None, t(20, h)): "TRAIN" if h < 7 else "CALIBRATION" for h in range(10)}
    assert got == want
    with pytest.raises(Exception, match="fewer than 11 rows"):
        telemetry.split_by_month(df, "e", "t", "out", least=11).collect()
