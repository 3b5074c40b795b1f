"""Manufacturing operators on hand-made rows: boundaries, nulls, ties and zero denominators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import checks, control, production, telemetry
from kilnworks.sources import silver
from kilnworks.streaming import alerts


def ts(text):
    return dt.datetime.fromisoformat(text)


PRODUCTION = "source_record_id string, site_id int, product_code string, planned_quantity long, actual_quantity long, good_quantity long, reject_quantity long, nominal_rate long, operating_time_min double, planned_production_time_min double"


@pytest.fixture(scope="module")
def shifts(spark):
    return spark.createDataFrame([("a", 1, "P", 100, 80, 72, 8, 60, 120.0, 240.0), ("b", 1, "Q", 0, 0, 0, 0, 60, 0.0, 0.0), ("c", 2, None, 50, 60, 60, 0, 30, 120.0, 120.0)], PRODUCTION)


def test_oee_is_null_without_denominators(shifts):
    got = {r.source_record_id: r for r in production.shift_production_kpi(shifts).collect()}
    assert (got["a"].availability, got["a"].performance, got["a"].quality) == pytest.approx((0.5, 80 / 120, 0.9))
    assert got["a"].oee == pytest.approx(0.5 * 80 / 120 * 0.9) and got["b"].oee is None and got["b"].reject_rate is None


def test_losses_bridge_capacity(spark, shifts):
    down = spark.createDataFrame([("a", True, "CHANGEOVER", 20.0), ("a", True, "CLEANING", 10.0), ("a", False, "MECHANICAL", 30.0), ("a", False, "PROCESS", 60.0)], "production_record_id string, planned_flag boolean, failure_category string, duration_min double")
    loss = production.shift_production_loss(production.shift_production_kpi(shifts), down)
    values = spark.createDataFrame([("P", 0.5)], "product_code string, eur_per_unit double")
    got = {r.source_record_id: r for r in production.shift_loss_accounting(loss, values).collect()}
    a = got["a"]
    assert len(got) == 3 and (a.planned_downtime_min, a.unplanned_downtime_min, a.changeover_downtime_min) == (30, 90, 20)
    assert a.theoretical_capacity_units == a.good_quantity + a.total_technical_loss_units and a.total_technical_eur == a.total_technical_loss_units * 0.5
    assert got["b"].technical_output_efficiency is None and got["c"].total_technical_eur is None and got["c"].performance_loss_units == 0


def test_ranks_place_nulls_like_the_source_database(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 2.0)], "k string, v double")
    got = {r.k: (r.down, r.up) for r in production.ranked(df, {"down": ("v", True, []), "up": ("v", False, [])}).collect()}
    assert got == {"b": (1, 3), "c": (2, 2), "d": (2, 2), "a": (3, 1)}


def test_pareto_ends_at_one(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (1, "y", 5.0), (1, "z", 10.0), (2, "x", 0.0)], "site int, reason string, m double")
    got = sorted((r.site, r.pareto_rank, r.reason, r.cumulative_share) for r in production.pareto(df, ["site"], "m", ["reason"]).collect())
    assert got == [(1, 1, "z", 0.5), (1, 2, "x", 0.75), (1, 3, "y", 1.0), (2, 1, "x", None)]


def test_laney_without_baseline_or_spread(spark):
    rows = [("flat", k, 100, 5, True) for k in range(5)] + [("flat", 9, 100, 6, False), ("new", 1, 10, 1, False), ("zero", 1, 10, 0, True), ("zero", 2, 10, 1, False)]
    df = spark.createDataFrame(rows, "k string, t int, u long, r long, base boolean")
    got = {(r.k, r.t): r.status for r in control.laney_pprime(df, ["k"], "u", "r", ["t"], F.col("base")).collect()}
    assert got["flat", 0] == "IN_CONTROL" and got["flat", 9] == "ABOVE_UCL" and got["new", 1] == got["zero", 2] == "NO_BASELINE"


def test_first_after_reaches_to_its_bound(spark):
    left = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), "a"), (1, ts("2024-01-01 00:00:00"), "twin"), (1, ts("2024-02-01 00:00:00"), "none"), (2, ts("2024-01-01 00:00:00"), "other")], "k int, t timestamp_ntz, tag string")
    right = spark.createDataFrame([(1, ts("2024-01-08 00:00:00"), "edge"), (1, ts("2023-12-31 23:59:59"), "before"), (1, ts("2024-02-08 00:00:01"), "late")], "k int, s timestamp_ntz, order_id string")
    got = {r.tag: r.order_id for r in control.first_after(left, right, ["k"], "t", "s", 168).collect()}
    assert got == {"a": "edge", "twin": "edge", "none": None, "other": None}


def test_first_after_pairs_no_rows_and_equals_brute_force(spark):
    start = ts("2024-01-01 00:00:00")
    at = lambda k: None if k % 17 == 0 else start + dt.timedelta(minutes=(k * 7919) % 9000)
    left = [(None if k % 13 == 0 else k % 2, at(k % 90), k % 80) for k in range(300)]
    right = [(None if k % 11 == 0 else k % 3, at(k + 40), f"o{k * 37 % 101}") for k in range(120)] + [(1, at(41), "a"), (1, at(41), None)]
    made = control.first_after(spark.createDataFrame(left, "k int, t timestamp_ntz, tag int"), spark.createDataFrame(right, "k int, s timestamp_ntz, o string"), ["k"], "t", "s", 2)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()

    def first(k, t):
        near = [r[1:] for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and t <= r[1] <= t + dt.timedelta(hours=2)]
        return min(near, key=lambda m: (m[0], m[1] is not None, m[1] or ""), default=(None, None))

    text = lambda rows: sorted(map(str, rows))
    assert made.columns == ["k", "t", "tag", "s", "o"]
    assert text(map(tuple, made.collect())) == text((*row, *first(*row[:2])) for row in left)


def series(spark, flags, entity=1):
    start = ts("2024-01-01 00:00:00")
    return spark.createDataFrame([(entity, start + dt.timedelta(hours=k), bool(f)) for k, f in enumerate(flags)], "e int, t timestamp_ntz, hot boolean")


def test_bins_keep_gaps_and_count_the_first_row_as_a_transition(spark):
    rows = [(1, ts("2024-01-01 00:10:00"), 1.0, 0), (1, ts("2024-01-01 00:20:00"), 4.0, 1), (1, ts("2024-01-01 02:00:00"), None, 1)]
    df = spark.createDataFrame(rows, "e int, t timestamp_ntz, v double, d int")
    got = telemetry.bin_features(df, "e", "t", "1 hour", ["v"], ["d"], 2).orderBy("bin").collect()
    assert [r.samples for r in got] == [2, 0, 1] and [r.valid for r in got] == [True, False, False]
    assert (got[0].v_mean, got[0].v_range, got[0].v_change, got[0].v_move, got[0].d_transitions) == (2.5, 3.0, 3.0, 3.0, 2)
    assert got[1].v_mean is None and got[2].v_last is None and got[2].d_transitions == 0


def test_persistence_needs_a_full_window(spark):
    df = series(spark, [1, 1, 0, 1, 1, 1, 0, 0, 0])
    df = df.withColumn("alert", telemetry.k_of_n(df, "e", "t", F.col("hot"), 2, 3))
    got = df.withColumn("start", telemetry.episode_starts("e", "t", "alert")).orderBy("t").collect()
    assert [int(r.alert) for r in got] == [0, 0, 1, 1, 1, 1, 1, 0, 0] and [int(r.start) for r in got] == [0, 0, 1, 0, 0, 0, 0, 0, 0]


def test_evaluations_differ_at_their_ends(spark):
    window = spark.createDataFrame([("1", ts("2024-01-01 04:00:00"), ts("2024-01-01 05:00:00")), ("2", ts("2025-01-01 00:00:00"), ts("2025-01-01 01:00:00"))], "failure_id string, failure_start timestamp_ntz, failure_end timestamp_ntz")
    df = series(spark, [0, 0, 0, 0, 1, 0]).withColumn("start", F.col("hot"))
    a = {r.failure_id: (r.detected, r.lead_hours, r.early) for r in telemetry.evaluate_any_alert(df, "t", "hot", window).collect()}
    assert a == {"1": (True, 0.0, False), "2": (False, None, False)}
    b = telemetry.evaluate_starts(df, "t", "start", window).collect()[0]
    assert (b.episodes, b.true_episodes, b.warned, b.failures, b.recall) == (1, 0, 0, 2, 0.0)


def test_rules_tell_groups_from_extra_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "k int")
    res = checks.results([checks.run_row_rules(df, [checks.RowRule("NULLS", F.col("k").isNull())]), checks.duplicate_groups(df, "GROUPS", ["k"]), checks.extra_rows(df, "EXTRA", ["k"])], warn={"EXTRA"})
    assert {r.rule_code: (r.evaluated, r.failed, r.status) for r in res.collect()} == {"NULLS": (5, 1, "FAIL"), "GROUPS": (5, 1, "FAIL"), "EXTRA": (5, 2, "WARN")}


def test_shift_boundaries(spark):
    times = ["2024-01-02 05:59:00", "2024-01-02 06:00:00", "2024-01-02 13:59:00", "2024-01-02 14:00:00", "2024-01-02 22:00:00"]
    df = spark.createDataFrame([(ts(x),) for x in times], "t timestamp_ntz")
    code, day = silver.shift_of("t")
    got = [(r.c[-1], r.d.day) for r in df.orderBy("t").select(code.alias("c"), day.alias("d")).collect()]
    assert got == [("C", 1), ("A", 2), ("A", 2), ("B", 2), ("C", 2)]


def test_silver_helpers(spark):
    assert silver.snake(" Oil (temp)  °C") == "oil_temp_c"
    cube = spark.createDataFrame([({"0": 1.0, "5": 2.0},)], "values map<string,double>")
    got = {(r.a, r.b): r.value for r in silver.decode_jsonstat(cube, [2, 3], [["x", "y"], ["p", "q", "r"]], ["a", "b"]).collect()}
    assert got == {("x", "p"): 1.0, ("y", "r"): 2.0}
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, silver.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, silver.upsert(base, new, ["k"], update=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert silver.fingerprint(base).collect() == silver.fingerprint(base.orderBy(F.desc("k"))).collect() != silver.fingerprint(new).collect()
    days = silver.calendar(spark, "2024-12-29", "2025-01-02").orderBy("date_id").collect()
    assert [(r.date_id, r.iso_week, r.iso_day, r.is_weekend) for r in days[:2]] == [(20241229, 52, 7, True), (20241230, 1, 1, False)] and len(days) == 5
    p = silver.profile(spark.createDataFrame([(ts("2024-01-01 00:00:00"), 1), (ts("2024-01-01 00:00:10"), None), (ts("2024-01-02 00:00:00"), 1), (ts("2024-01-02 00:00:00"), 1)], "t timestamp_ntz, v int"), "t").collect()[0]
    assert (p.rows, p.missing_cells, p.repeated_rows, p.least_step_s, p.most_step_s) == (4, 1, 1, 10.0, 86390.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = series(spark, [1, 1, 0, 1, 1, 1, 0, 0, 0]).unionByName(series(spark, [0, 1, 1, 1], entity=2))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    made = alerts.k_of_n_alerts(stream, "e", "t", "hot", 2, 3)
    made.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    batch = rows.withColumn("alert", telemetry.k_of_n(rows, "e", "t", F.col("hot"), 2, 3))
    batch = batch.withColumn("start", telemetry.episode_starts("e", "t", "alert")).select("e", "t", "alert", "start")
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_matches_null_keys_and_refuses_repeats(spark):
    base = spark.createDataFrame([(1, None, "a"), (None, None, "b")], "k long, key0 string, v string")
    new = spark.createDataFrame([(None, None, "c"), (2, "x", "d")], "k long, key0 string, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(silver.upsert(base, new, ["k", "key0"])) == [(1, None, "a"), (2, "x", "d"), (None, None, "c")]
    assert rows(silver.upsert(base, new, ["k", "key0"], update=False)) == [(1, None, "a"), (2, "x", "d"), (None, None, "b")]
    with pytest.raises(Exception, match="repeat a key"):
        silver.upsert(base, new.union(new), ["k", "key0"]).collect()
    assert rows(silver.upsert(base.limit(0), new.limit(0), ["k"])) == []


def test_fingerprint_tells_where_a_null_stands(spark):
    kind = "a long, b long, c array<long>"
    prints = {tuple(silver.fingerprint(spark.createDataFrame([r], kind)).collect()[0]) for r in [(None, 1, None), (1, None, None), (None, 1, [None]), (None, 1, []), (None, None, None)]}
    assert len(prints) == 5


def test_windows_that_cross_midnight_overlap_or_end_before_they_begin(spark):
    times = [ts("2024-01-01 00:00") + dt.timedelta(minutes=37 * k) for k in range(400)]
    df = spark.createDataFrame([(t, k % 5 == 0) for k, t in enumerate(times)] + [(None, True)], "t timestamp_ntz, hot boolean")
    spans = [(1, "2024-01-03 22:10", "2024-01-05 01:00"), (2, "2024-01-04 00:00", "2024-01-04 00:37"), (3, "2024-01-08 10:00", "2024-01-08 09:00"), (4, "2024-02-08 10:00", "2024-02-08 11:00"), (5, None, None)]
    windows = spark.createDataFrame([(i, a and ts(a), b and ts(b)) for i, a, b in spans], "failure_id long, failure_start timestamp_ntz, failure_end timestamp_ntz")
    known = [(i, ts(a), ts(b)) for i, a, b in spans if a]
    hours = lambda n: dt.timedelta(hours=n)
    for r in telemetry.label_windows(df.filter("t is not null"), "t", windows).collect():
        assert r.in_failure == any(a <= r.t <= b for _, a, b in known)
        assert r.in_warning == any(a - hours(24) <= r.t <= b for _, a, b in known)
        assert r.excluded == any(a - hours(24) <= r.t <= b + hours(24) for _, a, b in known)
    hot = [t for k, t in enumerate(times) if k % 5 == 0]
    first = {i: min((t for t in hot if a - hours(24) <= t <= b), default=None) for i, a, b in known}
    for r in telemetry.evaluate_any_alert(df, "t", "hot", windows).collect():
        assert r.detected == (first.get(r.failure_id) is not None)
    one = telemetry.evaluate_starts(df, "t", "hot", windows).collect()[0]
    warned = {i for i, a, _ in known if any(a - hours(24) <= t < a for t in hot)}
    true = sum(any(a - hours(24) <= t < a for _, a, _ in known) for t in hot)
    assert (one.episodes, one.true_episodes, one.warned, one.failures) == (len(hot) + 1, true, len(warned), 5)
    empty = telemetry.evaluate_starts(df.limit(0), "t", "hot", windows).collect()[0]
    assert (empty.episodes, empty.true_episodes, empty.warned) == (0, 0, 0)
