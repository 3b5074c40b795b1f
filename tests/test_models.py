"""Trained models, policies, landing helpers and the streaming upsert against plain Python or planted cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnworks.operators import models, policy
from kilnworks.sources import landing
from kilnworks.streaming.alerts import upsert_daily

T0 = dt.datetime(2024, 1, 1)


def hour(k):
    return T0 + dt.timedelta(hours=k)


@pytest.fixture(scope="module", autouse=True)
def times(spark):
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_windows_turns_reversed_ones_and_drops_open_ones(spark):
    rows = [(1, hour(0), None, hour(2)), (2, None, hour(5), hour(3)), (3, hour(1), None, None)]
    df = spark.createDataFrame(rows, "id int, a timestamp_ntz, b timestamp_ntz, z timestamp_ntz")
    got = {r.id: (r.failure_start, r.failure_end) for r in policy.parse_windows(df, ["absent", "a", "b"], ["z"]).collect()}
    assert got == {1: (hour(0), hour(2)), 2: (hour(3), hour(5))}
    with pytest.raises(ValueError):
        policy.parse_windows(df, ["absent"], ["z"])


def test_grid_alerts_match_plain_python(spark):
    rng = np.random.default_rng(1)
    scores = [None if rng.random() < 0.1 else float(rng.integers(0, 20)) for _ in range(60)]
    df = spark.createDataFrame([("e", hour(k), s) for k, s in enumerate(scores)], "e string, t timestamp_ntz, s double")
    grid = dict(quantiles=(0.5, 0.8), persistence=((1, 2), (2, 3)), lag=2, lookback=10, least=4)
    got = {(r.quantile, r.required, r.window, r.t): (r.alert, r.start) for r in policy.grid_alerts(df, "e", "t", "s", **grid).collect()}
    assert len(got) == 240
    for q in grid["quantiles"]:
        hot = []
        for k, s in enumerate(scores):
            seen = [x for x in scores[max(0, k - 11) : max(0, k - 1)] if x is not None]
            hot.append(s is not None and len(seen) >= 4 and s >= np.quantile(seen, q) - 1e-9)
        for need, n in grid["persistence"]:
            alert = [k >= n - 1 and sum(hot[k - n + 1 : k + 1]) >= need for k in range(60)]
            for k in range(60):
                assert got[q, need, n, hour(k)] == (alert[k], alert[k] and not (k and alert[k - 1]))


def test_choice_prefers_the_budget_and_falls_back_to_least_burden(spark):
    columns = "quantile double, required int, window int, false_per_day double, alert_pct double, early long, detected long"
    pick = lambda rows: policy.choose(spark.createDataFrame(rows, columns)).filter("is_selected").first().quantile
    assert pick([(0.1, 2, 3, 0.4, 1.0, 1, 2), (0.2, 2, 3, 0.1, 1.0, 0, 2), (0.3, 2, 3, 9.0, 1.0, 2, 2)]) == 0.1
    assert pick([(0.1, 2, 3, 0.9, 1.0, 2, 2), (0.2, 2, 3, 0.8, 1.0, 0, 0)]) == 0.2


def test_scenario_ramps_towards_the_failure(spark):
    df = spark.createDataFrame([(hour(k), 0.0, 10.0) for k in range(12)], "t timestamp_ntz, z double, oil double")
    failures = spark.createDataFrame([("f", hour(8), hour(9))], "failure_id string, failure_start timestamp_ntz, failure_end timestamp_ntz")
    got = {r.t: r for r in policy.condition_scenario(df, "t", "z", failures, {"oil_temperature": "oil"}).collect()}
    for k in range(12):
        ramp = 1 - (8 - k) / 6 if 2 <= k < 8 else 0.0
        state = "FAULT" if k in (8, 9) else "DEGRADING" if ramp > 0 else "NORMAL"
        r = got[hour(k)]
        assert (r.degradation, r.scenario_oil_temperature, r.condition_score, r.condition_state) == (pytest.approx(ramp), pytest.approx(10 + 6 * ramp), pytest.approx(95 - 60 * ramp), state)
        assert r.event_timestamp == hour(k).replace(year=2028)


def test_time_cut_keeps_times_together(spark):
    df = spark.createDataFrame([("a", t) for t in [1, 2, 2, 2, 3, 4, 4, 5, 6, 7]] + [("b", 9)], "k string, t int")
    assert {r.k: r.cut for r in models.time_cut(df, ["k"], "t", 0.8).collect()} == {"a": 5, "b": 9}


def test_balanced_logistic_is_at_its_least_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * 2 + rng.normal(size=300) > 1.2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1] * 50 + 7, "y": y}))
    got = models.warning_probability(df, df, "y", ["a", "b"]).toPandas()
    z = np.log(got.probability / (1 - got.probability)).to_numpy()
    std = lambda v: ((v - v.mean()) / v.std(ddof=1)).to_numpy()
    design = np.column_stack([std(got.a), std(got.b), np.ones(len(got))])
    w = np.linalg.lstsq(design, z, rcond=None)[0]
    weight = np.where(got.y == 1, len(got) / (2 * got.y.sum()), len(got) / (2 * (1 - got.y).sum()))
    slope = design.T @ (weight * (got.probability - got.y)) + np.array([w[0], w[1], 0.0])
    assert np.abs(slope).max() < 0.05
    with pytest.raises(ValueError):
        models.warning_probability(df.filter("y = 0"), df, "y", ["a", "b"])


def test_isolation_forest_ranks_planted_rows_first(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(600, 2)), [[9, 9], [-8, 7], [10, -9]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(603), "a": x[:, 0], "b": x[:, 1]}))
    df = df.unionByName(spark.createDataFrame([(700, None, 0.0)], "id long, a double, b double"))
    got = {r.id: r.isolation_score for r in models.isolation_scores(df, df, ["a", "b"], F.col("id"), trees=60, sample=128).collect()}
    assert got.pop(700) is None and all(0 < s < 1 for s in got.values())
    assert set(sorted(got, key=got.get)[-3:]) == {600, 601, 602}
    again = {r.id: r.isolation_score for r in models.isolation_scores(df.repartition(5), df, ["a", "b"], F.col("id"), trees=60, sample=128).collect()}
    assert all(math.isclose(again[k], v) for k, v in got.items())


def test_usual_path_matches_the_harmonic_form():
    for n in (16, 64, 256):
        harmonic = sum(1 / k for k in range(1, n))
        assert models.usual_path(n) == pytest.approx(2 * harmonic - 2 * (n - 1) / n, rel=0.05)
    assert list(models.usual_path(np.array([0, 1, 2]))) == [0, 0, 1]


def test_contextual_anomaly_finds_planted_shifts(spark):
    rng = np.random.default_rng(5)
    make = lambda n, start: [(f"{start + k}", "ab"[k % 2], hour(start + k), float(u := rng.integers(100, 200)), float(u * (2 if k % 2 else 3) + rng.normal())) for k in range(n)]
    kind = "id string, line string, t timestamp_ntz, units double, kwh double"
    base, test = make(1500, 0), make(100, 2000)
    test += [("hot", "a", hour(3000), 150.0, 700.0), ("cold", "b", hour(3001), 150.0, 100.0), ("new", "c", hour(3002), 150.0, 9000.0)]
    got = {r.id: r.status for r in models.contextual_anomaly(spark.createDataFrame(base, kind), spark.createDataFrame(test, kind), "kwh", ["units"], "line", "t").collect()}
    assert (got["hot"], got["cold"], got["new"]) == ("HIGH_ENERGY", "LOW_ENERGY", "HIGH_ENERGY")
    assert sum(v == "NORMAL" for v in got.values()) > 90


def test_forecast_holdout_takes_the_better_model(spark):
    # The noise tells the trees nothing, so the week before is exact where they are not.
    rows = [(e, (T0 + dt.timedelta(days=d)).date(), float(100 * e + 10 * (d % 7)), float(d * 37 % 11), 100.0 * e + 10 * (d % 7)) for e in (1, 2) for d in range(120)]
    feat = spark.createDataFrame(rows, "e int, day date, y double, noise double, lag_7 double")
    got = models.forecast_holdout(feat, "e", "day", "y", ["noise"], days=30).collect()
    assert len(got) == 60 and {r.selected_model for r in got} == {"seasonal_naive"} and all(r.abs_error == 0 for r in got)
    assert min(r.day for r in got) == (T0 + dt.timedelta(days=90)).date()
    late = feat.withColumn("lag_7", F.lit(0.0))
    assert {r.selected_model for r in models.forecast_holdout(late, "e", "day", "y", ["noise"], days=30).collect()} == {"boosted_trees"}


def test_class_report_matches_plain_counts(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")] + [("c", "a")] * 2
    got = {r["class"]: r for r in models.class_report(spark.createDataFrame(pairs, "y string, p string"), "y", "p").collect()}
    for c in "abc":
        hits, support, claimed = sum(x == y == c for x, y in pairs), sum(y == c for y, _ in pairs), sum(p == c for _, p in pairs)
        assert (got[c].support, got[c].precision, got[c].recall, got[c].f1) == (support, pytest.approx(hits / claimed), pytest.approx(hits / support), pytest.approx(2 * hits / (support + claimed)))
    assert got["a"].accuracy == pytest.approx(8 / 13)


def test_forest_learns_what_a_feature_decides(spark):
    df = spark.createDataFrame([("xyz"[k % 3], float(k % 3), float(k)) for k in range(300)], "y string, a double, b double")
    made = models.forest_classes(df.filter("b < 240"), df.filter("b >= 240"), "y", ["a", "b"], trees=10)
    assert {r.y == r.predicted for r in made.collect()} == {True}


def test_rows_zip_by_position(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"a{k}" for k in range(5000)))
    (tmp_path / "b.txt").write_text("\n".join(f"b{k}" for k in range(5000)))
    (tmp_path / "c.txt").write_text("b0\nb1")
    read = lambda s, p: s.read.text(p).withColumnRenamed("value", p.rsplit("/", 1)[-1][0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = landing.read_zipped(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", read).collect()
        assert len(got) == 5000 and all(r.a[1:] == r.b[1:] for r in got)
        with pytest.raises(Exception, match="unlike length"):
            landing.read_zipped(spark, f"{tmp_path}/a.txt", f"{tmp_path}/c.txt", read).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_prices_must_cover_every_period(spark):
    df = spark.createDataFrame([(g, f"{y}-S{h}", 0.1) for g in "AB" for y in (2021, 2022) for h in (1, 2)], "geo_code string, period_code string, price double")
    assert landing.select_prices(df, ["A", "B"], [2021, 2022], source="S").count() == 8
    with pytest.raises(Exception, match="do not cover"):
        landing.select_prices(df.filter("period_code <> '2021-S1'"), ["A", "B"], [2021, 2022]).collect()


def test_violations_and_expectations_count_planted_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, -1.0)], "k int, v double")
    assert {r.rule: r.bad for r in landing.violations(df, {"positive": F.col("v") > 0}, ["k"]).collect()} == {"positive": 2, "repeated": 1}
    got = {r.check: (r.found, r.ok) for r in landing.expect(df, ["k", "z"], {"k": [1]}, least=4).collect()}
    assert got == {"rows": (3, False), "k outside its domain": (1, False), "missing columns": (1, False)}


def test_replaced_dataset_is_whole(spark, tmp_path):
    path = f"{tmp_path}/d"
    landing.replace_dataset(spark.range(5), path)
    landing.replace_dataset(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and [x.name for x in tmp_path.iterdir()] == ["d"]


def test_streaming_upsert_adds_batches_once(spark, tmp_path):
    src, out, kind = f"{tmp_path}/in", f"{tmp_path}/out", "day date, site int, units long"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    batches = [[(days[0], 1, 5), (days[0], 1, 6), (days[1], 2, 7)], [(days[1], 2, 1), (days[1], 3, 9)], [(days[2], 1, 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        upsert_daily(spark.readStream.schema(kind).parquet(src), out, ["site"], ["units"], f"{tmp_path}/check").awaitTermination()
    want = {}
    for day, site, units in sum(batches, []):
        want[day, site] = want.get((day, site), 0) + units
    assert {(r.day, r.site): r.units for r in spark.read.parquet(out).collect()} == want
    # The second batch once more, as after a lost driver: nothing is added twice.
    again = f"{tmp_path}/again"
    spark.createDataFrame(batches[2], kind).coalesce(1).write.parquet(again)
    upsert_daily(spark.readStream.schema(kind).parquet(again), out, ["site"], ["units"], f"{tmp_path}/check2").awaitTermination()
    assert {(r.day, r.site): r.units for r in spark.read.parquet(out).collect()} == want
