"""Readers and normalisers on small files and tables with planted faults."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import conform, policy, telemetry
from kilnworks.sources import landing, silver


def test_csv_with_tokens_ragged_rows_and_blank_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Key,Oil (temp) °C,Gone\n1,2.5,\n2,..,\n3,...,\n,,\n4,7,extra,cells\n")
    df = silver.normalize_columns(silver.read_csv(spark, str(tmp_path / "a.csv")))
    assert df.columns == ["order_key", "oil_temp_c", "gone"]
    kept = silver.drop_blank(df.filter("order_key < 4 or order_key is null"))
    assert kept.columns == ["order_key", "oil_temp_c"]
    assert sorted(map(tuple, kept.collect())) == [(1, "2.5"), (2, None), (3, None)]
    strict = silver.read_csv(spark, str(tmp_path / "a.csv"), schema="k int, v string, g string", drop_bad=True)
    assert [r.k for r in strict.filter("k is not null").collect()] == [1, 2, 3]
    named = silver.with_lineage(silver.read_csv(spark, str(tmp_path / "a.csv")), file_name="file", origin="X")
    assert {(r.file, r.origin) for r in named.collect()} == {("a.csv", "X")}
    assert silver.rename_existing(df, {"gone": "left", "absent": "x"}).columns == ["order_key", "oil_temp_c", "left"]


def test_matrix_text_and_samples_by_sensor(spark, tmp_path):
    (tmp_path / "m.txt").write_text(" 1.5\t2  x \n3\n\n")
    rows = silver.read_matrix(spark, str(tmp_path / "m.txt"))
    assert [r["values"] for r in rows.collect()] == [[1.5, 2.0, None], [3.0], [None]]
    numbered = {r.id: r["values"] for r in landing.format_id(rows, "id", "UNIT-%03d").collect()}
    assert numbered == {"UNIT-001": [1.5, 2.0, None], "UNIT-002": [3.0], "UNIT-003": [None]}
    sensors = spark.createDataFrame([("A", 10.0, "bar"), ("Z", 0.0, "C")], "sensor string, hz double, unit string")
    df = spark.createDataFrame([(1, "A", [5.0, 6.0]), (1, "B", [7.0]), (2, "Z", [8.0]), (3, "A", None)], "cycle int, sensor string, v array<double>")
    got = sorted(map(tuple, silver.melt_sensors(df, "cycle", "sensor", "v", sensors).collect()), key=str)
    assert got == [(1, "A", 0, 5.0, 0.0, "bar"), (1, "A", 1, 6.0, 0.1, "bar"), (1, "B", 0, 7.0, None, None), (2, "Z", 0, 8.0, None, "C")]
    assert silver.melt(df, "cycle", "v", 2.0).count() == 4


def test_columns_are_found_by_name_or_by_content(spark):
    rows = [(str(k), f"2024-01-{k + 1:02d} 00:00:00" if k < 17 else "x", str(k) if k < 19 else "n/a", " " if k else "7", None) for k in range(20)]
    df = spark.createDataFrame(rows, "`Event Time` string, b string, c string, d string, e string")
    assert silver.find_column(df, ["event_time"], "timestamp_ntz") == "Event Time"
    assert silver.find_column(df, ["nope"], "timestamp_ntz") == "b"
    assert silver.find_column(df, ["nope"], "timestamp_ntz", share=0.9) is None
    assert silver.find_column(df, [], "double", taken=("Event Time",)) == "d"  # its only known value is a number
    shares = silver.parse_shares(df, df.columns, {"n": "double", "t": "timestamp_ntz"})
    assert shares["n"]["c"] == pytest.approx(0.95) and shares["t"]["b"] == pytest.approx(0.85) and shares["n"]["e"] is None
    made = silver.promote(df, {"n": "double", "t": "timestamp_ntz"}, share=0.9)
    assert dict(made.dtypes) == {"Event Time": "double", "b": "string", "c": "double", "d": "double", "e": "string"}
    assert made.filter("c is null").count() == 1
    windows = policy.infer_windows(df.withColumn("until", F.col("b")), ["begin"], ["end"])
    assert windows.count() == 17
    with pytest.raises(ValueError, match="no column"):
        policy.infer_windows(df.select("c"), ["begin"], ["end"])


def test_times_codes_and_json(spark):
    df = spark.createDataFrame([("2024-02-30", "10:00:00", -1), ("2024-02-28", "10:00:00", 1), (None, "1", 5)], "d string, t string, code int")
    got = df.select(silver.combine_date_time("d", "t").alias("at"), silver.recode("code", {-1: "PASS", 1: "FAIL"}).alias("result")).collect()
    assert [(r["at"], r.result) for r in got] == [(None, "PASS"), (dt.datetime(2024, 2, 28, 10), "FAIL"), (None, None)]
    assert [r.d for r in silver.parse_ts(df, "d", "yyyy-MM-dd").collect()] == [None, dt.datetime(2024, 2, 28), None]
    with pytest.raises(Exception, match="CANNOT_PARSE|DateTime|2024-02-30"):
        silver.parse_ts(df, "d", "yyyy-MM-dd", strict=True).collect()
    assert json.loads(silver.to_json_rows(df).first()[0]) == {"d": "2024-02-30", "t": "10:00:00", "code": -1}
    blank = conform.blank_to_null(spark.createDataFrame([(" ", "x", 1)], "a string, b string, n int"))
    assert tuple(blank.first()) == (None, "x", 1)


def test_weather_under_either_name(spark):
    sites = spark.createDataFrame([("S1", 4)], "site_code string, altitude int")
    one = spark.createDataFrame([("S1", "t", 300.15, 101300.0, 3.0, 4.0, 0.002), ("S2", "t", None, None, None, 1.0, None)], "site_code string, timestamp_utc string, `2m_temperature` double, sp double, u10 double, v10 double, total_precipitation double")
    got = {r.site_code: r for r in silver.standardize_weather(one, sites).collect()}
    assert got["S1"].air_temperature_c == pytest.approx(27) and got["S1"].surface_pressure_hpa == 1013 and got["S1"].wind_speed_m_s == 5 and got["S1"].precipitation_mm == 2 and got["S1"].altitude == 4
    assert got["S1"].dewpoint_temperature_c is None and got["S2"].wind_speed_m_s is None and got["S2"].altitude is None
    assert "altitude" not in silver.standardize_weather(one).columns


def test_sources_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(r, "v string, source_dataset_id int")
    silver.replace_by_source(rows(("a", 1), ("b", 2)), path)
    silver.replace_by_source(rows(("c", 1)), path)
    assert sorted((r.v, r.source_dataset_id) for r in silver.read_parquet(spark, path, ["v", "source_dataset_id"]).collect()) == [("b", 2), ("c", 1)]


def test_classes_are_split_each_at_its_own_end(spark):
    df = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 1), ("c", 1), ("c", 2)], "label string, k int")
    held = {(r.label, r.k) for r in telemetry.classwise_split(df, "label", "k").filter("held_out").collect()}
    assert held == {("a", 8), ("a", 9), ("c", 2)}


def test_texts_that_are_no_floats_are_told_before_the_cast(spark):
    good = "0 -1 +2.5 .5 5. 1e5 1E-5 1.5e+3 1d 1f 2.D 3.F 0x1p3 0X.8P-1d 0x1.8p1F NaN nan NAN +NaN -NaN Infinity -Infinity inf -INF +inf Infinity2 infinity 1e400 00012".split() + ["\t7\n", "\x01 8 \x0c", "\r\n-9e1\x1f"]
    bad = ["1-1-155190-7706-1996-03-13-P", "2024-01-01 00:00:00", "n/a", "?", "abc", "1,5", "1 2", "e5", "--1", "1e", "1e5x", "٣", "1_0", "0x1", "Inff", "12:30", "é", "9" * 30 + "x", " 7", "7\n8", "d", "i", "in", "+-1"]
    odd = ["", " ", ".", "+", "-.", "d", "1.e", "0x", "0xp1", "İnf", "K", "1٠", "1dd", "0x1p", "nan1", "infinit"]
    df = spark.createDataFrame([(x,) for x in good + bad + odd], "v string")
    for kind in ("double", "float", " DOUBLE"):
        rows = df.select("v", F.col("v").try_cast(kind.strip()).alias("a"), silver.cast_text(F.col("v"), kind).alias("b")).collect()
        assert [str(r.a) for r in rows] == [str(r.b) for r in rows]
        assert sum(r.a is not None for r in rows) >= len(good) - 3
    looks = {r.v: r.looks for r in df.select("v", F.col("v").rlike(silver.FLOAT_LIKE).alias("looks")).collect()}
    assert not any(looks[x] for x in ("1-1-155190-7706-1996-03-13-P", "2024-01-01 00:00:00", "n/a", "?", "abc", "12:30", "9" * 30 + "x"))
    plan = df.agg(F.count(silver.cast_text(F.col("v"), "double")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in df.select(silver.cast_text(F.col("v"), "timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
