"""From raw files to typed tables: the given tables are written as raw text first, with the faults that such files have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.operators import policy
from kilnworks.plans.manufacturing import query
from kilnworks.sources import silver
from kilnworks.sources.fixtures import Plant
from kilnworks.sources.shared import work_folder

def raw_orders(p: Plant) -> str:
    """Orders as CSV: headers with spaces and units, dates and times apart, tokens for unknown values, blank rows and an empty column."""
    o = p.spark.read.parquet(f"{p.sf_dir}/orders.parquet")
    late = F.col("o_orderkey") % 10 == 3
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("Order Key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.when(late, "not known").otherwise(F.format_string("%02d:30:00", F.col("o_orderkey") % 24)).alias("Order Time"),
        F.when(late, "..").otherwise(F.col("o_totalprice").cast("string")).alias("Total Price (EUR)"),
        F.when(F.col("o_orderstatus") == "F", "-1").otherwise("1").alias("Pass/Fail"),
        F.lit(None).cast("string").alias("Unused"),
    )
    blank = rows.filter("`Order Key` % 500 = 1").select(*[F.lit(None).cast("string").alias(c) for c in rows.columns])
    path = work_folder(p.spark, "raw-orders")
    rows.unionByName(blank).write.option("header", True).csv(path)
    return path


def silver_orders(p: Plant) -> DataFrame:
    raw = silver.with_lineage(silver.read_csv(p.spark, raw_orders(p), nulls=("..", "not known")), file_name="source_file", source_dataset="ORDERS", data_origin="EXTERNAL")
    df = silver.rename_existing(silver.normalize_columns(raw), {"total_price_eur": "total_eur", "not_there": "x"})
    df = df.filter("order_key is not null").withColumns({c: F.col(c).cast("string") for c in ("order_date", "order_time", "pass_fail")})
    df = silver.drop_blank(df.withColumn("order_time", F.regexp_extract("order_time", r"(\d\d:\d\d:\d\d)$", 1)).withColumn("order_time", F.nullif("order_time", F.lit(""))))
    df = df.withColumn("ordered_at", silver.combine_date_time("order_date", "order_time").cast("timestamp_ntz"))
    df = silver.parse_ts(df.withColumn("ordered_on", F.col("order_date")), "ordered_on", "yyyy-MM-dd")
    df = df.withColumns({"result": silver.recode("pass_fail", {"-1": "PASS", "1": "FAIL"}), "from_file": F.col("source_file").endswith(".csv"), "ordered_on": F.to_date("ordered_on").cast("string")})
    return silver.read_parquet(p.spark, _written(p, df), ["order_key", "ordered_at", "ordered_on", "total_eur", "result", "source_dataset", "data_origin", "from_file", "columns"])


def _written(p: Plant, df: DataFrame) -> str:
    """A dataset that replace_by_source has written twice: the second time puts the same source in place."""
    path = work_folder(p.spark, "silver-orders")
    made = df.withColumns({"columns": F.lit(",".join(sorted(c for c in df.columns if c in ("unused", "order_key")))), "source_dataset_id": F.lit(1)})
    silver.replace_by_source(made.withColumn("total_eur", F.lit(0.0)), path)
    silver.replace_by_source(made.withColumn("source_dataset_id", F.lit(2)).limit(5), path)
    silver.replace_by_source(made, path)
    out = work_folder(p.spark, "silver-source")
    p.spark.read.parquet(path).filter("source_dataset_id = 1").write.parquet(out)
    return out


query(
    "src_raw_orders",
    "order_key ordered_at ordered_on total_eur~ result source_dataset data_origin from_file columns",
    """select cast(o_orderkey as int) order_key, case when o_orderkey % 10 <> 3 then cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(o_orderkey % 24 as int)) + interval 30 minute end ordered_at, cast(cast(o_orderdate as date) as varchar) ordered_on,
  case when o_orderkey % 10 <> 3 then cast(o_totalprice as double) end total_eur, case when o_orderstatus = 'F' then 'PASS' else 'FAIL' end result, 'ORDERS' source_dataset, 'EXTERNAL' data_origin, true from_file, 'order_key' as columns from orders""",
)(lambda p: silver_orders(p).withColumns({"order_key": F.col("order_key").cast("int"), "total_eur": F.col("total_eur").cast("double")}))


def matrix(p: Plant) -> DataFrame:
    """Embeddings as white-space separated text (the key first), read back and melted by sensor."""
    path = work_folder(p.spark, "raw-matrix")
    v = p.spark.read.parquet(f"{p.sf_dir}/embeddings.parquet")
    numbers = F.concat(F.array(F.col("vec_id").cast("string")), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double").cast("string")))
    v.select(F.concat(F.lit("  "), F.array_join(numbers, " \t"))).write.text(path)
    rows = silver.read_matrix(p.spark, path).withColumn("cycle", F.format_string("CYCLE-%06d", F.get("values", F.lit(0)).cast("long")))
    rows = rows.withColumns({"values": F.slice("values", 2, 8), "sensor": F.when(F.col("cycle").endswith("0"), "PS1").when(F.col("cycle").endswith("1"), "TS1").otherwise("FS9")})
    sensors = p.spark.createDataFrame([("PS1", 100.0, "bar"), ("TS1", 1.0, "C")], "sensor string, hz double, unit string")
    return silver.melt_sensors(rows, "cycle", "sensor", "values", sensors)


query(
    "src15_matrix_samples",
    "cycle sensor sample_index value~ seconds_from_start~ unit",
    """select cycle, sensor, cast(k - 1 as int) sample_index, cast(embedding[k] as double) as value, case sensor when 'PS1' then (k - 1) / 100 when 'TS1' then cast(k - 1 as double) end seconds_from_start, case sensor when 'PS1' then 'bar' when 'TS1' then 'C' end unit
  from (select *, case right(cycle, 1) when '0' then 'PS1' when '1' then 'TS1' else 'FS9' end sensor from (select printf('CYCLE-%06d', vec_id) as cycle, embedding from embeddings) a) b, (select unnest(range(1, 9)) k) i""",
)(matrix)


def weather(p: Plant) -> DataFrame:
    raw = p.telemetry.filter("event_timestamp is not null").select(
        F.concat(F.lit("SITE-"), F.col("equipment_id")).alias("site_code"), F.col("event_timestamp").alias("timestamp_utc"), (F.col("tp2") + 250).alias("2m_temperature"), (F.col("tp2") * 10).alias("sp"), F.col("tp2").alias("u10"),
        F.col("tp3").alias("10m_v_component_of_wind"), (F.col("tp2") / 1000).alias("tp"),
    )
    return silver.standardize_weather(raw, p.dim_site)


query(
    "src16_weather",
    "site_code timestamp_utc air_temperature_c~ dewpoint_temperature_c~ surface_pressure_hpa~ solar_radiation_wh_m2~ precipitation_mm~ wind_speed_m_s~ site_id site_name",
    """select site_code, event_timestamp timestamp_utc, tp2 + 250 - 273.15 air_temperature_c, cast(null as double) dewpoint_temperature_c, tp2 / 10 surface_pressure_hpa, cast(null as double) solar_radiation_wh_m2, tp2 precipitation_mm, sqrt(tp2 ** 2 + tp3 ** 2) wind_speed_m_s,
  site_id, site_name from (select *, concat('SITE-', equipment_id) site_code from telemetry where event_timestamp is not null) t left join dim_site using (site_code)""",
)(weather)


def mixed(p: Plant) -> DataFrame:
    """Downtime as text under names that say nothing, some values of each column being rubbish."""
    d = p.fact_downtime
    k = F.pmod(F.xxhash64("source_record_id"), F.lit(100))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return d.select(
        F.col("source_record_id").alias("c0"), F.when(k < 3, "n/a").otherwise(F.col("duration_min").cast("string")).alias("c1"), F.when(k < 50, "?").otherwise(F.col("duration_min").cast("string")).alias("c2"),
        F.when(F.col("planned_flag"), text("event_end")).otherwise(text("event_start")).alias("From"), text("event_start").alias("c4"),
    )


query(
    "src8_promoted_columns",
    "column kind",
    "select * from (values ('c0', 'string'), ('c1', 'double'), ('c2', 'string'), ('From', 'timestamp_ntz'), ('c4', 'timestamp_ntz')) v(\"column\", kind)",
)(lambda p: p.spark.createDataFrame(silver.promote(mixed(p), {"number": "double", "time": "timestamp_ntz"}).dtypes, "column string, kind string"))
query(
    "ts8_inferred_windows",
    "c0 failure_start failure_end",
    "select source_record_id c0, event_start failure_start, case when planned_flag then event_end else event_start end failure_end from fact_downtime",
)(lambda p: policy.infer_windows(mixed(p), ["start_time", "from"], ["end_time"]))
