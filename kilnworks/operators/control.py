"""Control charts, reliability and failure burden."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions.measures import ratio

HOUR = 3600.0


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp_ltz")) / 1e6


def laney_pprime(rows: DataFrame, keys: list[str], units: str, rejects: str, order: list[str], baseline: Column, limits: float = 3.0, d2: float = 1.128) -> DataFrame:
    """Laney p' chart: limits from a baseline, widened by the spread of its standardised moving ranges.

    Series with no baseline, or with a centre at 0 or 1, have status NO_BASELINE. The baseline is summed by key and
    joined, so a key with very many rows is never collected; only its moving ranges are ordered.
    """
    df = rows.filter((F.col(units) > 0) & (F.col(rejects) >= 0)).withColumns({"proportion": F.col(rejects).cast("double") / F.col(units), "in_baseline": baseline})
    centre = df.filter("in_baseline").groupBy(*keys).agg(F.count("*").alias("baseline_count"), ratio(F.sum(rejects), F.sum(units)).alias("centre"))
    df = df.join(centre, keys, "left")
    usable = (F.col("centre") > 0) & (F.col("centre") < 1)
    df = df.withColumn("sigma_p", F.when(usable, F.sqrt(F.col("centre") * (1 - F.col("centre")) / F.col(units))))
    z = df.filter(F.col("in_baseline") & F.col("sigma_p").isNotNull()).withColumn("z", (F.col("proportion") - F.col("centre")) / F.col("sigma_p"))
    moving = z.withColumn("moving", F.abs(F.col("z") - F.lag("z").over(Window.partitionBy(*keys).orderBy(*order))))
    spread = moving.groupBy(*keys).agg((F.avg("moving") / d2).alias("sigma_z"))
    df = df.join(spread, keys, "left")
    reach = limits * F.col("sigma_z") * F.col("sigma_p")
    df = df.withColumns({"lower": F.when(reach.isNotNull(), F.greatest(F.lit(0.0), F.col("centre") - reach)), "upper": F.when(reach.isNotNull(), F.least(F.lit(1.0), F.col("centre") + reach))})
    status = F.when(F.col("upper").isNull(), "NO_BASELINE").when(F.col("proportion") > F.col("upper"), "ABOVE_UCL").when(F.col("proportion") < F.col("lower"), "BELOW_LCL").otherwise("IN_CONTROL")
    return df.withColumns({"status": status, "special_cause": F.when(F.col("upper").isNotNull(), (F.col("proportion") > F.col("upper")) | (F.col("proportion") < F.col("lower")))})


def phase_distribution(chart: DataFrame) -> DataFrame:
    """Counts of each status in each phase with their share of the phase."""
    phase = F.when(F.col("in_baseline"), "BASELINE").otherwise("MONITORING").alias("phase")
    df = chart.groupBy(phase, "status").agg(F.count("*").alias("n"))
    return df.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("phase"))))


def failure_event(maintenance: DataFrame, downtime: DataFrame) -> DataFrame:
    """Unplanned downtime events that work orders answer, the orders collapsed to a row for each event."""
    orders = maintenance.filter(~F.col("planned_flag")).groupBy("downtime_event_id").agg(
        F.count("*").alias("work_order_count"), F.min("start_timestamp").alias("first_repair"), F.sum("duration_hours").alias("repair_hours"), F.sum("total_cost").alias("repair_cost")
    )
    events = downtime.filter(~F.col("planned_flag")).select(F.col("source_record_id").alias("downtime_event_id"), "production_record_id", "site_id", "line_id", "equipment_id", "failure_category", "failure_reason", "event_start", (F.col("duration_min") / 60).alias("downtime_hours"))
    return events.join(orders, "downtime_event_id")


def failure_downtime(downtime: DataFrame, events: DataFrame) -> DataFrame:
    """Downtime by site and reason: all, unplanned and answered by work orders. Every downtime row counts once; a reason without unplanned downtime has null hours."""
    linked = events.select(F.col("downtime_event_id").alias("source_record_id"), F.lit(True).alias("_linked")).distinct()
    hours, unplanned, answered = F.col("duration_min") / 60, ~F.col("planned_flag"), F.col("_linked").isNotNull()
    return downtime.join(linked, "source_record_id", "left").groupBy("site_id", "failure_reason").agg(
        F.count("*").alias("event_count"),
        F.count_if(unplanned).alias("unplanned_count"),
        F.count_if(answered).alias("linked_count"),
        F.sum(hours).alias("total_hours"),
        F.sum(F.when(unplanned, hours)).alias("downtime_hours"),
        F.sum(F.when(answered, hours)).alias("linked_hours"),
        F.avg(F.when(unplanned, F.col("duration_min"))).alias("mean_unplanned_min"),
    )


def equipment_reliability(events: DataFrame, production: DataFrame, equipment: DataFrame) -> DataFrame:
    """Failures, repair times, gaps between failures and line exposure of each piece of equipment."""
    order = Window.partitionBy("equipment_id").orderBy("event_start", "downtime_event_id")
    gap = (seconds(F.col("event_start")) - seconds(F.lag("event_start").over(order))) / HOUR
    stats = events.withColumn("gap_hours", gap).groupBy("equipment_id").agg(
        F.count("*").alias("failure_count"),
        F.sum("work_order_count").alias("work_order_count"),
        F.sum("downtime_hours").alias("downtime_hours"),
        F.avg("repair_hours").alias("mttr_hours"),
        F.percentile("repair_hours", 0.5).alias("median_repair_hours"),
        F.avg("gap_hours").alias("mean_gap_hours"),
        F.percentile("gap_hours", 0.5).alias("median_gap_hours"),
    )
    exposure = production.groupBy("line_id").agg((F.sum("operating_time_min") / 60).alias("line_hours"))
    df = equipment.join(stats, "equipment_id", "left").join(exposure, "line_id", "left")
    mtbf = ratio("line_hours", "failure_count")
    return df.withColumns({"mtbf_hours": mtbf, "failures_per_1000_hours": ratio(F.col("failure_count") * 1000, "line_hours"), "availability_proxy": mtbf / (mtbf + F.col("mttr_hours")), "downtime_per_failure": ratio("downtime_hours", "failure_count")})


def equipment_type_summary(kpi: DataFrame) -> DataFrame:
    """Reliability by site and type; means leave out equipment that never failed, or failed once where gaps are asked."""
    some = F.col("failure_count") > 0
    return kpi.groupBy("site_id", "equipment_type").agg(
        F.count("*").alias("equipment_count"),
        F.count_if(some).alias("failed_count"),
        F.sum("failure_count").alias("failure_count"),
        F.sum("work_order_count").alias("work_order_count"),
        F.sum("downtime_hours").alias("downtime_hours"),
        F.avg(F.when(some, F.col("mttr_hours"))).alias("mean_mttr_hours"),
        F.avg(F.when(F.col("failure_count") > 1, F.col("mean_gap_hours"))).alias("mean_gap_hours"),
        F.avg("mtbf_hours").alias("mean_mtbf_hours"),
        F.avg("failures_per_1000_hours").alias("mean_failures_per_1000_hours"),
        F.avg("availability_proxy").alias("mean_availability"),
    )


def _rank_of_values(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with the dense rank of a value, greatest first: distinct values are ranked and joined back, so no task sorts all rows."""
    df = df.withColumn("_value", value)
    values = df.select("_value").distinct().withColumn(name, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_value").desc_nulls_last())))
    return df.join(values.withColumnRenamed("_value", "_ranked"), F.col("_value").eqNullSafe(F.col("_ranked")), "left").drop("_value", "_ranked")


def failure_burden(kpi: DataFrame) -> DataFrame:
    """Equipment that has failed, ranked by downtime (to a millionth of an hour) and by failures."""
    failed = kpi.filter(F.col("failure_count") > 0).withColumn("hours_per_failure", ratio("downtime_hours", "failure_count"))
    return _rank_of_values(_rank_of_values(failed, F.round("downtime_hours", 6), "burden_rank"), F.col("failure_count"), "frequency_rank")


def monthly_reliability(events: DataFrame, production: DataFrame, by: str) -> DataFrame:
    """Failures against operating hours by month of the production shift; months without a failure count 0."""
    month = F.trunc("timestamp_start", "MM").alias("month")
    exposure = production.groupBy(month, by).agg((F.sum("operating_time_min") / 60).alias("hours"))
    shift = production.select(F.col("source_record_id").alias("production_record_id"), month)
    failed = events.join(shift, "production_record_id").groupBy("month", by).agg(F.count("*").alias("failures"), F.countDistinct("equipment_id").alias("equipment"), F.sum("downtime_hours").alias("downtime_hours"))
    df = exposure.join(failed, ["month", by], "left").fillna(0, ["failures", "equipment"]).fillna(0.0, ["downtime_hours"])
    return df.withColumns({"failures_per_1000_hours": ratio(F.col("failures") * 1000, "hours"), "mtbf_hours": ratio("hours", "failures"), "downtime_share": ratio("downtime_hours", "hours")})


def first_after(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within_hours: int) -> DataFrame:
    """As-of join: each left row with the first right row at or after it, `within_hours` at most; left rows without one stay.

    Time is cut into buckets of four times the reach. A right row goes to its own bucket, and to the one before if it lies
    within reach of it; there one sorted pass gives each left row the next right row. Left rows travel whole and once, and
    no two rows are paired, so keys with very many rows cost no more a row than others.
    """
    reach = within_hours * HOUR
    bucket = lambda at: F.floor(at / (4 * reach))
    known = lambda *columns: reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    others, by = [c for c in right.columns if c not in keys], [f"_k{i}" for i in range(len(keys))]
    side = lambda df, b, t, l, m: df.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], b.alias("_b"), F.col(t).alias("_t"), l.alias("_l"), m.alias("_m"))  # noqa: E731,E741
    # Left rows without a key or a time meet nothing; they are dealt out by their content.
    at = F.when(known(*keys, left_ts), bucket(seconds(F.col(left_ts)))).otherwise(F.xxhash64(F.to_json(F.struct("*"))))
    end = seconds(F.col(right_ts))
    near = F.explode(F.sequence(bucket(end - reach - 1), bucket(end)))  # a second more, for rounding
    rows = side(left, at, left_ts, F.struct("*"), F.lit(None)).unionByName(side(right.filter(known(*keys, right_ts)), near, right_ts, F.lit(None), F.struct(*others)))
    # Backwards in time; at one time right rows come first, the least of them last.
    order = Window.partitionBy(*by, "_b").orderBy(F.desc("_t"), F.col("_m").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_m", F.last("_m", ignorenulls=True).over(order)).filter("_l is not null")
    met = F.when(seconds(F.col(f"_m.{right_ts}")) <= seconds(F.col("_t")) + reach, F.col("_m"))
    return found.withColumn("_m", met).select("_l.*", *[F.col(f"_m.{c}").alias(c if c not in left.columns else f"right_{c}") for c in others])
