"""OEE, loss accounting, roll-ups, rankings and Pareto tables.

Roll-ups divide sums by sums; every ratio is null where its denominator isn't positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions.measures import ratio


def shift_production_kpi(production: DataFrame) -> DataFrame:
    """One row for each production record with availability, performance, quality, attainments, throughputs and OEE."""
    hours = F.col("operating_time_min") / 60
    df = production.withColumns(
        {
            "availability": ratio("operating_time_min", "planned_production_time_min"),
            "performance": F.when(F.col("operating_time_min") > 0, ratio("actual_quantity", hours * F.col("nominal_rate"))),
            "quality": ratio("good_quantity", "actual_quantity"),
            "production_attainment": ratio("actual_quantity", "planned_quantity"),
            "good_output_attainment": ratio("good_quantity", "planned_quantity"),
            "scheduled_throughput_per_hour": ratio("actual_quantity", F.col("planned_production_time_min") / 60),
            "running_throughput_per_hour": ratio("actual_quantity", hours),
            "reject_rate": ratio("reject_quantity", "actual_quantity"),
        }
    )
    return df.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))


def shift_production_loss(kpi: DataFrame, downtime: DataFrame) -> DataFrame:
    """Adds downtime by kind and the units lost to it; downtime is summed by record before the join, so nothing fans out."""
    when = lambda flag: F.sum(F.when(flag, F.col("duration_min")).otherwise(0.0))
    planned = F.col("planned_flag")
    by_record = downtime.groupBy("production_record_id").agg(
        when(planned).alias("planned_downtime_min"), when(~planned).alias("unplanned_downtime_min"), when(planned & (F.col("failure_category") == "CHANGEOVER")).alias("changeover_downtime_min")
    )
    kinds = ["planned_downtime_min", "unplanned_downtime_min", "changeover_downtime_min"]
    df = kpi.join(by_record, F.col("source_record_id") == F.col("production_record_id"), "left").drop("production_record_id")
    df = df.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in kinds})
    units = lambda k: F.col(k) * F.col("nominal_rate") / 60
    return df.withColumns(
        {
            "planned_downtime_loss_units": units("planned_downtime_min"),
            "unplanned_downtime_loss_units": units("unplanned_downtime_min"),
            "changeover_loss_units": units("changeover_downtime_min"),
            "speed_loss_units": F.greatest(units("operating_time_min") - F.col("actual_quantity"), F.lit(0.0)),
            "quality_loss_units": F.col("reject_quantity").cast("double"),
            "total_good_output_gap_units": F.greatest(F.col("planned_quantity") - F.col("good_quantity"), F.lit(0)).cast("double"),
        }
    )


def shift_loss_accounting(loss: DataFrame, values: DataFrame) -> DataFrame:
    """Exact technical losses against theoretical capacity, in units and in money where the product has a value."""
    df = loss.withColumns(
        {
            "theoretical_capacity_units": F.col("planned_production_time_min") * F.col("nominal_rate") / 60,
            "operating_capacity_units": F.col("operating_time_min") * F.col("nominal_rate") / 60,
        }
    )
    df = df.withColumns(
        {
            "availability_loss_units": F.greatest(F.col("theoretical_capacity_units") - F.col("operating_capacity_units"), F.lit(0.0)),
            "performance_loss_units": F.greatest(F.col("operating_capacity_units") - F.col("actual_quantity"), F.lit(0.0)),
            "plan_shortfall_units": F.greatest(F.col("planned_quantity") - F.col("good_quantity"), F.lit(0)).cast("double"),
        }
    )
    lost = F.col("availability_loss_units") + F.col("performance_loss_units") + F.col("quality_loss_units")
    df = df.withColumns(
        {
            "total_technical_loss_units": lost,
            "technical_capacity_gap_units": F.greatest(F.col("theoretical_capacity_units") - F.col("good_quantity"), F.lit(0.0)),
            "technical_output_efficiency": ratio("good_quantity", "theoretical_capacity_units"),
        }
    ).join(values.withColumn("eur_per_unit", F.col("eur_per_unit").cast("double")), "product_code", "left")
    money = {k: f"{k}_loss_units" for k in ("planned_downtime", "unplanned_downtime", "changeover", "performance", "quality")} | {"total_technical": "total_technical_loss_units", "plan_shortfall": "plan_shortfall_units"}
    return df.withColumns({f"{k}_eur": F.col(v) * F.col("eur_per_unit") for k, v in money.items()})


SUMS = ["planned_quantity", "actual_quantity", "good_quantity", "reject_quantity"]


def grouped(df: DataFrame, keys: list[str] | dict[str, list[str]], measures: list[Column]) -> DataFrame:
    """The measures by keys; or, for {grain: keys}, all grains in one pass over df, with column `grain` and null in the keys that a grain lacks."""
    if isinstance(keys, list):
        return df.groupBy(*keys).agg(*measures)
    every = list(dict.fromkeys(k for own in keys.values() for k in own))
    ids = {sum(1 << (len(every) - 1 - i) for i, k in enumerate(every) if k not in own): name for name, own in keys.items()}
    if len(ids) < len(keys):
        raise ValueError("two grains have the same keys")
    made = df.groupingSets([[F.col(k) for k in own] for own in keys.values()], *every).agg(F.grouping_id().alias("_grain"), *measures)
    grain = F.lit(None).cast("string")
    for number, name in ids.items():
        grain = F.when(F.col("_grain") == number, name).otherwise(grain)
    return made.withColumn("grain", grain).drop("_grain")


def kpi_rollup(kpi: DataFrame, keys: list[str] | dict[str, list[str]]) -> DataFrame:
    """Shift KPIs at a coarser grain (or at several, by name, in one pass), by ratios of sums."""
    sums = [F.sum(c).alias(c) for c in [*SUMS, "operating_time_min", "planned_production_time_min"]]
    capacity = F.sum(F.col("operating_time_min") / 60 * F.col("nominal_rate")).alias("capacity")
    gross = F.sum(F.col("planned_production_time_min") / 60 * F.col("nominal_rate")).alias("gross_capacity")
    df = grouped(kpi, keys, [F.count("*").alias("shift_count"), *sums, capacity, gross])
    df = df.withColumns(
        {
            "availability": ratio("operating_time_min", "planned_production_time_min"),
            "performance": ratio("actual_quantity", "capacity"),
            "quality": ratio("good_quantity", "actual_quantity"),
            "production_attainment": ratio("actual_quantity", "planned_quantity"),
            "reject_rate": ratio("reject_quantity", "actual_quantity"),
            "gross_capacity_utilization": ratio("actual_quantity", "gross_capacity"),
            "running_throughput_per_hour": ratio("actual_quantity", F.col("operating_time_min") / 60),
        }
    )
    return df.withColumn("oee", F.col("availability") * F.col("performance") * F.col("quality"))


LOSSES = ["theoretical_capacity_units", "availability_loss_units", "performance_loss_units", "quality_loss_units", "plan_shortfall_units", "total_technical_loss_units", "technical_capacity_gap_units", "total_technical_eur"]


def loss_rollup(accounting: DataFrame, keys: list[str] | dict[str, list[str]]) -> DataFrame:
    """Losses at a coarser grain, or at several, by name, in one pass."""
    df = grouped(accounting, keys, [F.sum("good_quantity").alias("good_quantity"), *[F.sum(c).alias(c) for c in LOSSES]])
    return df.withColumn("technical_output_efficiency", ratio("good_quantity", "theoretical_capacity_units"))


def ranked(df: DataFrame, ranks: dict[str, tuple[str, bool, list[str]]]) -> DataFrame:
    """Dense ranks: name -> (measure, descending, partition). Nulls come first when descending and last when ascending.

    For summaries only: a rank without a partition sorts all rows in one task.
    """
    def rank(measure: str, down: bool, by: list[str]) -> Column:
        order = F.col(measure).desc_nulls_first() if down else F.col(measure).asc_nulls_last()
        return F.dense_rank().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order))

    return df.withColumns({name: rank(*spec) for name, spec in ranks.items()})


def pareto(df: DataFrame, part: list[str], measure: str, ties: list[str]) -> DataFrame:
    """Rank, share and cumulative share of a summed measure inside each part; ties decides between equals."""
    order = Window.partitionBy(*part).orderBy(F.col(measure).desc_nulls_last(), *ties)
    whole = F.sum(measure).over(Window.partitionBy(*part))
    running = F.sum(measure).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({"total": whole, "cumulative": running, "pareto_rank": F.row_number().over(order)}).withColumns({"share": ratio(measure, "total"), "cumulative_share": ratio("cumulative", "total")})


def downtime_by_reason(downtime: DataFrame) -> DataFrame:
    return downtime.groupBy("site_id", "failure_category", "failure_reason", "planned_flag").agg(F.count("*").alias("event_count"), F.sum("duration_min").alias("downtime_min"))


def changeover_summary(downtime: DataFrame) -> DataFrame:
    """Changeovers of each line: count, sum, mean, exact median, bounds."""
    d = downtime.filter(F.col("planned_flag") & (F.col("failure_category") == "CHANGEOVER"))
    m = "duration_min"
    return d.groupBy("site_id", "line_id").agg(
        F.count("*").alias("changeover_count"), F.sum(m).alias("total_min"), F.avg(m).alias("mean_min"), F.percentile(m, 0.5).alias("median_min"), F.min(m).alias("least_min"), F.max(m).alias("most_min")
    )


def site_benchmark(lines: DataFrame) -> DataFrame:
    """Plain means and bounds of the lines of each site (means of ratios on purpose), and the site's quantities."""
    mean = {"mean_line_oee": F.col("oee"), "mean_line_attainment": F.col("production_attainment"), "mean_line_good_attainment": ratio("good_quantity", "planned_quantity"), "mean_line_utilization": F.col("gross_capacity_utilization")}
    sums = ["planned_quantity", "actual_quantity", "good_quantity", "reject_quantity"]
    return lines.groupBy("site_id").agg(
        F.count("*").alias("line_count"),
        F.min("oee").alias("least_line_oee"),
        F.max("oee").alias("most_line_oee"),
        *[F.avg(c).alias(k) for k, c in mean.items()],
        *[F.sum(c).alias(c) for c in sums],
    )


def technical_opportunity(accounting: DataFrame) -> DataFrame:
    """Money lost at each site in exact decimals, to the cent."""
    value = F.col("total_technical_loss_units").cast("decimal(20,6)") * F.col("eur_per_unit").cast("decimal(12,4)")
    return accounting.groupBy("site_id").agg(F.round(F.sum(value), 2).cast("decimal(20,2)").alias("opportunity_eur"))


def sensitivity(opportunity: DataFrame, rates: list[float]) -> DataFrame:
    """Yearly saving at several rates of realisation: half of the two-year total."""
    rows = opportunity.sparkSession.createDataFrame([(r,) for r in rates], "rate double")
    base = opportunity.agg((F.sum("opportunity_eur").cast("double") / 2).alias("base_eur"))
    return base.crossJoin(F.broadcast(rows)).withColumn("saving_eur", F.col("base_eur") * F.col("rate"))
