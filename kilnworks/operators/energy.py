"""Energy, utilities and electricity cost: intensities from ratios of sums, prices by site and half-year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.functions.measures import ratio, share
from kilnworks.operators.production import grouped


def shift_energy_kpi(production: DataFrame) -> DataFrame:
    kwh = F.col("electricity_kwh")
    return production.withColumns(
        {
            "average_demand_kw": ratio("electricity_kwh", F.col("planned_production_time_min") / 60),
            "kwh_per_1000": ratio(kwh * 1000, "actual_quantity"),
            "kwh_per_1000_good": ratio(kwh * 1000, "good_quantity"),
            "kwh_per_operating_hour": ratio("electricity_kwh", F.col("operating_time_min") / 60),
        }
    )


def energy_rollup(shifts: DataFrame, keys: list[str] | dict[str, list[str]]) -> DataFrame:
    """Energy at a coarser grain, or at several, by name, in one pass."""
    sums = [F.sum(c).alias(c) for c in ("electricity_kwh", "actual_quantity", "good_quantity", "operating_time_min")]
    df = grouped(shifts, keys, [*sums, F.avg("average_demand_kw").alias("average_demand_kw")])
    return df.withColumns({"kwh_per_1000": ratio(F.col("electricity_kwh") * 1000, "actual_quantity"), "kwh_per_1000_good": ratio(F.col("electricity_kwh") * 1000, "good_quantity"), "kwh_per_operating_hour": ratio("electricity_kwh", F.col("operating_time_min") / 60)})


def shift_energy_detail_kpi(detail: DataFrame) -> DataFrame:
    idle = F.col("line_idle_electricity_kwh")
    return detail.withColumns({"idle_share": ratio(idle, "line_total_electricity_kwh"), "idle_kwh_per_1000": ratio(idle * 1000, "actual_quantity")})


def idle_energy_summary(detail: DataFrame) -> DataFrame:
    parts = {"production_kwh": "line_production_electricity_kwh", "idle_kwh": "line_idle_electricity_kwh", "total_kwh": "line_total_electricity_kwh", "actual_quantity": "actual_quantity"}
    df = detail.groupBy("site_id", "line_id").agg(*[F.sum(c).alias(k) for k, c in parts.items()])
    return df.withColumns({"idle_share": ratio("idle_kwh", "total_kwh"), "idle_kwh_per_1000": ratio(F.col("idle_kwh") * 1000, "actual_quantity")})


def compressed_air_summary(detail: DataFrame) -> DataFrame:
    """Air of each line; shifts without a value are left out of both sides of the ratio, not counted as zero."""
    known = F.col("compressed_air_nm3").isNotNull()
    df = detail.groupBy("site_id", "line_id").agg(
        F.count("*").alias("shift_count"), F.count_if(known).alias("modelled_shift_count"), F.sum("compressed_air_nm3").alias("air_nm3"), F.sum(F.when(known, F.col("actual_quantity"))).alias("modelled_units")
    )
    return df.withColumn("nm3_per_1000", ratio(F.col("air_nm3") * 1000, "modelled_units"))


def site_auxiliary_kpi(site: DataFrame) -> DataFrame:
    weather = F.col("site_weather_auxiliary_kw") * F.col("shift_hours")
    return site.withColumns(
        {
            "auxiliary_share": ratio("site_auxiliary_electricity_kwh", "site_total_electricity_kwh"),
            "weather_share": ratio(weather, "site_auxiliary_electricity_kwh"),
            "auxiliary_kwh_per_1000": ratio(F.col("site_auxiliary_electricity_kwh") * 1000, "production_units"),
            "total_kwh_per_1000": ratio(F.col("site_total_electricity_kwh") * 1000, "production_units"),
        }
    )


def site_auxiliary_summary(site: DataFrame) -> DataFrame:
    line, aux, total = "line_electricity_kwh", "site_auxiliary_electricity_kwh", "site_total_electricity_kwh"
    return site.groupBy("site_id").agg(
        *[F.sum(c).alias(c) for c in (line, aux, total)],
        F.sum("production_units").alias("production_units"),
        share(aux, total).alias("auxiliary_share"),
        ratio(F.sum(total) * 1000, F.sum("production_units")).alias("total_kwh_per_1000"),
        F.avg("mean_air_temperature_c").alias("mean_air_temperature_c"),
        F.avg("site_weather_auxiliary_kw").alias("mean_weather_kw"),
    )


def electricity_cost(site_detail: DataFrame, sites: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each site-shift at the price of its site and half-year; null where no price is known."""
    half = F.concat(F.date_format("timestamp_start", "yyyy"), F.when(F.month("timestamp_start") <= 6, "-S1").otherwise("-S2"))
    df = site_detail.join(F.broadcast(sites.select("site_id", "site_code")), "site_id").withColumn("period_code", half)
    df = df.join(prices.withColumnRenamed("geo_code", "site_code"), ["site_code", "period_code"], "left")
    df = df.withColumn("cost_eur", F.col("site_total_electricity_kwh") * F.col("price_value"))
    return df.withColumn("cost_eur_per_1000", ratio(F.col("cost_eur") * 1000, "production_units"))


def electricity_cost_summary(cost: DataFrame) -> DataFrame:
    kwh, units = "site_total_electricity_kwh", "production_units"
    return cost.groupBy("site_id").agg(
        F.sum(kwh).alias("kwh"), F.sum("cost_eur").alias("cost_eur"), F.sum(units).alias("units"), share("cost_eur", kwh).alias("eur_per_kwh"), ratio(F.sum("cost_eur") * 1000, F.sum(units)).alias("cost_eur_per_1000")
    )


def consumption_band(cost: DataFrame, low_mwh: float = 2_000, high_mwh: float = 20_000) -> DataFrame:
    """Whether a site-year's consumption lies in the band for which the prices hold."""
    df = cost.groupBy("site_id", F.year("timestamp_start").alias("year")).agg((F.sum("site_total_electricity_kwh") / 1000).alias("mwh"))
    return df.withColumn("in_band", (F.col("mwh") >= low_mwh) & (F.col("mwh") < high_mwh))
