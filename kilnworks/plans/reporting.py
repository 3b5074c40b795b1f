"""Reporting views, conformers, event timelines and further measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.functions.measures import gold_measures, ratio, selected
from kilnworks.operators import conform, production, telemetry
from kilnworks.plans import manufacturing as m
from kilnworks.plans.manufacturing import query
from kilnworks.sources.fixtures import Plant

# The price list that is compared, the reach of an event's timeline.
PRICE_YEARS = (1996, 1997)
BEFORE, AFTER = "12 HOURS", "30 MINUTES"

query("v_co4_price_benchmark", "geo_code period_code price_value~", "select * from ref_price where left(period_code, 4) in ('1996', '1997')")(
    lambda p: p.ref_price.filter(F.substring("period_code", 1, 4).isin(*map(str, PRICE_YEARS)))
)
query("v_gb_site_opportunity", "site_id opportunity_eur~", "select site_id, cast(round(sum(cast(total_technical_loss_units as decimal(20, 6)) * cast(eur as decimal(12, 4))), 2) as double) opportunity_eur from acc group by 1")(
    lambda p: conform.to_reporting_types(production.technical_opportunity(m.accounting(p)))
)


def forecast(p: Plant) -> DataFrame:
    """Site days with the forecast of a week before, its signed and relative error."""
    error = F.col("lag_7") - F.col("units")
    known = m.daily(p).filter("lag_7 IS NOT NULL").withColumns({"error": error, "error_share": ratio(F.abs(error), "units")})
    return known.join(p.dim_site, "site_id", "left")


query("v_bi1_site_daily_forecast", "site_code day units~ lag_7~ error~ error_share~", f"select s.site_code, x.*, lag_7 - units error, case when units > 0 then abs(lag_7 - units) / units end error_share from ({m._DAILY}) x left join dim_site s using (site_id) where lag_7 is not null")(forecast)


def energy_state(p: Plant) -> DataFrame:
    """Shifts whose energy per unit leaves the 0.5 to 99.5 per cent range of their line in the years before."""
    shifts = p.fact_production.withColumn("intensity", ratio(F.col("electricity_kwh") * 1000, "actual_quantity"))
    limits = shifts.filter(F.col("date_id") < 19970101).groupBy("line_id").agg(F.percentile("intensity", F.array(F.lit(0.005), F.lit(0.995))).alias("q"))
    state = F.when(F.col("intensity") > F.col("q")[1], "HIGH").when(F.col("intensity") < F.col("q")[0], "LOW").otherwise("NORMAL")
    return shifts.filter(F.col("date_id") >= 19970101).join(limits, "line_id", "left").withColumn("state", state).join(p.dim_line.select("line_id", "line_code"), "line_id", "left")


query(
    "v_bi2_shift_energy_anomaly",
    "source_record_id line_code intensity~ state",
    """select *, case when intensity > q[2] then 'HIGH' when intensity < q[1] then 'LOW' else 'NORMAL' end state from (select *, electricity_kwh * 1000 / actual_quantity intensity from fact_production where date_id >= 19970101) f
  left join (select line_id, quantile_cont(electricity_kwh * 1000 / actual_quantity, [0.005, 0.995]) q from fact_production where date_id < 19970101 group by 1) l using (line_id) left join (select line_id, line_code from dim_line) n using (line_id)""",
)(energy_state)
query(
    "v_bi3_monthly_reliability",
    "month_id site_code failures downtime_hours~",
    """select cast(year(p.timestamp_start) * 100 + month(p.timestamp_start) as int) month_id, s.site_code, count(ev.downtime_event_id) failures, coalesce(sum(downtime_hours), 0) downtime_hours
  from fact_production p left join ev on ev.production_record_id = p.source_record_id join dim_site s on s.site_id = p.site_id group by 1, 2""",
)(
    lambda p: m.control.monthly_reliability(m.events(p).drop("line_id"), p.fact_production, "site_id")
    .join(p.dim_site, "site_id")
    .withColumn("month_id", F.date_format("month", "yyyyMM").cast("int"))
)
query(
    "v_bi4_monthly_type_reliability",
    "month_id site_code equipment_type failures mttr_hours~",
    """select cast(year(p.timestamp_start) * 100 + month(p.timestamp_start) as int) month_id, s.site_code, e.equipment_type, count(*) failures, avg(repair_hours) mttr_hours
  from ev join fact_production p on p.source_record_id = ev.production_record_id join dim_equipment e on e.equipment_id = ev.equipment_id join dim_site s on s.site_id = ev.site_id group by 1, 2, 3""",
)(lambda p: m.by_type(p).join(p.dim_site, "site_id").withColumn("month_id", F.date_format("month", "yyyyMM").cast("int")))


def gold_rows(p: Plant) -> DataFrame:
    """Shift accounting with the energy detail of the shift."""
    detail = p.fact_line_energy_detail.select(
        F.col("production_record_id").alias("source_record_id"), F.col("line_idle_electricity_kwh").alias("idle_kwh"), F.col("line_total_electricity_kwh").alias("detail_kwh"), "compressed_air_nm3"
    )
    return m.accounting(p).join(detail, "source_record_id", "left")


query(
    "bi_gold_measures_by_site",
    "site_id planned_downtime_loss_units~ unplanned_downtime_loss_units~ performance_loss_units~ quality_loss_units~ total_technical_loss_units~ technical_opportunity_eur~ performance_eur~ quality_eur~ planned_downtime_eur~ unplanned_downtime_eur~ oee~ line_electricity_kwh~ kwh_per_1000_good~ idle_kwh~ idle_energy_share~ air_nm3~ air_nm3_per_1000~",
    """select a.site_id, sum(planned_downtime_loss_units) planned_downtime_loss_units, sum(unplanned_downtime_loss_units) unplanned_downtime_loss_units, sum(performance_loss_units) performance_loss_units, sum(quality_loss_units) quality_loss_units,
  sum(total_technical_loss_units) total_technical_loss_units, sum(total_technical_eur) technical_opportunity_eur, sum(performance_loss_units * eur) performance_eur, sum(quality_loss_units * eur) quality_eur,
  sum(planned_downtime_loss_units * eur) planned_downtime_eur, sum(unplanned_downtime_loss_units * eur) unplanned_downtime_eur,
  sum(operating_time_min) / sum(planned_production_time_min) * (sum(a.actual_quantity) / sum(operating_time_min / 60 * nominal_rate)) * (sum(good_quantity) / sum(a.actual_quantity)) oee,
  sum(electricity_kwh) line_electricity_kwh, sum(electricity_kwh) * 1000 / sum(good_quantity) kwh_per_1000_good, sum(line_idle_electricity_kwh) idle_kwh, sum(line_idle_electricity_kwh) / sum(line_total_electricity_kwh) idle_energy_share,
  sum(compressed_air_nm3) air_nm3, sum(compressed_air_nm3) * 1000 / sum(a.actual_quantity) air_nm3_per_1000 from acc a left join fact_line_energy_detail d on d.production_record_id = a.source_record_id group by 1""",
)(lambda p: gold_rows(p).groupBy("site_id").agg(*[v.alias(k) for k, v in gold_measures().items()]))
query(
    "bi_selected_names",
    "site_id line_name equipment_type",
    "select l.site_id, case when count(distinct line_name) = 1 then max(line_name) else 'All Lines' end line_name, case when count(distinct equipment_type) = 1 then max(equipment_type) else 'All Types' end equipment_type from dim_line l left join dim_equipment e using (line_id) group by 1",
)(lambda p: p.dim_line.join(p.dim_equipment, "line_id", "left").groupBy("site_id").agg(selected("line_name", "All Lines").alias("line_name"), selected("equipment_type", "All Types").alias("equipment_type")))


def timeline(p: Plant) -> DataFrame:
    """Telemetry around each failure by phase; windows and readings meet by hour, so neither side meets all of the other."""
    onset = F.col("failure_start")
    windows = p.failure_window.withColumns({"begins": onset - F.expr(f"INTERVAL {BEFORE}"), "ends": F.least(F.col("failure_end"), onset + F.expr(f"INTERVAL {AFTER}")), "warned": onset - F.expr("INTERVAL 2 HOURS")})
    hours = windows.withColumn("hour", F.explode(F.expr("sequence(date_trunc('hour', begins), date_trunc('hour', ends), INTERVAL 1 HOUR)")))
    near = p.telemetry.withColumn("hour", F.date_trunc("hour", "event_timestamp")).join(hours, "hour").filter("event_timestamp BETWEEN begins AND ends")
    to_fault = (m.control.seconds(onset) - m.control.seconds(F.col("event_timestamp"))) / 3600
    phase = F.when(F.col("event_timestamp") < F.col("warned"), "BASELINE").when(F.col("event_timestamp") < onset, "WARNING").otherwise("FAULT")
    return near.withColumns({"hours_to_fault": to_fault, "phase": phase})


query(
    "v_pdm3_event_timeline",
    "failure_id event_id equipment_id event_timestamp hours_to_fault~ phase",
    """select *, epoch(failure_start - event_timestamp) / 3600 hours_to_fault, case when event_timestamp < failure_start - interval 2 hour then 'BASELINE' when event_timestamp < failure_start then 'WARNING' else 'FAULT' end phase
  from telemetry join failure_window on event_timestamp between failure_start - interval 12 hour and least(failure_end, failure_start + interval 30 minute)""",
)(timeline)
query("gt17_timeline", "failure_id readings phases", """select failure_id, count(*) readings, count(distinct case when event_timestamp < failure_start - interval 2 hour then 1 when event_timestamp < failure_start then 2 else 3 end) phases
  from telemetry join failure_window on event_timestamp between failure_start - interval 12 hour and least(failure_end, failure_start + interval 30 minute) group by 1""")(
    lambda p: timeline(p).groupBy("failure_id").agg(F.count("*").alias("readings"), F.countDistinct("phase").alias("phases"))
)
query("topk3_failure_frequency", "equipment_id failure_count", "select equipment_id, failure_count from eq where failure_count > 0 order by failure_count desc, equipment_id limit 20")(
    lambda p: m.reliability(p).filter("failure_count > 0").orderBy(F.desc("failure_count"), "equipment_id").limit(20)
)
query("topk4_downtime_burden", "equipment_id downtime_hours~", "select equipment_id, downtime_hours from eq where failure_count > 0 order by round(downtime_hours, 6) desc, equipment_id limit 20")(
    lambda p: m.reliability(p).filter("failure_count > 0").orderBy(F.round("downtime_hours", 6).desc(), "equipment_id").limit(20)
)
query("biz3_recomputed_evidence", "site_id side", "select site_id, '' side from acc where false")(
    lambda p: conform.difference(production.technical_opportunity(m.accounting(p)), production.technical_opportunity(m.accounting(p).repartition("line_id")))
)

query(
    "ld2_calendar",
    "date_id iso_week iso_day quarter month_name day_name is_weekend",
    "select cast(strftime(d, '%Y%m%d') as int) date_id, cast(weekofyear(d) as int) iso_week, cast(isodow(d) as int) iso_day, cast(quarter(d) as int) as quarter, monthname(d) month_name, dayname(d) day_name, isodow(d) >= 6 is_weekend from (select distinct cast(timestamp_start as date) d from fact_production) x",
)(lambda p: conform.calendar(p.fact_production, "timestamp_start").join(p.fact_production.select(F.date_format("timestamp_start", "yyyyMMdd").cast("int").alias("date_id")).distinct(), "date_id", "left_semi"))


def coded(p: Plant) -> DataFrame:
    """Production rows as they arrive, with codes in place of ids."""
    lines = p.dim_line.select("line_id", "line_code").join(p.dim_equipment.select(F.col("equipment_id").alias("e"), F.col("line_id").alias("l"), "equipment_code"), F.col("line_id") == F.col("l"))
    return p.fact_production.drop("line_id", "site_id").join(lines.select("e", "line_code", "equipment_code"), F.col("equipment_id") == F.col("e")).drop("equipment_id", "e")


def production_fact(p: Plant) -> DataFrame:
    dims = {"line_id": (p.dim_line, ["line_code"], "line_id"), "equipment_id": (p.dim_equipment, ["equipment_code"], "equipment_id")}
    known, _ = conform.resolve(coded(p), dims)
    return known.withColumns({"actual_rate": conform.actual_rate("actual_quantity", "operating_time_min"), "demand_kw": conform.demand_kw("electricity_kwh", F.col("planned_production_time_min") / 60)})


query(
    "ld4_production_fact",
    "source_record_id line_id equipment_id date_id actual_rate~ demand_kw~",
    "select *, case when operating_time_min > 0 then actual_quantity / (operating_time_min / 60) end actual_rate, electricity_kwh / (planned_production_time_min / 60) demand_kw from fact_production",
)(production_fact)


def downtime_fact(p: Plant) -> DataFrame:
    """Downtime with the id of its (category, reason, planned) key."""
    keys = ["failure_category", "failure_reason", "planned_flag"]
    reasons = p.fact_downtime.select(*keys).distinct().withColumn("reason_id", F.sha1(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    return conform.resolve(p.fact_downtime, {"reason_id": (reasons, keys, "reason_id")})[0]


query("ld5_downtime_fact", "source_record_id reason_id", "select source_record_id, sha1(concat_ws('|', failure_category, failure_reason, cast(planned_flag as varchar))) reason_id from fact_downtime")(downtime_fact)
query("ld6_quality_fact", "source_record_id equipment_id rejected_units", "select q.source_record_id, p.equipment_id, q.rejected_units from fact_quality q join fact_production p on p.source_record_id = q.production_record_id")(
    lambda p: p.fact_quality.join(p.fact_production.select(F.col("source_record_id").alias("production_record_id"), "equipment_id"), "production_record_id")
)
query("ld7_maintenance_lineage", "work_order_id downtime_event_id", "select work_order_id, downtime_event_id from fact_maintenance w where exists (select 1 from fact_downtime d where d.source_record_id = w.downtime_event_id)")(
    lambda p: p.fact_maintenance.join(p.fact_downtime.select(F.col("source_record_id").alias("downtime_event_id")), "downtime_event_id", "left_semi")
)
query("ld9_site_energy_ids", "site_id date_id shift_code record_id", "select site_id, date_id, shift_code, concat('SITEENERGY-', substr(sha1(concat_ws('|', site_id, shift_code, date_id)), 1, 24)) record_id from fact_site_energy_detail")(
    lambda p: p.fact_site_energy_detail.withColumn("record_id", conform.record_id("SITEENERGY-", "site_id", "shift_code", "date_id"))
)
query("ld10_orphans", "side rows", "select 'downtime' side, count(*) as rows from fact_downtime d where not exists (select 1 from fact_production q where q.source_record_id = d.production_record_id) union all select 'maintenance', count(*) from fact_maintenance d where not exists (select 1 from fact_downtime q where q.source_record_id = d.downtime_event_id)")(
    lambda p: p.fact_downtime.join(p.fact_production.select(F.col("source_record_id").alias("production_record_id")), "production_record_id", "left_anti").agg(F.lit("downtime").alias("side"), F.count("*").alias("rows")).unionByName(
        p.fact_maintenance.join(p.fact_downtime.select(F.col("source_record_id").alias("downtime_event_id")), "downtime_event_id", "left_anti").agg(F.lit("maintenance").alias("side"), F.count("*").alias("rows"))
    )
)
query(
    "dk2_shift_weather",
    "source_record_id temperature~",
    "select source_record_id, w.t temperature from fact_production p left join (select site_id, shift_code, date_id, avg(mean_air_temperature_c) t from fact_site_energy_detail group by 1, 2, 3) w on w.site_id = p.site_id and w.shift_code = p.shift_code and w.date_id = p.date_id",
)(lambda p: p.fact_production.join(p.fact_site_energy_detail.groupBy("site_id", "shift_code", "date_id").agg(F.avg("mean_air_temperature_c").alias("temperature")), ["site_id", "shift_code", "date_id"], "left"))
query("dk3_weather_power", "site_id date_id shift_code weather_kw~", "select site_id, date_id, shift_code, site_weather_auxiliary_kw weather_kw from fact_site_energy_detail")(
    lambda p: p.fact_site_energy_detail.withColumn("weather_kw", conform.weather_kw("mean_air_temperature_c"))
)
query(
    "dk4_site_shift_rollup",
    "site_id date_id shift_code line_kwh~ units temperature~",
    "select site_id, date_id, shift_code, line_electricity_kwh line_kwh, production_units units, mean_air_temperature_c temperature from fact_site_energy_detail",
)(
    lambda p: p.fact_line_energy_detail.groupBy("site_id", "date_id", "shift_code", "timestamp_start").agg(
        F.sum("line_total_electricity_kwh").alias("line_kwh"), F.sum("actual_quantity").alias("units"), F.max("shift_mean_air_temperature_c").alias("temperature")
    )
)
query(
    "dk5_reject_reconciliation",
    "source_record_id expected~ summed~",
    "select source_record_id, reject_quantity expected, coalesce(s, 0) summed from fact_production p left join (select production_record_id, sum(rejected_units) s from fact_quality group by 1) q on q.production_record_id = p.source_record_id where abs(reject_quantity - coalesce(s, 0)) > 1e-6",
)(lambda p: conform.parent_differences(p.fact_production, "source_record_id", "reject_quantity", p.fact_quality, "production_record_id", F.col("rejected_units").cast("double")))
query(
    "dk6_work_order_intervals",
    "early late reversed",
    "select count(*) filter (start_timestamp < event_start) early, count(*) filter (w.end_timestamp > event_end) late, count(*) filter (w.end_timestamp < start_timestamp) as reversed from fact_maintenance w join fact_downtime d on d.source_record_id = w.downtime_event_id",
)(
    lambda p: conform.outside_parent(
        p.fact_maintenance.join(p.fact_downtime.select(F.col("source_record_id").alias("downtime_event_id"), "event_start", "event_end"), "downtime_event_id"), "start_timestamp", "end_timestamp", "event_start", "event_end"
    )
)
query("dk7_air_by_class", "class air_nm3~", "select case when starts_with(product_code, 'P') then 'P' else 'OTHER' end as class, sum(compressed_air_nm3) air_nm3 from fact_line_energy_detail group by 1")(
    lambda p: p.fact_line_energy_detail.groupBy(F.when(F.col("product_code").startswith("P"), "P").otherwise("OTHER").alias("class")).agg(F.sum("compressed_air_nm3").alias("air_nm3"))
)


def precursor(p: Plant) -> DataFrame:
    """Bins in the half-open day before a failure."""
    days = p.failure_window.withColumn("day", F.explode(F.expr("sequence(date_trunc('day', failure_start - INTERVAL 24 HOURS), date_trunc('day', failure_start), INTERVAL 1 DAY)")))
    known = m.alerts(p).withColumn("day", F.date_trunc("day", "bin"))
    return known.join(days, "day").filter("bin >= failure_start - INTERVAL 24 HOURS AND bin < failure_start").select("equipment_id", "bin", "failure_id")


query("ts13_precursor_labels", "equipment_id bin failure_id", "select equipment_id, bin, failure_id from ep join failure_window on bin >= failure_start - interval 24 hour and bin < failure_start")(precursor)
query("ts19_alert_episodes", "equipment_id bin failure_id", "select equipment_id, bin, max(failure_id) failure_id from ep left join failure_window on bin >= failure_start - interval 24 hour and bin < failure_start where start group by 1, 2")(
    lambda p: m.alerts(p).filter("start").select("equipment_id", "bin").join(precursor(p), ["equipment_id", "bin"], "left").groupBy("equipment_id", "bin").agg(F.max("failure_id").alias("failure_id"))
)
query("ml7_average_precision", "average_precision~", """select sum(ap) average_precision from (select (tp - coalesce(lag(tp) over (order by z desc), 0)) / total * tp / seen ap from (select z, sum(pos) over w tp, sum(n) over w seen, sum(pos) over () total
  from (select z, count(*) n, count(*) filter (hit) pos from (select z, exists (select 1 from failure_window where bin >= failure_start - interval 24 hour and bin < failure_start) hit from ep where z is not null) e group by 1) g
  window w as (order by z desc rows unbounded preceding)) r) a""")(
    lambda p: telemetry.average_precision(m.alerts(p).filter("robust_z IS NOT NULL").join(precursor(p).select("equipment_id", "bin", F.lit(True).alias("hit")).distinct(), ["equipment_id", "bin"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "hit", "robust_z")
)
query("ts9_split", "equipment_id part bins", """select equipment_id, case when k <= floor(0.7 * n) then 'TRAIN' else 'CALIBRATION' end part, count(*) bins from (select equipment_id, row_number() over w k, count(*) over (partition by equipment_id) n from bins
  window w as (partition by equipment_id order by bin)) b group by 1, 2""")(
    lambda p: telemetry.split_by_position(m.bins(p), "equipment_id", "bin", 0.7).groupBy("equipment_id", "part").agg(F.count("*").alias("bins"))
)


def month_split(p: Plant) -> DataFrame:
    """Days of each line, in parts by the month in which it begins; days with few units are left out of learning."""
    days = p.fact_production.groupBy("line_id", F.date_trunc("day", "timestamp_start").cast("timestamp_ntz").alias("day")).agg(F.sum("good_quantity").alias("units"))
    parts = telemetry.split_by_month(days.withColumn("few", F.col("units") < 1500), "line_id", "day", "few", least=1)
    return parts.groupBy("line_id", "part").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"))


query("ts9_month_split", "line_id part days first last", """select line_id, part, count(*) as days, min(dy) as first, max(dy) as last from (select line_id, dy, case when dy >= later then 'HOLDOUT' when units < 1500 then 'EXCLUDED'
  when dy < (arr)[cast(floor(round(0.7 * len(arr), 6)) as bigint) + 1] then 'TRAIN' else 'CALIBRATION' end part
  from (select *, list(dy order by dy) filter (dy < later) over (partition by line_id) arr from (select *, date_trunc('month', min(dy) over (partition by line_id)) + interval 1 month later
    from (select line_id, cast(cast(timestamp_start as date) as timestamp) dy, sum(good_quantity) units from fact_production group by 1, 2) a) b) c) d group by 1, 2""")(month_split)  # fmt: skip
