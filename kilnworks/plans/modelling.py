"""Policies, trained models, landing checks and the last measures; trained models have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.functions.measures import ratio
from kilnworks.operators import checks, models, policy, telemetry
from kilnworks.plans import gates, reporting
from kilnworks.plans import manufacturing as m
from kilnworks.plans.manufacturing import query
from kilnworks.sources import landing, silver
from kilnworks.sources.fixtures import Plant
from kilnworks.sources.shared import written

#: Failures that select a policy; the later ones test it. Validation ends a day before the third failure.
VALIDATION = ("1", "2")
SPLIT = "2024-01-19 12:00:00"
LEARN_UNTIL = "2024-01-12"
HORIZONS, NORMAL_QUANTILES = (24, 48, 72), (0.99, 0.995, 0.999)
MODEL_FEATURES = ["tp2_mean", "comp_active", "tp2_move", "tp2_mean_deviation", "tp2_mean_slope"]


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def raw_windows(p: Plant) -> DataFrame:
    """Downtime as a raw list of windows: two candidate columns for the start, planned ones reversed, short ones without one."""
    planned = F.col("planned_flag")
    return p.fact_downtime.select(
        "source_record_id",
        F.when(planned, F.col("event_end")).alias("start_time"),
        F.when(F.col("duration_min") >= 12, F.col("event_start")).alias("started_at"),
        F.when(planned, F.col("event_start")).otherwise(F.col("event_end")).alias("end_time"),
    )


query("ts8_failure_windows", "source_record_id failure_start failure_end", "select source_record_id, event_start failure_start, event_end failure_end from fact_downtime where planned_flag or duration_min >= 12")(
    lambda p: policy.parse_windows(raw_windows(p), ["start_time", "started_at", "begin"], ["end_time"])
)


def grid(p: Plant) -> DataFrame:
    return policy.grid_alerts(m.alerts(p), "equipment_id", "bin", "robust_z", lag=24, lookback=72, least=24)


def judged(p: Plant) -> DataFrame:
    known = grid(p).filter(F.col("bin") < _at(SPLIT))
    return policy.choose(policy.judge(known, "bin", policy.POLICY, p.failure_window.filter(F.col("failure_id").isin(*VALIDATION)), 24))


_QUANTILES = "[0.985, 0.99, 0.9925, 0.995]"
_GRID = f"""pol as (select * from (values (1, 0.985, 2, 3), (1, 0.985, 3, 4), (2, 0.99, 2, 3), (2, 0.99, 3, 4), (3, 0.9925, 2, 3), (3, 0.9925, 3, 4), (4, 0.995, 2, 3), (4, 0.995, 3, 4)) v(i, q, k, n)),
lim as (select equipment_id, bin, z, count(z) over f c, quantile_cont(z, {_QUANTILES}) over f t from rob window f as (partition by equipment_id order by bin rows between 95 preceding and 24 preceding)),
gh as (select equipment_id, bin, q, k, n, coalesce(c >= 24 and z >= t[i] - 1e-9, false) hot from lim cross join pol),
ga as (select *, case when n = 3 then sum(cast(hot as int)) over a >= k and count(*) over a = 3 else sum(cast(hot as int)) over b >= k and count(*) over b = 4 end alert from gh
  window a as (partition by equipment_id, q, k, n order by bin rows between 2 preceding and current row), b as (partition by equipment_id, q, k, n order by bin rows between 3 preceding and current row)),
gs as (select *, alert and not coalesce(lag(alert) over (partition by equipment_id, q, k, n order by bin), false) start from ga),
side as (select *, 'validation' split from gs where bin < timestamp '{SPLIT}' union all select *, 'test' from gs where bin >= timestamp '{SPLIT}'),
fw as (select *, case when failure_id in ('1', '2') then 'validation' else 'test' end split from failure_window),
fa as (select s.split, q, k, n, failure_id, failure_start, min(bin) t from side s join fw f on f.split = s.split and alert and bin between failure_start - interval 24 hour and failure_end group by all),
fd as (select split, q, k, n, count(*) detected, count(*) filter (epoch(failure_start - t) >= 7200) early, median(epoch(failure_start - t) / 3600) median_lead_h from fa group by all),
fb as (select split, q, k, n, greatest(epoch(max(bin) - min(bin)) / 86400, 1e-9) n_days, 100 * avg(cast(alert as int)) alert_pct,
  count(*) filter (start and not exists (select 1 from fw f where f.split = s.split and s.bin between failure_start - interval 24 hour and failure_end)) false_alerts from side s group by all),
jd as (select fb.*, coalesce(detected, 0) detected, coalesce(early, 0) early, median_lead_h, false_alerts / n_days false_per_day, (select count(*) from fw where fw.split = fb.split) events from fb left join fd using (split, q, k, n)),
jb as (select *, false_per_day <= 0.5 and alert_pct <= 3 within_budget from jd),
jr as (select *, row_number() over (partition by split order by cast(within_budget as int) desc, case when met then -early end, case when met then -detected end, false_per_day, alert_pct, -early, -detected, q, k, n) = 1 is_selected
  from (select *, bool_or(within_budget) over (partition by split) met from jb) x),
jk as (select * replace (case when split = 'test' then exists (select 1 from jr v where v.split = 'validation' and v.is_selected and v.q = jr.q and v.k = jr.k and v.n = jr.n) else is_selected end as is_selected) from jr)"""
_POLICY = "cast(q as double) quantile, k required, n as window"

query(
    "ts17_policy_grid",
    "quantile~ required window events detected early median_lead_h~ false_alerts false_per_day~ alert_pct~ within_budget is_selected",
    f"with {_GRID} select {_POLICY}, events, detected, early, median_lead_h, false_alerts, false_per_day, alert_pct, within_budget, is_selected from jk where split = 'validation'",
)(judged)


def all_kpi(p: Plant) -> DataFrame:
    """Every policy on the validation failures, and the frozen one's mark on the test failures."""
    frozen = judged(p)
    late = policy.judge(grid(p).filter(F.col("bin") >= _at(SPLIT)), "bin", policy.POLICY, p.failure_window.filter(~F.col("failure_id").isin(*VALIDATION)), 24)
    mark = F.broadcast(frozen.select(*policy.POLICY, "is_selected"))  # one row for each policy
    test = policy.choose(late).drop("is_selected").join(mark, policy.POLICY)
    return policy.policy_kpi({"validation": frozen, "test": test})


query("ts21_policy_kpi", "split quantile~ required window detected false_alerts within_budget is_selected", f"with {_GRID} select split, {_POLICY}, detected, false_alerts, within_budget, is_selected from jk")(all_kpi)
query(
    "v_pdm2_selected_policy",
    "split quantile~ required window events_evaluated events_warned events_missed warning_success_rate~ false_alerts false_per_day~",
    f"with {_GRID} select split, {_POLICY}, events events_evaluated, detected events_warned, events - detected events_missed, detected / events warning_success_rate, false_alerts, false_per_day from jk where is_selected",
)(lambda p: policy.selected_kpi(all_kpi(p)))


def scenario(p: Plant) -> DataFrame:
    return policy.condition_scenario(m.alerts(p), "bin", "robust_z", p.failure_window, {"oil_temperature": "tp2_mean", "reservoir_pressure": "tp2_max"})


query(
    "ts20_condition_scenario",
    "equipment_id bin event_timestamp degradation~ scenario_oil_temperature~ scenario_reservoir_pressure~ condition_score~ condition_state precursor_failure_id",
    """select *, bin + interval 4 year event_timestamp, m + 6 * degradation scenario_oil_temperature, hi - 0.6 * degradation scenario_reservoir_pressure, case when z is not null then greatest(least(100 - 60 * degradation - 10 / (1 + exp(-8 * z)), 100), 0) end condition_score,
  case when f is not null then 'FAULT' when degradation > 0 then 'DEGRADING' else 'NORMAL' end condition_state from (select e.*, case when h is null then 0 else greatest(least(1 - h / 6, 1), 0) end degradation, precursor_failure_id, f from ep e
  left join (select bin, max(epoch(failure_start - bin) / 3600) filter (bin < failure_start) h, arg_max(failure_id, failure_start) filter (bin < failure_start) precursor_failure_id, arg_max(failure_id, failure_start) filter (bin >= failure_start) f
    from (select distinct bin from ep) b join failure_window on bin between failure_start - interval 6 hour and failure_end group by 1) n using (bin)) s""",
)(scenario)


def horizon_kpi(p: Plant) -> DataFrame:
    """Scenario alerts by horizon, each judged within its own horizon."""
    known = policy.horizon_alerts(scenario(p), "equipment_id", "bin", (2, 4, 6))
    parts = [policy.judge(known.filter(F.col("horizon_h") == h), "bin", ["horizon_h"], p.failure_window, float(h)) for h in (2, 4, 6)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query("ts20_horizon_policies", "horizon_h events detected false_alerts alert_pct~", """with s as (select equipment_id, bin, coalesce((select max(1 - h / 6) from (select max(epoch(failure_start - bin) / 3600) h from failure_window where bin < failure_start and bin >= failure_start - interval 6 hour) x), 0) d from ep),
hz as (select s.*, h horizon_h from s cross join (values (2), (4), (6)) v(h)), ha as (select *, sum(cast(d > 1 - horizon_h / 6 as int)) over w >= 2 and count(*) over w = 3 alert from hz window w as (partition by equipment_id, horizon_h order by bin rows between 2 preceding and current row)),
hs as (select *, alert and not coalesce(lag(alert) over (partition by equipment_id, horizon_h order by bin), false) start from ha)
select horizon_h, (select count(*) from failure_window) events, (select count(distinct failure_id) from failure_window f join hs x on x.alert and x.horizon_h = hs.horizon_h and x.bin <= failure_end and epoch(failure_start - x.bin) <= 3600 * x.horizon_h) detected,
  count(*) filter (start and not exists (select 1 from failure_window f where hs.bin <= failure_end and epoch(failure_start - hs.bin) <= 3600 * hs.horizon_h)) false_alerts, 100 * avg(cast(alert as int)) alert_pct from hs group by 1""")(horizon_kpi)  # fmt: skip


def features(p: Plant) -> DataFrame:
    """Bins with trailing context; rows without it can't be scored."""
    known = telemetry.trailing_context(m.bins(p).filter("n > 0"), "equipment_id", ["tp2_mean"])
    return known.dropna(subset=MODEL_FEATURES)


def isolation(p: Plant) -> DataFrame:
    """Isolation scores; bins over the 99.5th percentile of the later learning bins are anomalies."""
    known = features(p)
    train, cal = known.filter(F.col("bin") < _at("2024-01-06")), F.col("bin").between(_at("2024-01-06"), _at("2024-01-08"))
    made = models.isolation_scores(train, known, MODEL_FEATURES, F.concat_ws("|", "equipment_id", "bin"))
    limit = made.filter(cal).agg(F.percentile_approx("isolation_score", 0.995, 100_000).alias("limit"))
    return made.crossJoin(F.broadcast(limit)).withColumn("anomaly", F.col("isolation_score") > F.col("limit"))  # one row


query("ml5_isolation_scores", "equipment_id bin isolation_score~ anomaly", None)(isolation)


def warnings(p: Plant) -> DataFrame:
    """Probability of a failure within each horizon from the bins before LEARN_UNTIL, with limits from their normal bins."""
    known, parts = written(features(p), "features"), []  # read by each pass of each fit
    for h in HORIZONS:
        near = telemetry.near_windows(known.select("bin").distinct(), m.control.seconds(F.col("bin")), p.failure_window, m.control.seconds(F.col("failure_start")) - h * 3600, m.control.seconds(F.col("failure_start")) - 1)
        flagged = known.join(near.select("bin", F.lit(1).alias("label")).distinct(), "bin", "left").na.fill(0, ["label"])
        train = flagged.filter(F.col("bin") < _at(LEARN_UNTIL))
        made = models.warning_probability(train, flagged, "label", MODEL_FEATURES)
        normal = made.filter((F.col("bin") < _at(LEARN_UNTIL)) & (F.col("label") == 0))
        limits = normal.agg(F.percentile_approx("probability", list(NORMAL_QUANTILES), 100_000).alias("limits"))
        each = made.crossJoin(F.broadcast(limits))  # one row
        pairs = F.arrays_zip(F.array(*map(F.lit, NORMAL_QUANTILES)).alias("q"), F.col("limits"))
        each = each.withColumn("pair", F.explode(pairs)).select("equipment_id", "bin", "label", "probability", F.col("pair.q").alias("quantile"), F.col("pair.limits").alias("limit"))
        parts.append(each.withColumns({"horizon_h": F.lit(h), "required": F.lit(2), "window": F.lit(3)}))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return policy.with_persistence(every.withColumn("hot", F.col("probability") >= F.col("limit")), ["equipment_id", "horizon_h", "quantile"], "bin", "hot", [3])


query("ml4_warning_probability", "equipment_id bin horizon_h quantile probability~ alert", None)(warnings)


def supervised(p: Plant) -> DataFrame:
    """The grid of horizons and limits on the bins after the learning ones, the least burdened of the best marked."""
    known = written(warnings(p).filter((F.col("bin") >= _at(LEARN_UNTIL)) & (F.col("bin") < _at(SPLIT))), "warnings")
    keys = ["horizon_h", "quantile"]
    parts = [policy.judge(known.filter(F.col("horizon_h") == h), "bin", keys, p.failure_window.filter("failure_id = '2'"), float(h)) for h in HORIZONS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    made = policy.choose(rows, [-F.col("horizon_h"), -F.col("quantile")])
    # A classifier that warns of nothing leaves the word to the anomaly policy, at the least horizon.
    return made.withColumn("model", F.when(F.max("detected").over(m.production.Window.partitionBy(F.lit(0))) > 0, "logistic_regression").otherwise("adaptive_anomaly_policy"))


query("ts18_supervised_grid", "horizon_h quantile detected false_alerts false_per_day~ alert_pct~ within_budget is_selected model", None)(supervised)
query("ml2_boosted_forecast", "site_id day units~ ml_forecast~ lag_7~ selected_model selected_forecast~ abs_error~ pct_error~", None)(
    lambda p: models.forecast_holdout(m.daily(p), "site_id", "day", "units", ["lag_1", "lag_7", "lag_14", "lag_28", "mean_7", "mean_28", "std_7", "std_28", "day_of_week", "day_of_month", "month", "week"])
)


def anomalies(p: Plant) -> DataFrame:
    rows = p.fact_production.select("source_record_id", "date_id", "site_id", F.col("line_id").cast("string").alias("line"), "timestamp_start", "electricity_kwh", *[F.col(c).cast("double").alias(c) for c in ("actual_quantity", "reject_quantity", "operating_time_min", "nominal_rate")])
    year = F.floor(F.col("date_id") / 10000)
    return models.contextual_anomaly(rows.filter(year == m.BASELINE), rows.filter(year == m.MONITORING), "electricity_kwh", ["actual_quantity", "reject_quantity", "operating_time_min", "nominal_rate"], "line", "timestamp_start")


query("ml3_energy_anomaly", "source_record_id line expected~ residual~ residual_pct~ status", None)(anomalies)


def shift_classes(p: Plant) -> DataFrame:
    """Shift of a production row from what it made; the last fifth of each shift's rows by time tests."""
    numeric = ["operating_time_min", "electricity_kwh", "actual_quantity", "reject_quantity"]
    rows = p.fact_production.select("shift_code", "timestamp_start", *[F.col(c).cast("double").alias(c) for c in numeric])
    rows = written(rows, "shifts")  # read by the cut and by each pass of the fit
    cut = F.broadcast(models.time_cut(rows, ["shift_code"], "timestamp_start", 0.8))  # a row for each shift
    split = rows.join(cut, "shift_code")
    early = F.col("timestamp_start") <= F.col("cut")
    return models.forest_classes(split.filter(early), split.filter(~early), "shift_code", numeric)


def reports(p: Plant) -> DataFrame:
    made = written(shift_classes(p).select("shift_code", "predicted", "majority"), "classes")
    parts = {"random_forest": "predicted", "majority": "majority"}
    a, b = (models.class_report(made, "shift_code", c).withColumn("model", F.lit(k)) for k, c in parts.items())
    return a.unionByName(b)


query("ml10_class_report", "model class support precision~ recall~ f1~ accuracy~ balanced_accuracy~ macro_f1~", None)(reports)

# Landing checks.
query("src5_prices", "geo_code period_code price_value~ source_code", "select *, 'PRICE' source_code from ref_price where left(period_code, 4) in ('1996', '1997')")(
    lambda p: landing.select_prices(p.ref_price, [f"SITE-{i}" for i in range(5)], [1996, 1997], source_code="PRICE")
)
query("src10_cast_columns", "record quantity good", "select source_record_id record, cast(planned_quantity as int) quantity, try_cast(product_code as double) good from fact_production")(
    lambda p: landing.cast_columns(p.fact_production, {"source_record_id": ("record", "string"), "planned_quantity": ("quantity", "int"), "product_code": ("good", "double"), "absent": ("absent", "int")})
)
query("src17_outer_merge", "site_id day units kwh~ air~", """select site_id, day, u.units, coalesce(u.kwh, e.kwh) kwh, air from (select site_id, cast(timestamp_start as date) as day, cast(sum(good_quantity) as bigint) units, case when sum(good_quantity) > 50000 then sum(electricity_kwh) end kwh from fact_production where line_id % 2 = 0 group by 1, 2) u
  full join (select site_id, cast(timestamp_start as date) as day, sum(line_total_electricity_kwh) kwh, sum(compressed_air_nm3) air from fact_line_energy_detail where line_id % 3 = 0 group by 1, 2) e using (site_id, day)""")(
    lambda p: landing.outer_merge(
        [
            p.fact_production.filter("line_id % 2 = 0").groupBy("site_id", F.to_date("timestamp_start").alias("day")).agg(F.sum("good_quantity").alias("units"), F.sum("electricity_kwh").alias("kwh")).withColumn("kwh", F.when(F.col("units") > 50000, F.col("kwh"))),
            p.fact_line_energy_detail.filter("line_id % 3 = 0").groupBy("site_id", F.to_date("timestamp_start").alias("day")).agg(F.sum("line_total_electricity_kwh").alias("kwh"), F.sum("compressed_air_nm3").alias("air")),
        ],
        ["site_id", "day"],
    )
)
query("src22_upsert", "equipment_id line_id equipment_code", "select equipment_id, line_id, case when line_id < 5 then 'NEW' else equipment_code end equipment_code from dim_equipment")(
    lambda p: silver.upsert(p.dim_equipment, p.dim_equipment.filter("line_id < 5").withColumn("equipment_code", F.lit("NEW")), ["equipment_id"])
)
query("src23_profile", "rows missing_cells repeated_rows first last least_step_s~ most_step_s~ median_step_s~", """select * from (select count(*) as rows, sum((event_id is null)::int + (event_timestamp is null)::int + (equipment_id is null)::int + (tp2 is null)::int + (tp3 is null)::int + (comp is null)::int) missing_cells, min(event_timestamp) as first, max(event_timestamp) as last from telemetry) a,
  (select coalesce(sum(n - 1), 0) repeated_rows from (select count(*) n from telemetry group by event_id, event_timestamp, equipment_id, tp2, tp3, comp) r) b, (select min(s) least_step_s, max(s) most_step_s, median(s) median_step_s from (select (epoch_us(t) - epoch_us(lag(t) over (order by t))) / 1e6 s from (select distinct event_timestamp t from telemetry where event_timestamp is not null) d) x) c""")(
    lambda p: silver.profile(p.telemetry, "event_timestamp")
)
query("src24_expectations", "check found ok", """select 'rows' as "check", count(*) found, count(*) >= 1 ok from fact_downtime union all select 'failure_category outside its domain', count(*) filter (failure_category not in ('CHANGEOVER', 'MECHANICAL', 'ELECTRICAL')), count(*) filter (failure_category not in ('CHANGEOVER', 'MECHANICAL', 'ELECTRICAL')) = 0 from fact_downtime
  union all select 'missing columns', 1, false""")(
    lambda p: landing.expect(p.fact_downtime, ["source_record_id", "duration_min", "not_there"], {"failure_category": ["CHANGEOVER", "MECHANICAL", "ELECTRICAL"]})
)


def energy_violations(p: Plant) -> DataFrame:
    line, site = landing.energy_rules()
    return landing.violations(p.fact_line_energy_detail, line, ["production_record_id"]).unionByName(landing.violations(p.fact_site_energy_detail, site, ["site_id", "date_id", "shift_code"]))


query("src26_energy_identities", "rule bad", """select 'parts make the total' as rule, count(*) filter (abs(line_production_electricity_kwh + line_idle_electricity_kwh - line_total_electricity_kwh) > 1e-6 * greatest(1, line_total_electricity_kwh)) bad from fact_line_energy_detail
  union all select 'no negative energy', count(*) filter (least(line_production_electricity_kwh, line_idle_electricity_kwh) < 0) from fact_line_energy_detail union all select 'keys are known', count(*) filter (site_id is null or line_id is null or date_id is null) from fact_line_energy_detail
  union all select 'repeated', count(*) - count(distinct production_record_id) from fact_line_energy_detail
  union all select 'lines and auxiliaries make the total', count(*) filter (abs(line_electricity_kwh + site_auxiliary_electricity_kwh - site_total_electricity_kwh) > 1e-6 * greatest(1, site_total_electricity_kwh)) from fact_site_energy_detail
  union all select 'power times hours', count(*) filter (abs((site_auxiliary_base_kw + site_weather_auxiliary_kw) * shift_hours - site_auxiliary_electricity_kwh) > 1e-6 * greatest(1, site_auxiliary_electricity_kwh)) from fact_site_energy_detail
  union all select 'units are positive', count(*) filter (production_units <= 0) from fact_site_energy_detail union all select 'repeated', count(*) - (select count(*) from (select distinct site_id, date_id, shift_code from fact_site_energy_detail)) from fact_site_energy_detail""")(energy_violations)  # fmt: skip
query("ld1_areas", "line_id site_id line_code area_type", "select line_id, site_id, line_code, 'PRODUCTION' area_type from dim_line")(
    lambda p: landing.areas(p.dim_line.join(p.dim_site.select("site_id", "site_code"), "site_id").drop("site_id"), p.dim_site)
)


def pdm_landing(p: Plant) -> DataFrame:
    """Acceptance of scored bins, failure windows and the policy table on their way into reports."""
    rows = landing.violations(m.alerts(p), {"time is known": F.col("bin").isNotNull(), "score is not negative": F.coalesce(F.col("robust_z"), F.lit(0.0)) >= 0, "start is an alert": F.col("alert") | ~F.col("start")}, ["equipment_id", "bin"])
    windows = landing.violations(p.failure_window, {"warning before the end": F.col("failure_start") < F.col("failure_end")}, ["failure_id"])
    return rows.withColumn("input", F.lit("bins")).unionByName(windows.withColumn("input", F.lit("windows")))


query("ld11_pdm_landing", "input rule bad", """select 'bins' input, 'time is known' as rule, count(*) filter (bin is null) bad from ep union all select 'bins', 'score is not negative', count(*) filter (z < 0) from ep union all select 'bins', 'start is an alert', count(*) filter (start and not alert) from ep
  union all select 'bins', 'repeated', count(*) - (select count(*) from (select distinct equipment_id, bin from ep)) from ep union all select 'windows', 'warning before the end', count(*) filter (failure_start >= failure_end) from failure_window union all select 'windows', 'repeated', count(*) - count(distinct failure_id) from failure_window""")(pdm_landing)  # fmt: skip


def bridge(p: Plant) -> DataFrame:
    """Acceptance of the forecast and anomaly tables: keys, grain, identities and states."""
    close = F.abs(F.col("error") - (F.col("lag_7") - F.col("units"))) <= 1e-6
    finite = F.col("units").isNotNull() & F.col("lag_7").isNotNull() & (F.abs("units") < float("inf")) & (F.abs("lag_7") < float("inf"))
    share = F.coalesce(F.abs(F.col("error_share") * F.col("units") - F.abs("error")) <= 1e-6 * F.col("units"), F.col("units") <= 0)
    one = landing.violations(reporting.forecast(p), {"site is known": F.col("site_code").isNotNull(), "finite": finite, "error is its difference": close, "share is its ratio": share}, ["site_id", "day"])
    two = landing.violations(reporting.energy_state(p), {"line is known": F.col("line_code").isNotNull(), "state is known": F.col("state").isin("HIGH", "LOW", "NORMAL")}, ["line_id", "date_id", "shift_code"])
    return one.withColumn("input", F.lit("forecast")).unionByName(two.withColumn("input", F.lit("anomaly")))


query("gt16_bridge", "input rule bad", f"""with f as (select x.*, s.site_code, lag_7 - units error from ({m._DAILY}) x left join dim_site s using (site_id) where lag_7 is not null), a as (select p.*, line_code from fact_production p left join (select line_id, line_code from dim_line) l using (line_id) where date_id >= 19970101)
  select 'forecast' input, 'site is known' as rule, count(*) filter (site_code is null) bad from f union all select 'forecast', 'finite', count(*) filter (not isfinite(units) or not isfinite(lag_7)) from f union all select 'forecast', 'error is its difference', count(*) filter (abs(error - (lag_7 - units)) > 1e-6) from f
  union all select 'forecast', 'share is its ratio', count(*) filter (units > 0 and abs(abs(error) / units * units - abs(error)) > 1e-6 * units) from f union all select 'forecast', 'repeated', count(*) - (select count(*) from (select distinct site_id, day from f)) from f
  union all select 'anomaly', 'line is known', count(*) filter (line_code is null) from a union all select 'anomaly', 'state is known', count(*) filter (electricity_kwh is null) from a union all select 'anomaly', 'repeated', count(*) - (select count(*) from (select distinct line_id, date_id, shift_code from a)) from a""")(bridge)  # fmt: skip


def site_money(p: Plant) -> DataFrame:
    """Energy and benchmark cost of each site, with their ratios to units."""
    by = m.cost(p).groupBy("site_id").agg(F.sum("site_total_electricity_kwh").alias("site_total_energy_kwh"), F.sum("cost_eur").alias("benchmark_cost_eur"), F.sum("production_units").alias("units"))
    return by.withColumns({"site_kwh_per_1000": ratio(F.col("site_total_energy_kwh") * 1000, "units"), "benchmark_cost_per_1000": ratio(F.col("benchmark_cost_eur") * 1000, "units")})


query("bi_site_energy_cost", "site_id site_total_energy_kwh~ site_kwh_per_1000~ benchmark_cost_eur~ benchmark_cost_per_1000~", "select *, site_total_energy_kwh * 1000 / units site_kwh_per_1000, benchmark_cost_eur * 1000 / units benchmark_cost_per_1000 from (select site_id, sum(site_total_electricity_kwh) site_total_energy_kwh, sum(cost_eur) benchmark_cost_eur, sum(production_units) units from cost group by 1) c")(site_money)
query("bi_dq_measures", "evaluated_rows failed_rows dq_score~ passed_rules failed_rules warning_rules", "select cast(sum(evaluated) as bigint) evaluated_rows, cast(sum(failed) as bigint) failed_rows, 1 - sum(failed) / sum(evaluated) dq_score, count(*) filter (status = 'PASS') passed_rules, count(*) filter (status = 'FAIL') failed_rules, count(*) filter (status = 'WARN') warning_rules from (" + gates._ALL + ") r")(
    lambda p: checks.domain_summary(gates.all_rules(p)).agg(F.sum("evaluated").alias("evaluated_rows"), F.sum("failed").alias("failed_rows"), (1 - F.sum("failed") / F.sum("evaluated")).alias("dq_score"), F.sum("pass").alias("passed_rules"), F.sum("fail").alias("failed_rules"), F.sum("warn").alias("warning_rules"))
)
