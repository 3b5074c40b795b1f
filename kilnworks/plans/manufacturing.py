"""Manufacturing queries: each a plan over the projected tables and, separately written, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.functions.measures import measures
from kilnworks.operators import checks, control, energy, production, telemetry
from kilnworks.sources.fixtures import Plant, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASELINE, MONITORING = 1996, 1997

#: Views of the SQL side, in the order in which they build on each other.
VIEWS = """
kpi0 as (select *, case when planned_production_time_min > 0 then operating_time_min / planned_production_time_min end availability,
  case when operating_time_min > 0 and nominal_rate > 0 then actual_quantity / (operating_time_min / 60 * nominal_rate) end performance,
  case when actual_quantity > 0 then good_quantity / actual_quantity end quality, case when planned_quantity > 0 then actual_quantity / planned_quantity end production_attainment,
  case when planned_quantity > 0 then good_quantity / planned_quantity end good_output_attainment, case when planned_production_time_min > 0 then actual_quantity / (planned_production_time_min / 60) end scheduled_throughput_per_hour,
  case when operating_time_min > 0 then actual_quantity / (operating_time_min / 60) end running_throughput_per_hour, case when actual_quantity > 0 then reject_quantity / actual_quantity end reject_rate from fact_production),
kpi as (select *, availability * performance * quality oee from kpi0),
dt as (select production_record_id, sum(duration_min) filter (planned_flag) p, sum(duration_min) filter (not planned_flag) u, sum(duration_min) filter (planned_flag and failure_category = 'CHANGEOVER') c from fact_downtime group by 1),
loss as (select k.*, coalesce(p, 0) planned_downtime_min, coalesce(u, 0) unplanned_downtime_min, coalesce(c, 0) changeover_downtime_min, coalesce(p, 0) * nominal_rate / 60 planned_downtime_loss_units,
  coalesce(u, 0) * nominal_rate / 60 unplanned_downtime_loss_units, coalesce(c, 0) * nominal_rate / 60 changeover_loss_units, greatest(operating_time_min * nominal_rate / 60 - actual_quantity, 0) speed_loss_units,
  cast(reject_quantity as double) quality_loss_units, cast(greatest(planned_quantity - good_quantity, 0) as double) total_good_output_gap_units from kpi k left join dt on dt.production_record_id = k.source_record_id),
acc0 as (select *, planned_production_time_min * nominal_rate / 60 theoretical_capacity_units, operating_time_min * nominal_rate / 60 operating_capacity_units from loss),
acc1 as (select *, greatest(theoretical_capacity_units - operating_capacity_units, 0) availability_loss_units, greatest(operating_capacity_units - actual_quantity, 0) performance_loss_units,
  cast(greatest(planned_quantity - good_quantity, 0) as double) plan_shortfall_units from acc0),
acc as (select a.*, availability_loss_units + performance_loss_units + quality_loss_units total_technical_loss_units, greatest(theoretical_capacity_units - good_quantity, 0) technical_capacity_gap_units,
  case when theoretical_capacity_units > 0 then good_quantity / theoretical_capacity_units end technical_output_efficiency, cast(v.eur_per_unit as double) eur,
  (availability_loss_units + performance_loss_units + quality_loss_units) * cast(v.eur_per_unit as double) total_technical_eur, plan_shortfall_units * cast(v.eur_per_unit as double) plan_shortfall_eur from acc1 a left join cfg_product_loss_value v using (product_code)),
ev as (select d.source_record_id downtime_event_id, d.production_record_id, d.site_id, d.line_id, d.equipment_id, d.failure_category, d.failure_reason, d.event_start, d.duration_min / 60 downtime_hours, m.* exclude (downtime_event_id)
  from fact_downtime d join (select downtime_event_id, count(*) work_order_count, min(start_timestamp) first_repair, sum(duration_hours) repair_hours, sum(total_cost) repair_cost from fact_maintenance where not planned_flag group by 1) m
  on m.downtime_event_id = d.source_record_id where not d.planned_flag),
gaps as (select *, epoch(event_start - lag(event_start) over (partition by equipment_id order by event_start, downtime_event_id)) / 3600 gap from ev),
eq as (select e.*, s.* exclude (equipment_id), x.line_hours from dim_equipment e left join (select equipment_id, count(*) failure_count, sum(work_order_count) work_order_count, sum(downtime_hours) downtime_hours, avg(repair_hours) mttr_hours,
  quantile_cont(repair_hours, 0.5) median_repair_hours, avg(gap) mean_gap_hours, quantile_cont(gap, 0.5) median_gap_hours from gaps group by 1) s using (equipment_id) left join (select line_id, sum(operating_time_min) / 60 line_hours from fact_production group by 1) x using (line_id)),
spc0 as (select *, actual_quantity u, reject_quantity / actual_quantity p, date_id // 10000 yr from fact_production where actual_quantity > 0 and date_id // 10000 in (1996, 1997)),
spcb as (select site_id, line_id, product_code, count(*) n, sum(reject_quantity) / sum(u) c from spc0 where yr = 1996 group by 1, 2, 3),
spcs as (select s.*, b.n baseline_count, b.c, case when c > 0 and c < 1 then sqrt(c * (1 - c) / u) end sp from spc0 s left join spcb b using (site_id, line_id, product_code)),
spcz as (select site_id, line_id, product_code, avg(mr) / 1.128 sz from (select site_id, line_id, product_code, abs(z - lag(z) over (partition by site_id, line_id, product_code order by timestamp_start, source_record_id)) mr
  from (select *, (p - c) / sp z from spcs where yr = 1996 and sp is not null)) group by 1, 2, 3),
spc1 as (select s.*, sz, case when sz * sp is not null then greatest(0, c - 3 * sz * sp) end lower_limit, case when sz * sp is not null then least(1, c + 3 * sz * sp) end upper_limit from spcs s left join spcz using (site_id, line_id, product_code)),
spc as (select *, case when upper_limit is null then 'NO_BASELINE' when p > upper_limit then 'ABOVE_UCL' when p < lower_limit then 'BELOW_LCL' else 'IN_CONTROL' end status from spc1),
cost as (select d.*, r.price_value, site_total_electricity_kwh * r.price_value cost_eur from fact_site_energy_detail d join dim_site s using (site_id) left join ref_price r on r.geo_code = s.site_code
  and r.period_code = concat(cast(year(timestamp_start) as varchar), case when month(timestamp_start) <= 6 then '-S1' else '-S2' end)),
clean as (select * from telemetry where event_timestamp is not null qualify row_number() over (partition by equipment_id, event_timestamp order by event_id) = 1),
sig as (select *, abs(tp2 - lag(tp2) over w) mv, coalesce(comp <> lag(comp) over w, true) tr, date_trunc('hour', event_timestamp) bin from clean window w as (partition by equipment_id order by event_timestamp)),
hb as (select equipment_id, bin, count(*) n, avg(tp2) m, stddev_pop(tp2) sd, min(tp2) lo, max(tp2) hi, arg_max(tp2, event_timestamp) la, arg_min(tp2, event_timestamp) fi, avg(mv) mv, avg(comp) ac, sum(cast(tr as int)) trs from sig group by 1, 2),
grid as (select equipment_id, unnest(generate_series(min(bin), max(bin), interval 1 hour)) bin from hb group by 1),
bins as (select g.equipment_id, g.bin, coalesce(n, 0) n, m, sd, lo, hi, la, fi, mv, ac, trs from grid g left join hb using (equipment_id, bin)),
ctx as (select *, case when count(m) over f >= 6 then avg(m) over f end cm, case when count(m) over f >= 6 then stddev_pop(m) over f end cs, m - lag(m, 12) over (partition by equipment_id order by bin) slope
  from bins window f as (partition by equipment_id order by bin rows between 11 preceding and current row)),
rob as (select x.*, greatest(abs(m - qm[2]) / nullif(qm[3] - qm[1], 0), abs(ac - qa[2]) / nullif(qa[3] - qa[1], 0), abs(mv - qv[2]) / nullif(qv[3] - qv[1], 0)) z from (select * from bins where n > 0) x,
  (select quantile_cont(m, [0.25, 0.5, 0.75]) qm, quantile_cont(ac, [0.25, 0.5, 0.75]) qa, quantile_cont(mv, [0.25, 0.5, 0.75]) qv from bins where n > 0 and bin < timestamp '2024-01-08') q),
al as (select *, coalesce(z >= 1.2, false) hot from rob),
kn as (select *, sum(cast(hot as int)) over f >= 2 and count(*) over f = 3 alert from al window f as (partition by equipment_id order by bin rows between 2 preceding and current row)),
ep as (select *, alert and not coalesce(lag(alert) over (partition by equipment_id order by bin), false) start from kn)
"""


def _sql(select: str) -> str:
    return f"{ctes()},{VIEWS}{select}"


def _tidy(name: str) -> str:
    return f'case when abs({name}) < 1000 then round({name} + 1e-9, 6) else round({name} + 1e-7, 4) end as "{name}"'


def query(name: str, columns: str, sql: str | None) -> Callable:
    """Registers a plan under a name. Of the columns, those marked ~ are doubles and rounded on both sides.

    Engines round exact halves differently; the small number added before rounding keeps values off them.
    """
    names = columns.split()
    plain = [c.rstrip("~") for c in names]

    def wrap(f: Callable[[Plant], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Plant(spark, sf_dir))
            tidy = lambda c: F.when(F.abs(c) < 1000, F.round(F.col(c) + 1e-9, 6)).otherwise(F.round(F.col(c) + 1e-7, 4)).alias(c)
            return df.select(*[tidy(c[:-1]) if c.endswith("~") else F.col(c) for c in names])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = _sql(f" select {', '.join(_tidy(c) if n.endswith('~') else f'"{c}"' for c, n in zip(plain, names, strict=True))} from ({sql}) q")
        return f

    return wrap


def _bigs(names: str) -> str:
    return ", ".join(f"cast(sum({c}) as bigint) {c}" for c in names.split())


def kpi(p: Plant) -> DataFrame:
    return production.shift_production_kpi(p.fact_production)


def loss(p: Plant) -> DataFrame:
    return production.shift_production_loss(kpi(p), p.fact_downtime)


def accounting(p: Plant) -> DataFrame:
    return production.shift_loss_accounting(loss(p), p.cfg_product_loss_value)


SHIFT = "source_record_id site_id line_id"
KPI = "availability~ performance~ quality~ production_attainment~ good_output_attainment~ scheduled_throughput_per_hour~ running_throughput_per_hour~ reject_rate~ oee~"
query("v_oee1_shift_production_kpi", f"{SHIFT} product_code shift_code {KPI}", "select * from kpi")(kpi)
LOSS = "planned_downtime_min~ unplanned_downtime_min~ changeover_downtime_min~ planned_downtime_loss_units~ unplanned_downtime_loss_units~ changeover_loss_units~ speed_loss_units~ quality_loss_units~ total_good_output_gap_units~"
query("v_oee2_shift_production_loss", f"{SHIFT} {LOSS}", "select * from loss")(loss)

ROLL = "shift_count planned_quantity actual_quantity good_quantity reject_quantity availability~ performance~ quality~ production_attainment~ reject_rate~ oee~ gross_capacity_utilization~ running_throughput_per_hour~"


def _roll_sql(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    inner = f"""select {by}count(*) shift_count, {_bigs('planned_quantity actual_quantity good_quantity reject_quantity')}, sum(operating_time_min) / sum(planned_production_time_min) availability,
  sum(actual_quantity) / sum(operating_time_min / 60 * nominal_rate) performance, sum(good_quantity) / sum(actual_quantity) quality, sum(actual_quantity) / sum(planned_quantity) production_attainment, sum(reject_quantity) / sum(actual_quantity) reject_rate,
  sum(actual_quantity) / sum(planned_production_time_min / 60 * nominal_rate) gross_capacity_utilization, sum(actual_quantity) / (sum(operating_time_min) / 60) running_throughput_per_hour from kpi {f'group by {keys}' if keys else ''}"""
    return f"select *, availability * performance * quality oee from ({inner}) r"


for _name, _keys in {"v_oee3_line_daily_kpi": "date_id site_id line_id", "v_oee4_site_daily_kpi": "date_id site_id", "v_ben1_line_performance_summary": "site_id line_id"}.items():
    query(_name, f"{_keys} {ROLL}", _roll_sql(_keys.replace(" ", ", ")))(lambda p, k=_keys: production.kpi_rollup(kpi(p), k.split()))

ACC = "theoretical_capacity_units~ availability_loss_units~ performance_loss_units~ quality_loss_units~ plan_shortfall_units~ total_technical_loss_units~ technical_capacity_gap_units~ technical_output_efficiency~ total_technical_eur~"
query("v_loss1_shift_loss_accounting", f"{SHIFT} {ACC} plan_shortfall_eur~", "select * from acc")(accounting)
for _name, _keys in {"v_loss2_line_daily_loss": "date_id site_id line_id", "v_loss3_site_daily_loss": "date_id site_id", "v_loss4_site_loss_summary": "site_id"}.items():
    _sums = ", ".join(f"sum({c}) {c}" for c in production.LOSSES)
    query(_name, f"{_keys} good_quantity {ACC}", f"select {_keys.replace(' ', ', ')}, {_bigs('good_quantity')}, {_sums}, sum(good_quantity) / sum(theoretical_capacity_units) technical_output_efficiency from acc group by {_keys.replace(' ', ', ')}")(
        lambda p, k=_keys: production.loss_rollup(accounting(p), k.split())
    )


def lines(p: Plant) -> DataFrame:
    return production.kpi_rollup(kpi(p), ["site_id", "line_id"])


_LINES = _roll_sql("site_id, line_id")
query("v_ben2_line_performance_rank", "site_id line_id oee~ oee_rank site_rank", f"select *, cast(dense_rank() over (order by oee desc nulls first) as int) oee_rank, cast(dense_rank() over (partition by site_id order by oee desc nulls first) as int) site_rank from ({_LINES}) l")(
    lambda p: production.ranked(lines(p), {"oee_rank": ("oee", True, []), "site_rank": ("oee", True, ["site_id"])})
)
query(
    "v_ben3_downtime_pareto",
    "site_id failure_category failure_reason planned_flag event_count downtime_min~ total~ cumulative~ share~ cumulative_share~ pareto_rank",
    """select *, downtime_min / total share, cumulative / total cumulative_share from (select *, sum(downtime_min) over (partition by site_id) total, sum(downtime_min) over w cumulative, cast(row_number() over w as int) pareto_rank
  from (select site_id, failure_category, failure_reason, planned_flag, count(*) event_count, sum(duration_min) downtime_min from fact_downtime group by 1, 2, 3, 4) d
  window w as (partition by site_id order by downtime_min desc nulls last, failure_category, failure_reason, planned_flag rows unbounded preceding)) r""",
)(lambda p: production.pareto(production.downtime_by_reason(p.fact_downtime), ["site_id"], "downtime_min", ["failure_category", "failure_reason", "planned_flag"]))
query(
    "v_ben4_changeover_summary",
    "site_id line_id changeover_count total_min~ mean_min~ median_min~ least_min~ most_min~ changeover_rank site_rank",
    """select *, cast(dense_rank() over (order by mean_min nulls last) as int) changeover_rank, cast(dense_rank() over (partition by site_id order by mean_min nulls last) as int) site_rank
  from (select site_id, line_id, count(*) changeover_count, sum(duration_min) total_min, avg(duration_min) mean_min, quantile_cont(duration_min, 0.5) median_min,
  min(duration_min) least_min, max(duration_min) most_min from fact_downtime where planned_flag and failure_category = 'CHANGEOVER' group by 1, 2) c""",
)(lambda p: production.ranked(production.changeover_summary(p.fact_downtime), {"changeover_rank": ("mean_min", False, []), "site_rank": ("mean_min", False, ["site_id"])}))
BENCH = "line_count mean_line_oee~ least_line_oee~ most_line_oee~ mean_line_attainment~ mean_line_good_attainment~ mean_line_utilization~ planned_quantity actual_quantity good_quantity reject_quantity"
_BENCH = f"""select site_id, count(*) line_count, avg(oee) mean_line_oee, min(oee) least_line_oee, max(oee) most_line_oee, avg(production_attainment) mean_line_attainment,
  avg(good_quantity / planned_quantity) mean_line_good_attainment, avg(gross_capacity_utilization) mean_line_utilization, {_bigs("planned_quantity actual_quantity good_quantity reject_quantity")} from ({_LINES}) l group by 1"""
query("v_ben5_site_benchmark", f"site_id {BENCH}", _BENCH)(lambda p: production.site_benchmark(lines(p)))
query(
    "v_ben6_site_rank",
    "site_id mean_line_oee~ mean_line_attainment~ mean_line_utilization~ oee_rank attainment_rank utilization_rank",
    f"""select *, cast(dense_rank() over (order by mean_line_oee desc nulls first) as int) oee_rank, cast(dense_rank() over (order by mean_line_attainment desc nulls first) as int) attainment_rank,
  cast(dense_rank() over (order by mean_line_utilization desc nulls first) as int) utilization_rank from ({_BENCH}) s""",
)(
    lambda p: production.ranked(
        production.site_benchmark(lines(p)),
        {"oee_rank": ("mean_line_oee", True, []), "attainment_rank": ("mean_line_attainment", True, []), "utilization_rank": ("mean_line_utilization", True, [])},
    )
)

ENERGY = "average_demand_kw~ kwh_per_1000~ kwh_per_1000_good~ kwh_per_operating_hour~"
query(
    "v_en1_shift_energy_kpi",
    f"{SHIFT} electricity_kwh~ {ENERGY}",
    """select *, electricity_kwh / (planned_production_time_min / 60) average_demand_kw, case when actual_quantity > 0 then electricity_kwh * 1000 / actual_quantity end kwh_per_1000, case when good_quantity > 0 then electricity_kwh * 1000 / good_quantity end kwh_per_1000_good,
  electricity_kwh / (operating_time_min / 60) kwh_per_operating_hour from fact_production""",
)(lambda p: energy.shift_energy_kpi(p.fact_production))


def _energy_sql(keys: str) -> str:
    return f"""select {keys}, sum(electricity_kwh) electricity_kwh, avg(electricity_kwh / (planned_production_time_min / 60)) average_demand_kw, sum(electricity_kwh) * 1000 / sum(actual_quantity) kwh_per_1000, sum(electricity_kwh) * 1000 / sum(good_quantity) kwh_per_1000_good,
  sum(electricity_kwh) / (sum(operating_time_min) / 60) kwh_per_operating_hour from fact_production group by {keys}"""


for _name, _keys in {"v_en2_line_daily_energy": "date_id site_id line_id", "v_en3_site_daily_energy": "date_id site_id", "v_en4_line_energy_summary": "site_id line_id", "v_en6_site_energy_summary": "site_id"}.items():
    query(_name, f"{_keys} electricity_kwh~ {ENERGY}", _energy_sql(_keys.replace(" ", ", ")))(lambda p, k=_keys: energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), k.split()))
query(
    "v_en5_line_energy_rank",
    "site_id line_id kwh_per_1000~ intensity_rank site_rank",
    f"select *, cast(dense_rank() over (order by kwh_per_1000 nulls last) as int) intensity_rank, cast(dense_rank() over (partition by site_id order by kwh_per_1000 nulls last) as int) site_rank from ({_energy_sql('site_id, line_id')}) l",
)(lambda p: production.ranked(energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), ["site_id", "line_id"]), {"intensity_rank": ("kwh_per_1000", False, []), "site_rank": ("kwh_per_1000", False, ["site_id"])}))
query("v_en7_site_energy_rank", "site_id kwh_per_1000~ intensity_rank", f"select *, cast(dense_rank() over (order by kwh_per_1000 nulls last) as int) intensity_rank from ({_energy_sql('site_id')}) l")(
    lambda p: production.ranked(energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), ["site_id"]), {"intensity_rank": ("kwh_per_1000", False, [])})
)
query("v_ut1_shift_energy_detail", "production_record_id idle_share~ idle_kwh_per_1000~", "select *, line_idle_electricity_kwh / line_total_electricity_kwh idle_share, case when actual_quantity > 0 then line_idle_electricity_kwh * 1000 / actual_quantity end idle_kwh_per_1000 from fact_line_energy_detail")(
    lambda p: energy.shift_energy_detail_kpi(p.fact_line_energy_detail)
)
query(
    "v_ut2_site_auxiliary_kpi",
    "site_id shift_code date_id auxiliary_share~ weather_share~ auxiliary_kwh_per_1000~ total_kwh_per_1000~",
    """select *, site_auxiliary_electricity_kwh / site_total_electricity_kwh auxiliary_share, site_weather_auxiliary_kw * shift_hours / site_auxiliary_electricity_kwh weather_share, site_auxiliary_electricity_kwh * 1000 / production_units auxiliary_kwh_per_1000,
  site_total_electricity_kwh * 1000 / production_units total_kwh_per_1000 from fact_site_energy_detail""",
)(lambda p: energy.site_auxiliary_kpi(p.fact_site_energy_detail))
query(
    "v_ut3_line_idle_summary",
    "site_id line_id production_kwh~ idle_kwh~ total_kwh~ idle_share~ idle_kwh_per_1000~",
    "select site_id, line_id, sum(line_production_electricity_kwh) production_kwh, sum(line_idle_electricity_kwh) idle_kwh, sum(line_total_electricity_kwh) total_kwh, sum(line_idle_electricity_kwh) / sum(line_total_electricity_kwh) idle_share, sum(line_idle_electricity_kwh) * 1000 / sum(actual_quantity) idle_kwh_per_1000 from fact_line_energy_detail group by 1, 2",
)(lambda p: energy.idle_energy_summary(p.fact_line_energy_detail))
query(
    "v_ut4_compressed_air",
    "site_id line_id shift_count modelled_shift_count air_nm3~ modelled_units nm3_per_1000~",
    "select site_id, line_id, count(*) shift_count, count(compressed_air_nm3) modelled_shift_count, sum(compressed_air_nm3) air_nm3, cast(sum(actual_quantity) filter (compressed_air_nm3 is not null) as bigint) modelled_units, sum(compressed_air_nm3) * 1000 / sum(actual_quantity) filter (compressed_air_nm3 is not null) nm3_per_1000 from fact_line_energy_detail group by 1, 2",
)(lambda p: energy.compressed_air_summary(p.fact_line_energy_detail))
query(
    "v_ut5_site_auxiliary_summary",
    "site_id line_electricity_kwh~ site_auxiliary_electricity_kwh~ site_total_electricity_kwh~ auxiliary_share~ total_kwh_per_1000~ mean_air_temperature_c~ mean_weather_kw~ intensity_rank share_rank",
    """select *, cast(dense_rank() over (order by total_kwh_per_1000 nulls last) as int) intensity_rank, cast(dense_rank() over (order by auxiliary_share nulls last) as int) share_rank from (select site_id, sum(line_electricity_kwh) line_electricity_kwh, sum(site_auxiliary_electricity_kwh) site_auxiliary_electricity_kwh, sum(site_total_electricity_kwh) site_total_electricity_kwh,
  sum(site_auxiliary_electricity_kwh) / sum(site_total_electricity_kwh) auxiliary_share, sum(site_total_electricity_kwh) * 1000 / sum(production_units) total_kwh_per_1000, avg(mean_air_temperature_c) mean_air_temperature_c, avg(site_weather_auxiliary_kw) mean_weather_kw from fact_site_energy_detail group by 1) s""",
)(lambda p: production.ranked(energy.site_auxiliary_summary(p.fact_site_energy_detail), {"intensity_rank": ("total_kwh_per_1000", False, []), "share_rank": ("auxiliary_share", False, [])}))


def cost(p: Plant) -> DataFrame:
    return energy.electricity_cost(p.fact_site_energy_detail, p.dim_site, p.ref_price)


query("v_co1_site_shift_cost", "site_id shift_code date_id price_value~ cost_eur~ cost_eur_per_1000~", "select *, cost_eur * 1000 / production_units cost_eur_per_1000 from cost")(cost)
query(
    "v_co2_site_cost_summary",
    "site_id kwh~ cost_eur~ units eur_per_kwh~ cost_eur_per_1000~ cost_rank price_rank",
    """select *, cast(dense_rank() over (order by cost_eur_per_1000 nulls last) as int) cost_rank, cast(dense_rank() over (order by eur_per_kwh nulls last) as int) price_rank from (select site_id, sum(site_total_electricity_kwh) kwh, sum(cost_eur) cost_eur, cast(sum(production_units) as bigint) units,
  sum(cost_eur) / sum(site_total_electricity_kwh) eur_per_kwh, sum(cost_eur) * 1000 / sum(production_units) cost_eur_per_1000 from cost group by 1) c""",
)(lambda p: production.ranked(energy.electricity_cost_summary(cost(p)), {"cost_rank": ("cost_eur_per_1000", False, []), "price_rank": ("eur_per_kwh", False, [])}))
query("v_co5_consumption_band", "site_id year mwh~ in_band", "select *, mwh >= 2000 and mwh < 20000 in_band from (select site_id, cast(year(timestamp_start) as int) as year, sum(site_total_electricity_kwh) / 1000 mwh from cost group by 1, 2) c")(lambda p: energy.consumption_band(cost(p)))


def chart(p: Plant) -> DataFrame:
    year = F.floor(F.col("date_id") / 10000)
    rows = p.fact_production.filter(year.isin(BASELINE, MONITORING))
    made = control.laney_pprime(rows, ["site_id", "line_id", "product_code"], "actual_quantity", "reject_quantity", ["timestamp_start", "source_record_id"], year == BASELINE)
    return made.withColumnsRenamed({"lower": "lower_limit", "upper": "upper_limit"})


query("v_spc1_laney_pprime", "source_record_id baseline_count centre~ sigma_z~ lower_limit~ upper_limit~ status", "select *, c centre, sz sigma_z from spc")(chart)
query(
    "v_spc2_phase_distribution",
    "phase status n share~",
    "select *, n / sum(n) over (partition by phase) share from (select case when yr = 1996 then 'BASELINE' else 'MONITORING' end phase, status, count(*) n from spc group by 1, 2) d",
)(lambda p: control.phase_distribution(chart(p)))


def events(p: Plant) -> DataFrame:
    return control.failure_event(p.fact_maintenance, p.fact_downtime)


def reliability(p: Plant) -> DataFrame:
    return control.equipment_reliability(events(p), p.fact_production, p.dim_equipment)


query("v_rel2_failure_event", "downtime_event_id equipment_id failure_reason downtime_hours~ work_order_count first_repair repair_hours~ repair_cost~", "select * from ev")(events)
query(
    "v_rel3_equipment_reliability",
    "equipment_id equipment_type failure_count work_order_count downtime_hours~ mttr_hours~ median_repair_hours~ mean_gap_hours~ median_gap_hours~ line_hours~ mtbf_hours~ failures_per_1000_hours~ availability_proxy~",
    "select * replace (cast(work_order_count as bigint) as work_order_count), line_hours / failure_count mtbf_hours, failure_count * 1000 / line_hours failures_per_1000_hours, (line_hours / failure_count) / (line_hours / failure_count + mttr_hours) availability_proxy from eq",
)(reliability)
query(
    "v_rel4_equipment_type_summary",
    "site_id equipment_type equipment_count failed_count failure_count work_order_count downtime_hours~ mean_mttr_hours~ mean_gap_hours~ mean_mtbf_hours~ mean_failures_per_1000_hours~ mean_availability~",
    """select l.site_id, equipment_type, count(*) equipment_count, count(*) filter (failure_count > 0) failed_count, cast(sum(failure_count) as bigint) failure_count, cast(sum(work_order_count) as bigint) work_order_count,
  sum(downtime_hours) downtime_hours, avg(mttr_hours) filter (failure_count > 0) mean_mttr_hours, avg(mean_gap_hours) filter (failure_count > 1) mean_gap_hours, avg(line_hours / failure_count) mean_mtbf_hours,
  avg(failure_count * 1000 / line_hours) mean_failures_per_1000_hours, avg((line_hours / failure_count) / (line_hours / failure_count + mttr_hours)) mean_availability
  from eq join dim_line l using (line_id) group by 1, 2""",
)(lambda p: control.equipment_type_summary(reliability(p).join(p.dim_line.select("line_id", "site_id"), "line_id")))
query(
    "v_rel5_failure_pareto",
    "site_id failure_reason event_count unplanned_count linked_count total_hours~ downtime_hours~ linked_hours~ mean_unplanned_min~ share~ cumulative_share~ pareto_rank",
    """select *, downtime_hours / total share, cumulative / total cumulative_share from (select *, sum(downtime_hours) over (partition by site_id) total, sum(downtime_hours) over w cumulative, cast(row_number() over w as int) pareto_rank
  from (select d.site_id, d.failure_reason, count(*) event_count, count(*) filter (not planned_flag) unplanned_count, count(e.id) linked_count, sum(duration_min / 60) total_hours,
    sum(duration_min / 60) filter (not planned_flag) downtime_hours, sum(duration_min / 60) filter (e.id is not null) linked_hours, avg(duration_min) filter (not planned_flag) mean_unplanned_min
    from fact_downtime d left join (select distinct downtime_event_id id from ev) e on e.id = d.source_record_id group by 1, 2) x
  window w as (partition by site_id order by downtime_hours desc nulls last, failure_reason rows unbounded preceding)) r""",
)(lambda p: production.pareto(control.failure_downtime(p.fact_downtime, events(p)), ["site_id"], "downtime_hours", ["failure_reason"]))
query(
    "v_rel6_failure_burden",
    "equipment_id failure_count downtime_hours~ hours_per_failure~ burden_rank frequency_rank",
    """select *, downtime_hours / failure_count hours_per_failure, cast(dense_rank() over (order by round(downtime_hours, 6) desc nulls last) as int) burden_rank, cast(dense_rank() over (order by failure_count desc nulls last) as int) frequency_rank
  from eq where failure_count > 0""",
)(lambda p: control.failure_burden(reliability(p)))
for _name, _by in {"v_rel7_monthly_reliability": "line_id", "v_rel7_monthly_site_reliability": "site_id"}.items():
    query(
        _name,
        f"month {_by} hours~ failures equipment downtime_hours~ failures_per_1000_hours~ mtbf_hours~ downtime_share~",
        f"""select x.* replace (cast(x.month as varchar) as month), coalesce(failures, 0) failures, coalesce(equipment, 0) equipment, coalesce(downtime_hours, 0) downtime_hours, coalesce(failures, 0) * 1000 / hours failures_per_1000_hours, case when failures > 0 then hours / failures end mtbf_hours, coalesce(downtime_hours, 0) / hours downtime_share
  from (select cast(date_trunc('month', timestamp_start) as date) as month, {_by}, sum(operating_time_min) / 60 as hours from fact_production group by 1, 2) x
  left join (select cast(date_trunc('month', p.timestamp_start) as date) as month, ev.{_by}, count(*) failures, count(distinct ev.equipment_id) equipment, sum(downtime_hours) as downtime_hours from ev join fact_production p on p.source_record_id = ev.production_record_id group by 1, 2) f using (month, {_by})""",
    )(lambda p, b=_by: control.monthly_reliability(events(p).drop(*({"line_id", "site_id"} - {b})), p.fact_production, b).withColumn("month", F.col("month").cast("string")))


def gold(p: Plant) -> DataFrame:
    e = energy.shift_energy_kpi(p.fact_production).select("source_record_id", "electricity_kwh", "kwh_per_1000")
    d = energy.shift_energy_detail_kpi(p.fact_line_energy_detail).select(F.col("production_record_id").alias("source_record_id"), "idle_share", "compressed_air_nm3")
    return accounting(p).drop("electricity_kwh").join(e, "source_record_id", "left").join(d, "source_record_id", "left")


query(
    "v_go1_shift_gold",
    f"{SHIFT} oee~ total_technical_loss_units~ total_technical_eur~ electricity_kwh~ kwh_per_1000~ idle_share~ compressed_air_nm3~",
    """select a.*, case when a.actual_quantity > 0 then a.electricity_kwh * 1000 / a.actual_quantity end kwh_per_1000, d.line_idle_electricity_kwh / d.line_total_electricity_kwh idle_share, d.compressed_air_nm3 from acc a left join fact_line_energy_detail d on d.production_record_id = a.source_record_id""",
)(gold)
query(
    "v_go4_site_summary",
    "site_id oee~ total_technical_eur~ kwh_per_1000~ cost_eur~",
    f"""select o.site_id, o.oee, l.e total_technical_eur, n.kwh_per_1000, c.cost_eur from ({_roll_sql('site_id')}) o left join (select site_id, sum(total_technical_eur) e from acc group by 1) l using (site_id) left join ({_energy_sql('site_id')}) n using (site_id)
  left join (select site_id, sum(cost_eur) cost_eur from cost group by 1) c using (site_id)""",
)(
    lambda p: production.kpi_rollup(kpi(p), ["site_id"])
    .select("site_id", "oee")
    .join(production.loss_rollup(accounting(p), ["site_id"]).select("site_id", "total_technical_eur"), "site_id", "left")
    .join(energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), ["site_id"]).select("site_id", "kwh_per_1000"), "site_id", "left")
    .join(energy.electricity_cost_summary(cost(p)).select("site_id", "cost_eur"), "site_id", "left")
)
query("biz1_technical_opportunity", "site_id opportunity_eur", "select site_id, cast(round(sum(cast(total_technical_loss_units as decimal(20, 6)) * cast(eur as decimal(12, 4))), 2) as decimal(20, 2)) opportunity_eur from acc group by 1")(lambda p: production.technical_opportunity(accounting(p)))
query(
    "biz2_sensitivity",
    "rate~ saving_eur~",
    "select rate, b * rate saving_eur from (select cast(sum(o) as double) / 2 b from (select cast(round(sum(cast(total_technical_loss_units as decimal(20, 6)) * cast(eur as decimal(12, 4))), 2) as decimal(20, 2)) o from acc group by site_id) s) t, (select unnest([0.005, 0.01, 0.02, 0.05]) rate) r",
)(lambda p: production.sensitivity(production.technical_opportunity(accounting(p)), [0.005, 0.01, 0.02, 0.05]))
query(
    "bi_measures_by_line",
    "site_id line_id planned_units actual_units attainment~ yield_rate~ reject_rate~ availability~ performance~ electricity_kwh~ kwh_per_1000~",
    f"""select site_id, line_id, cast(sum(planned_quantity) as bigint) planned_units, cast(sum(actual_quantity) as bigint) actual_units, sum(actual_quantity) / sum(planned_quantity) attainment, sum(good_quantity) / sum(actual_quantity) yield_rate, sum(reject_quantity) / sum(actual_quantity) reject_rate,
  sum(operating_time_min) / sum(planned_production_time_min) availability, sum(actual_quantity) / sum(operating_time_min / 60 * nominal_rate) performance, sum(electricity_kwh) electricity_kwh, sum(electricity_kwh) * 1000 / sum(actual_quantity) kwh_per_1000 from fact_production group by 1, 2""",
)(lambda p: p.fact_production.groupBy("site_id", "line_id").agg(*[m.alias(k) for k, m in measures().items()]))


def rules(p: Plant) -> DataFrame:
    p = p.kept()
    prod, down = p.fact_production, p.fact_downtime
    null = lambda *c: F.greatest(*[F.col(x).isNull() for x in c])
    return checks.results(
        [
            checks.run_row_rules(
                prod,
                [
                    checks.RowRule("PROD_REQUIRED_NULLS", null("source_record_id", "timestamp_start", "line_id")),
                    checks.RowRule("PROD_QTY_RECON", F.col("actual_quantity") != F.col("good_quantity") + F.col("reject_quantity")),
                    checks.RowRule("PROD_TIME_VALID", F.col("operating_time_min") > F.col("planned_production_time_min")),
                    checks.RowRule("ENERGY_POSITIVE", F.col("electricity_kwh") <= 0),
                ],
            ),
            checks.key_rules(
                prod,
                "source_record_id",
                ["PROD_DUP_SOURCE"],
                {"DT_LINEAGE": (down, "production_record_id"), "QUALITY_LINEAGE": (p.fact_quality, "production_record_id")},
                {"DT_DUP_PARENT": "DT_LINEAGE"},
            ),
            checks.extra_rows(p.telemetry, "TELEMETRY_UNIQUE", ["equipment_id", "event_timestamp"]),
        ],
        warn={"ENERGY_POSITIVE"},
    )


_RULES = """select rule_code, cast(evaluated as bigint) evaluated, cast(failed as bigint) failed, case when evaluated > 0 then failed / evaluated else 0 end failure_rate, case when failed = 0 then 'PASS' when rule_code = 'ENERGY_POSITIVE' then 'WARN' else 'FAIL' end status from (
  select 'PROD_REQUIRED_NULLS' rule_code, count(*) evaluated, count(*) filter (source_record_id is null or timestamp_start is null or line_id is null) failed from fact_production
  union all select 'PROD_QTY_RECON', count(*), count(*) filter (actual_quantity <> good_quantity + reject_quantity) from fact_production
  union all select 'PROD_TIME_VALID', count(*), count(*) filter (operating_time_min > planned_production_time_min) from fact_production
  union all select 'ENERGY_POSITIVE', count(*), count(*) filter (electricity_kwh <= 0) from fact_production
  union all select 'PROD_DUP_SOURCE', sum(n), count(*) filter (n > 1) from (select count(*) n from fact_production group by source_record_id) a
  union all select 'DT_DUP_PARENT', sum(n), count(*) filter (n > 1) from (select count(*) n from fact_downtime group by production_record_id) b
  union all select 'TELEMETRY_UNIQUE', sum(n), sum(n - 1) from (select count(*) n from telemetry group by equipment_id, event_timestamp) c
  union all select 'DT_LINEAGE', count(*), count(*) filter (not exists (select 1 from fact_production p where p.source_record_id = d.production_record_id)) from fact_downtime d
  union all select 'QUALITY_LINEAGE', count(*), count(*) filter (not exists (select 1 from fact_production p where p.source_record_id = d.production_record_id)) from fact_quality d) r"""
query("dq_rule_results", "rule_code evaluated failed failure_rate~ status", _RULES)(rules)
query("v_dq3_summary", "rules pass warn fail score~", f"select count(*) rules, count(*) filter (status = 'PASS') as pass, count(*) filter (status = 'WARN') as warn, count(*) filter (status = 'FAIL') as fail, 1 - sum(failed) / sum(evaluated) score from ({_RULES}) s")(lambda p: checks.summary(rules(p)))


def bins(p: Plant) -> DataFrame:
    clean = telemetry.clean_series(p.telemetry, "equipment_id", "event_timestamp", ["event_id"])
    made = telemetry.bin_features(clean, "equipment_id", "event_timestamp", "1 hour", ["tp2"], ["comp"], 3)
    return made.withColumnRenamed("samples", "n")


def alerts(p: Plant) -> DataFrame:
    known = bins(p).filter("n > 0")
    z = telemetry.robust_z(known, ["tp2_mean", "comp_active", "tp2_move"], F.col("bin") < F.lit("2024-01-08").cast("timestamp_ntz"))
    hot = z.withColumn("hot", F.coalesce(F.col("robust_z") >= 1.2, F.lit(False)))
    return telemetry.persistent_alerts(hot, "equipment_id", "bin", "hot", 2, 3)


query(
    "ts2_bin_features",
    "equipment_id bin n tp2_mean~ tp2_std~ tp2_min~ tp2_max~ tp2_last~ tp2_first~ tp2_move~ comp_active~ comp_transitions",
    "select equipment_id, bin, n, m tp2_mean, sd tp2_std, lo tp2_min, hi tp2_max, la tp2_last, fi tp2_first, mv tp2_move, ac comp_active, cast(trs as bigint) comp_transitions from bins",
)(bins)
query("ts5_trailing_context", "equipment_id bin tp2_mean_context~ tp2_mean_context_std~ tp2_mean_slope~ tp2_mean_deviation~", "select *, cm tp2_mean_context, cs tp2_mean_context_std, slope tp2_mean_slope, m - cm tp2_mean_deviation from ctx")(lambda p: telemetry.trailing_context(bins(p), "equipment_id", ["tp2_mean"]))
query(
    "ts7_failure_labels",
    "equipment_id bin in_failure in_warning excluded failure_id",
    """select equipment_id, bin, coalesce(bool_or(bin between failure_start and failure_end), false) in_failure, coalesce(bool_or(bin between failure_start - interval 24 hour and failure_end), false) in_warning, count(failure_id) > 0 excluded,
  arg_max(failure_id, failure_start) filter (bin between failure_start and failure_end) failure_id from bins left join failure_window on bin between failure_start - interval 24 hour and failure_end + interval 24 hour group by 1, 2""",
)(lambda p: telemetry.label_windows(bins(p), "bin", p.failure_window))
query("ts10_alerts", "equipment_id bin robust_z~ hot alert start", "select *, z robust_z from ep")(alerts)
query(
    "ts12_adaptive_threshold",
    "equipment_id bin threshold~",
    "select equipment_id, bin, case when count(z) over f >= 24 then quantile_cont(z, 0.985) over f end threshold from rob window f as (partition by equipment_id order by bin rows between 95 preceding and 24 preceding)",
)(lambda p: telemetry.adaptive_threshold(alerts(p), "equipment_id", "bin", "robust_z", 0.985, 24, 72, 24))
query(
    "ts14_any_alert",
    "failure_id detected lead_hours~ early",
    "select failure_id, t is not null detected, epoch(failure_start - t) / 3600 lead_hours, coalesce(epoch(failure_start - t) / 3600 >= 2, false) early from failure_window left join (select failure_id, min(bin) t from failure_window join ep on alert and bin between failure_start - interval 24 hour and failure_end group by 1) a using (failure_id)",
)(lambda p: telemetry.evaluate_any_alert(alerts(p), "bin", "alert", p.failure_window))
query(
    "ts15_episode_starts",
    "episodes true_episodes warned failures precision~ recall~ false_per_day~",
    """select e.*, true_episodes / episodes as precision, warned / failures recall, (episodes - true_episodes) / days false_per_day from (select count(*) episodes, count(*) filter (hit) true_episodes, (select count(distinct failure_id) from ep join failure_window on start and bin >= failure_start - interval 24 hour and bin < failure_start) warned,
  (select count(*) from failure_window) failures, (select greatest(epoch(max(bin) - min(bin)) / 86400, 1e-9) from ep) as days from (select exists (select 1 from failure_window where bin >= failure_start - interval 24 hour and bin < failure_start) hit from ep where start) s) e""",
)(lambda p: telemetry.evaluate_starts(alerts(p), "bin", "start", p.failure_window))


def daily(p: Plant) -> DataFrame:
    day = p.fact_production.groupBy("site_id", F.to_date("timestamp_start").alias("day")).agg(F.sum("good_quantity").cast("double").alias("units"))
    return telemetry.forecast_features(day, "site_id", "day", "units").withColumn("day", F.col("day").cast("string"))


_DAILY = """select * replace (cast(day as varchar) as day), lag(units, 1) over w lag_1, lag(units, 7) over w lag_7, case when count(units) over f = 7 then avg(units) over f end mean_7, case when count(units) over f = 7 then stddev_pop(units) over f end std_7
  from (select site_id, cast(timestamp_start as date) as day, cast(sum(good_quantity) as double) units from fact_production group by 1, 2) d window w as (partition by site_id order by day), f as (partition by site_id order by day rows between 7 preceding and 1 preceding)"""
query("ml1_forecast_features", "site_id day units~ lag_1~ lag_7~ mean_7~ std_7~", _DAILY)(daily)
query(
    "ml2_naive_forecast",
    "site_id n mae~ rmse~ r2~ mape~",
    f"select site_id, count(*) n, avg(abs(lag_7 - units)) mae, sqrt(avg((lag_7 - units) ** 2)) rmse, 1 - sum((lag_7 - units) ** 2) / (var_pop(units) * count(*)) r2, avg(abs((lag_7 - units) / units)) filter (abs(units) > 1e-9) mape from ({_DAILY}) x where lag_7 is not null group by 1",
)(lambda p: telemetry.regression_report(daily(p).filter("lag_7 is not null"), "units", "lag_7", ["site_id"]))


def recovery(p: Plant) -> DataFrame:
    p = p.narrow(["source_record_id", "site_id", "line_id", "equipment_id", "l_linenumber", "timestamp_start"], ["fact_downtime", "fact_maintenance"])
    failed = events(p).select("equipment_id", "downtime_event_id", "event_start")
    return control.first_after(failed, p.fact_maintenance.select("equipment_id", "start_timestamp", "work_order_id"), ["equipment_id"], "event_start", "start_timestamp", 168)


query(
    "v_pdm1_first_work_order",
    "downtime_event_id event_start start_timestamp work_order_id",
    "select ev.downtime_event_id, event_start, min(m.start_timestamp) start_timestamp, arg_min(m.work_order_id, (m.start_timestamp, m.work_order_id)) work_order_id from ev left join fact_maintenance m on m.equipment_id = ev.equipment_id and m.start_timestamp between event_start and event_start + interval 168 hour group by 1, 2",
)(recovery)


def cycles(p: Plant) -> DataFrame:
    vectors = p.spark.read.parquet(f"{p.sf_dir}/embeddings.parquet")
    long = vectors.select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn("sensor", F.col("pos") % 4)
    return telemetry.cycle_features(long, "vec_id", "sensor", "value")


query(
    "ml8_cycle_features",
    "vec_id sensor n mean~ std~ least~ most~ range~ rms~",
    "select vec_id, sensor, count(*) n, avg(v) mean, stddev_pop(v) std, min(v) least, max(v) most, max(v) - min(v) as range, sqrt(avg(v * v)) rms from (select vec_id, cast((pos - 1) % 4 as int) sensor, cast(v as double) v from (select vec_id, unnest(embedding) v, generate_subscripts(embedding, 1) pos from embeddings) x) y group by 1, 2",
)(cycles)
query("topk_above_ucl", "source_record_id excess~", "select source_record_id, p - upper_limit excess from spc where status = 'ABOVE_UCL' order by p - upper_limit desc, source_record_id limit 20")(
    lambda p: chart(p).filter("status = 'ABOVE_UCL'").withColumn("excess", F.col("proportion") - F.col("upper_limit")).orderBy(F.desc("excess"), "source_record_id").limit(20)
)


def ordinary(p: Plant) -> DataFrame:
    """Special causes of the Laney chart beside those of the ordinary p chart (spread 1), by phase."""
    reach = 3 * F.col("sigma_p")
    usual = (F.col("proportion") > F.least(F.lit(1.0), F.col("centre") + reach)) | (F.col("proportion") < F.greatest(F.lit(0.0), F.col("centre") - reach))
    phase = F.when(F.col("in_baseline"), "BASELINE").otherwise("MONITORING").alias("phase")
    scored = chart(p).filter("upper_limit IS NOT NULL")
    return scored.groupBy(phase).agg(F.count("*").alias("n"), F.avg(F.col("special_cause").cast("int")).alias("laney_share"), F.avg(usual.cast("int")).alias("ordinary_share"))


query(
    "v_spc3_laney_against_ordinary",
    "phase n laney_share~ ordinary_share~",
    """select case when yr = 1996 then 'BASELINE' else 'MONITORING' end phase, count(*) n, avg(cast(status in ('ABOVE_UCL', 'BELOW_LCL') as int)) laney_share, avg(cast(p > least(1, c + 3 * sp) or p < greatest(0, c - 3 * sp) as int)) ordinary_share
  from spc where upper_limit is not null group by 1""",
)(ordinary)


def best_and_worst(p: Plant) -> DataFrame:
    by = energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), ["site_id", "line_id"]).select("line_id", "kwh_per_1000")
    end = lambda order, name: by.orderBy(order, "line_id").limit(5).withColumn("side", F.lit(name))
    return end(F.asc_nulls_last("kwh_per_1000"), "BEST").unionByName(end(F.desc_nulls_last("kwh_per_1000"), "WORST"))


_INTENSITY = f"select line_id, kwh_per_1000 from ({_energy_sql('site_id, line_id')}) e order by kwh_per_1000"
query("topk2_energy_lines", "side line_id kwh_per_1000~", f"select *, 'BEST' side from ({_INTENSITY} nulls last, line_id limit 5) b union all select *, 'WORST' side from ({_INTENSITY} desc nulls last, line_id limit 5) w")(best_and_worst)


def day_gold(p: Plant, keys: list[str]) -> DataFrame:
    loss_side = production.loss_rollup(accounting(p), keys).select(*keys, "total_technical_loss_units", "total_technical_eur")
    energy_side = energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), keys).select(*keys, "electricity_kwh", "kwh_per_1000")
    return production.kpi_rollup(kpi(p), keys).join(loss_side, keys, "left").join(energy_side, keys, "left")


for _name, _keys in {"v_go2_line_day_gold": "date_id site_id line_id", "v_go3_site_day_gold": "date_id site_id"}.items():
    _by = _keys.replace(" ", ", ")
    query(
        _name,
        f"{_keys} oee~ total_technical_loss_units~ total_technical_eur~ electricity_kwh~ kwh_per_1000~",
        f"select * from ({_roll_sql(_by)}) k left join (select {_by}, sum(total_technical_loss_units) total_technical_loss_units, sum(total_technical_eur) total_technical_eur from acc group by {_by}) l using ({_by}) left join ({_energy_sql(_by)}) e using ({_by})",
    )(lambda p, k=_keys: day_gold(p, k.split()))


def by_type(p: Plant) -> DataFrame:
    month = p.fact_production.select(F.col("source_record_id").alias("production_record_id"), F.trunc("timestamp_start", "MM").cast("string").alias("month"))
    known = events(p).join(month, "production_record_id").join(p.dim_equipment.select("equipment_id", "equipment_type"), "equipment_id")
    return known.groupBy("month", "site_id", "equipment_type").agg(F.count("*").alias("failures"), F.countDistinct("equipment_id").alias("equipment"), F.sum("downtime_hours").alias("downtime_hours"), F.avg("repair_hours").alias("mttr_hours"))


query(
    "v_rel8_monthly_type_reliability",
    "month site_id equipment_type failures equipment downtime_hours~ mttr_hours~",
    """select cast(cast(date_trunc('month', p.timestamp_start) as date) as varchar) as month, ev.site_id, e.equipment_type, count(*) failures, count(distinct ev.equipment_id) equipment, sum(downtime_hours) downtime_hours, avg(repair_hours) mttr_hours
  from ev join fact_production p on p.source_record_id = ev.production_record_id join dim_equipment e on e.equipment_id = ev.equipment_id group by 1, 2, 3""",
)(by_type)


def gates(p: Plant) -> DataFrame:
    """Identities that must hold: each gate with the rows that break it."""
    a = accounting(p)
    off = lambda x, y: F.abs(x - y) > 1e-6
    bridge = F.col("good_quantity") + F.col("total_technical_loss_units")
    down = F.col("planned_downtime_min") + F.col("unplanned_downtime_min")
    flags = {
        "oee_in_bounds": (F.col("oee") < 0) | (F.col("oee") > 1),
        "oee_is_technical_efficiency": off(F.col("oee"), F.col("technical_output_efficiency")),
        "losses_bridge_capacity": off(bridge, F.col("theoretical_capacity_units")),
        "downtime_fills_the_shift": off(down, F.col("planned_production_time_min") - F.col("operating_time_min")),
        "changeover_within_planned": F.col("changeover_downtime_min") > F.col("planned_downtime_min"),
        "losses_not_negative": F.least("availability_loss_units", "performance_loss_units", "quality_loss_units") < 0,
    }
    return a.agg(*[F.count_if(c).alias(k) for k, c in flags.items()]).unpivot([], list(flags), "gate", "bad_rows")


query(
    "gt3_identities",
    "gate bad_rows",
    """unpivot (select count(*) filter (oee < 0 or oee > 1) oee_in_bounds, count(*) filter (abs(oee - technical_output_efficiency) > 1e-6) oee_is_technical_efficiency, count(*) filter (abs(good_quantity + total_technical_loss_units - theoretical_capacity_units) > 1e-6) losses_bridge_capacity,
  count(*) filter (abs(planned_downtime_min + unplanned_downtime_min - planned_production_time_min + operating_time_min) > 1e-6) downtime_fills_the_shift, count(*) filter (changeover_downtime_min > planned_downtime_min) changeover_within_planned,
  count(*) filter (least(availability_loss_units, performance_loss_units, quality_loss_units) < 0) losses_not_negative from acc) on columns(*) into name gate value bad_rows""",
)(gates)
