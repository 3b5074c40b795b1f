"""All data-quality rules, their summaries, and the validation gates: each gate with the rows that break it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnworks.operators import checks, energy, production
from kilnworks.plans import manufacturing as m
from kilnworks.plans.manufacturing import query
from kilnworks.sources.fixtures import Plant
from kilnworks.sources.shared import written

#: Prices expected for each year (5 sites, 2 halves); tolerance of reconciliations; cadence of telemetry.
PRICES, TOLERANCE, CADENCE = 10, 0.001, 300
RULES = {
    "PROD": "production", "DT": "downtime", "QUALITY": "quality", "MAINT": "maintenance", "ENERGY": "energy",
    "SITE": "energy", "LINE": "energy", "AUX": "energy", "EUROSTAT": "reference", "TELEMETRY": "telemetry",
}
WARN = {"TELEMETRY_CADENCE_CONTINUITY"}
REQUIRED = {
    "PROD": ("fact_production", "source_record_id timestamp_start site_id line_id product_code shift_code planned_quantity actual_quantity good_quantity"),
    "DT": ("fact_downtime", "source_record_id production_record_id event_start event_end duration_min failure_reason planned_flag"),
    "QUALITY": ("fact_quality", "source_record_id production_record_id event_timestamp rejected_units"),
    "MAINT": ("fact_maintenance", "work_order_id downtime_event_id equipment_id start_timestamp end_timestamp"),
    "ENERGY": ("fact_production", "source_record_id electricity_kwh timestamp_start site_id line_id"),
}
#: Fields that enterprise telemetry must have, its kind of equipment in the projection, and its lineage.
TELEMETRY_FIELDS = """event_timestamp source_event_timestamp site_id equipment_id source_dataset_id scenario_source_dataset_id condition_score degradation_index condition_state
  selected_warning_state selected_warning_horizon_hours source_data_origin scenario_type transformation_basis degradation_signal_origin"""
TELEMETRY_EQUIPMENT = "CONVEYOR"
LINEAGE = {
    "source_data_origin": "EXTERNAL_REAL", "scenario_type": "SYNTHETIC_ENTERPRISE_ADAPTATION", "transformation_basis": "METROPT_INFORMED",
    "degradation_signal_origin": "SYNTHETIC_CONTROLLED", "source_code": "METROPT3", "scenario_code": "METROPT3_ENTERPRISE_PDM",
}
KEYS = {"PROD": "source_record_id", "DT": "source_record_id", "QUALITY": "source_record_id", "MAINT": "work_order_id", "ENERGY": "source_record_id"}


def _null(columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns.split()])


def _off(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) > tolerance


def _minutes(start: str, end: str) -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp_ltz")) - F.unix_micros(F.col(start).cast("timestamp_ltz"))) / 6e7


def site_energy(p: Plant) -> DataFrame:
    """Site shifts beside the sum of their lines."""
    keys = ["site_id", "shift_code", "date_id", "timestamp_start"]
    lines = p.fact_line_energy_detail.groupBy(*keys).agg(F.sum("line_total_electricity_kwh").alias("summed"))
    return p.fact_site_energy_detail.join(lines, keys, "left")


def lineage(p: Plant) -> DataFrame:
    """Enterprise telemetry beside the site and type of its equipment and the codes of its two datasets; nothing is lost where those are missing."""
    place = p.dim_equipment.join(p.dim_line.select("line_id", F.col("site_id").alias("known_site")), "line_id", "left").select("equipment_id", "equipment_type", "known_site")
    codes = F.broadcast(p.dim_source_dataset)  # a row for each registered dataset
    source = codes.select("source_dataset_id", "source_code")
    scenario = codes.select(F.col("source_dataset_id").alias("scenario_source_dataset_id"), F.col("source_code").alias("scenario_code"))
    return p.enterprise_telemetry.join(place, "equipment_id", "left").join(source, "source_dataset_id", "left").join(scenario, "scenario_source_dataset_id", "left")


def all_rules(p: Plant) -> DataFrame:
    """The 29 rules, evaluated once however often a plan reads them."""
    return p.once("rules", lambda p: written(_all_rules(p.kept()), "rules"))


def _all_rules(p: Plant) -> DataFrame:
    """Rules on rows of one table share its scan; those on keys share a grouping."""
    rule = checks.RowRule
    c = F.col
    rows: dict[str, list[checks.RowRule]] = {"fact_production": [], "fact_downtime": [], "fact_quality": [], "fact_maintenance": []}
    for k, (table, columns) in REQUIRED.items():
        rows[table].append(rule(f"{k}_REQUIRED_NULLS", _null(columns)))
    rows["fact_production"] += [
        rule("PROD_QTY_RECON", c("actual_quantity") != c("good_quantity") + c("reject_quantity")),
        rule("PROD_TIME_VALID", (c("operating_time_min") < 0) | (c("operating_time_min") > c("planned_production_time_min"))),
        rule("ENERGY_POSITIVE", (c("electricity_kwh") <= 0) | (F.try_divide(c("electricity_kwh"), c("planned_production_time_min") / 60) <= 0)),
    ]
    rows["fact_downtime"].append(rule("DT_DURATION_RECON", _off(_minutes("event_start", "event_end"), c("duration_min"))))
    rows["fact_maintenance"].append(rule("MAINT_INTERVAL_VALID", c("end_timestamp") < c("start_timestamp")))
    prod, down, telemetry = p.fact_production, p.fact_downtime, p.telemetry
    step = Window.partitionBy("equipment_id").orderBy("event_timestamp", "event_id")
    seconds = F.unix_timestamp(c("event_timestamp").cast("timestamp_ltz"))
    cadence = telemetry.withColumn("gap", seconds - F.lag(seconds).over(step)).filter("gap IS NOT NULL")
    enterprise = lineage(p)
    years = prod.agg((PRICES * F.countDistinct(F.floor(c("date_id") / 10000))).alias("evaluated"))
    prices = p.ref_price.agg(F.count("*").alias("n")).crossJoin(years)  # one row each
    return checks.results(
        [
            *[checks.run_row_rules(getattr(p, t), r) for t, r in rows.items()],
            checks.key_rules(prod, KEYS["PROD"], ["PROD_DUP_SOURCE", "ENERGY_DUP_SOURCE"], {
                "DT_LINEAGE": (down, "production_record_id"), "QUALITY_LINEAGE": (p.fact_quality, "production_record_id"), "ENERGY_LINEAGE": (p.fact_line_energy_detail, "production_record_id"),
            }),
            checks.key_rules(down, KEYS["DT"], ["DT_DUP_SOURCE"], {"MAINT_LINEAGE": (p.fact_maintenance, "downtime_event_id")}),
            checks.key_rules(p.fact_quality, KEYS["QUALITY"], ["QUALITY_DUP_SOURCE"], {}),
            checks.key_rules(p.fact_maintenance, KEYS["MAINT"], ["MAINT_DUP_SOURCE"], {}),
            checks.run_row_rules(site_energy(p), [
                rule("SITE_ENERGY_RECON", _off(c("line_electricity_kwh") + c("site_auxiliary_electricity_kwh"), c("site_total_electricity_kwh")) | _off(c("summed"), c("line_electricity_kwh"))),
                rule("AUX_ENERGY_RECON", _off((c("site_auxiliary_base_kw") + c("site_weather_auxiliary_kw")) * c("shift_hours"), c("site_auxiliary_electricity_kwh"))),
            ]),
            checks.run_row_rules(p.fact_line_energy_detail, [rule("LINE_ENERGY_RECON", _off(c("line_production_electricity_kwh") + c("line_idle_electricity_kwh"), c("line_total_electricity_kwh")))]),
            prices.select(F.lit("EUROSTAT_PRICE_COVERAGE").alias("rule_code"), "evaluated", F.abs(c("evaluated") - c("n")).alias("failed")),
            checks.run_row_rules(p.ref_price, [rule("EUROSTAT_PRICE_POSITIVE", c("price_value").isNull() | (c("price_value") <= 0))]),
            checks.run_row_rules(enterprise, [
                rule("TELEMETRY_REQUIRED_FIELDS_COMPLETE", _null(TELEMETRY_FIELDS)),
                rule("TELEMETRY_ENTERPRISE_MAPPING_VALID", c("known_site").isNull() | ~c("known_site").eqNullSafe(c("site_id")) | ~c("equipment_type").eqNullSafe(TELEMETRY_EQUIPMENT)),
                rule("TELEMETRY_LINEAGE_VALID", reduce(lambda a, b: a | b, [~c(k).eqNullSafe(v) for k, v in LINEAGE.items()]) | F.coalesce(c("source_event_timestamp") >= c("event_timestamp"), F.lit(False))),
            ]),
            checks.extra_rows(telemetry, "TELEMETRY_EQUIPMENT_TIMESTAMP_UNIQUE", ["equipment_id", "event_timestamp"]),
            checks.run_row_rules(cadence, [rule("TELEMETRY_CADENCE_CONTINUITY", c("gap") != CADENCE)]),
        ],
        warn=WARN,
    ).withColumn("domain", _domain())


def _domain() -> Column:
    first = F.substring_index("rule_code", "_", 1)
    return reduce(lambda made, kv: F.when(first == kv[0], kv[1]).otherwise(made), RULES.items(), F.lit(None).cast("string"))


def _count(code: str, bad: str, table: str) -> str:
    return f"select '{code}' rule_code, count(*) evaluated, count(*) filter ({bad}) failed from {table}"


def _orphan(code: str, table: str, key: str, parent: str, parent_key: str) -> str:
    return _count(code, f"not exists (select 1 from {parent} q where q.{parent_key} = d.{key})", f"{table} d")


_PARTS = [
    *[_count(f"{k}_REQUIRED_NULLS", " or ".join(f"{c} is null" for c in columns.split()), table) for k, (table, columns) in REQUIRED.items()],
    *[f"select '{k}_DUP_SOURCE', sum(n), count(*) filter (n > 1) from (select count(*) n from {REQUIRED[k][0]} group by {key}) g" for k, key in KEYS.items()],
    _count("PROD_QTY_RECON", "actual_quantity <> good_quantity + reject_quantity", "fact_production"),
    _count("PROD_TIME_VALID", "operating_time_min < 0 or operating_time_min > planned_production_time_min", "fact_production"),
    _count("ENERGY_POSITIVE", "electricity_kwh <= 0 or electricity_kwh / nullif(planned_production_time_min / 60, 0) <= 0", "fact_production"),
    _count("DT_DURATION_RECON", "abs(epoch(event_end - event_start) / 60 - duration_min) > 0.001", "fact_downtime"),
    _count("MAINT_INTERVAL_VALID", "end_timestamp < start_timestamp", "fact_maintenance"),
    _orphan("DT_LINEAGE", "fact_downtime", "production_record_id", "fact_production", "source_record_id"),
    _orphan("QUALITY_LINEAGE", "fact_quality", "production_record_id", "fact_production", "source_record_id"),
    _orphan("MAINT_LINEAGE", "fact_maintenance", "downtime_event_id", "fact_downtime", "source_record_id"),
    _orphan("ENERGY_LINEAGE", "fact_line_energy_detail", "production_record_id", "fact_production", "source_record_id"),
    _count("SITE_ENERGY_RECON", "abs(line_electricity_kwh + site_auxiliary_electricity_kwh - site_total_electricity_kwh) > 0.001", "fact_site_energy_detail"),
    _count("AUX_ENERGY_RECON", "abs((site_auxiliary_base_kw + site_weather_auxiliary_kw) * shift_hours - site_auxiliary_electricity_kwh) > 0.001", "fact_site_energy_detail"),
    _count("LINE_ENERGY_RECON", "abs(line_production_electricity_kwh + line_idle_electricity_kwh - line_total_electricity_kwh) > 0.001", "fact_line_energy_detail"),
    "select 'EUROSTAT_PRICE_COVERAGE', y, abs(y - n) from (select count(*) n from ref_price) a, (select 10 * count(distinct date_id // 10000) y from fact_production) b",
    _count("EUROSTAT_PRICE_POSITIVE", "price_value is null or price_value <= 0", "ref_price"),
    _count("TELEMETRY_REQUIRED_FIELDS_COMPLETE", " or ".join(f"{x} is null" for x in TELEMETRY_FIELDS.split()), "enterprise_telemetry"),
    _count("TELEMETRY_ENTERPRISE_MAPPING_VALID", f"s.site_id is null or s.site_id is distinct from t.site_id or e.equipment_type is distinct from '{TELEMETRY_EQUIPMENT}'",
      "enterprise_telemetry t left join dim_equipment e on e.equipment_id = t.equipment_id left join dim_line a on a.line_id = e.line_id left join dim_site s on s.site_id = a.site_id"),
    _count("TELEMETRY_LINEAGE_VALID", " or ".join(f"{x} is distinct from '{v}'" for x, v in LINEAGE.items()) + " or source_event_timestamp >= event_timestamp",
      "(select t.*, a.source_code, b.source_code scenario_code from enterprise_telemetry t left join dim_source_dataset a using (source_dataset_id) left join dim_source_dataset b on b.source_dataset_id = t.scenario_source_dataset_id) x"),
    "select 'TELEMETRY_EQUIPMENT_TIMESTAMP_UNIQUE', sum(n), sum(n - 1) from (select count(*) n from telemetry group by equipment_id, event_timestamp) g",
    """select 'TELEMETRY_CADENCE_CONTINUITY', count(*), count(*) filter (gap <> 300) from (select cast(floor(epoch(event_timestamp)) as bigint) - lag(cast(floor(epoch(event_timestamp)) as bigint)) over
  (partition by equipment_id order by event_timestamp, event_id) gap from telemetry) g where gap is not null""",
]
_DOMAINS = " ".join(f"when '{k}' then '{v}'" for k, v in RULES.items())
_ALL = f"""select rule_code, case split_part(rule_code, '_', 1) {_DOMAINS} end as domain, cast(evaluated as bigint) evaluated, cast(failed as bigint) failed, case when evaluated > 0 then failed / evaluated else 0 end failure_rate,
  case when failed = 0 then 'PASS' when rule_code = 'TELEMETRY_CADENCE_CONTINUITY' then 'WARN' else 'FAIL' end status from ({" union all ".join(_PARTS)}) r"""
_STATES = "count(*) filter (status = 'PASS') as pass, count(*) filter (status = 'WARN') as warn, count(*) filter (status = 'FAIL') as fail"
query("dq_all_rules", "domain rule_code evaluated failed failure_rate~ status", _ALL)(all_rules)
query("v_dq1_latest_results", "rule_code evaluated failed status", _ALL)(lambda p: checks.latest(checks.with_runs(all_rules(p))))
query("v_dq2_domain_summary", "domain rules pass warn fail evaluated failed score~", f"""select domain, count(*) rules, {_STATES}, cast(sum(evaluated) as bigint) evaluated, cast(sum(failed) as bigint) failed,
  1 - sum(failed) / sum(evaluated) score from ({_ALL}) s group by 1""")(lambda p: checks.domain_summary(all_rules(p)))  # fmt: skip
query("v_go5_dq_domain_report", "domain rules score_pct~", f"select domain, count(*) rules, 100 * (1 - sum(failed) / sum(evaluated)) score_pct from ({_ALL}) s group by 1")(
    lambda p: checks.domain_summary(all_rules(p)).withColumn("score_pct", 100 * F.col("score"))
)
query("v_go6_dq_rule_status", "domain rule_code status failed", _ALL)(all_rules)


def gate(name: str, tests: dict[str, tuple[Callable[[Plant], DataFrame], str]]) -> None:
    """Registers a gate: name -> (the rows that break it, their count as SQL)."""
    sql = " union all ".join(f"select '{k}' gate, ({count}) bad_rows" for k, (_, count) in tests.items())

    def plan(p: Plant) -> DataFrame:
        found = [bad(p).agg(F.count("*").alias("bad_rows")).select(F.lit(k).alias("gate"), "bad_rows") for k, (bad, _) in tests.items()]
        return reduce(DataFrame.unionByName, found)

    query(name, "gate bad_rows", sql)(plan)


def _unlike(whole: Callable[[Plant], DataFrame], part: Callable[[Plant], DataFrame], keys: list[str], value: str) -> Callable[[Plant], DataFrame]:
    """Keys that only one side has, or whose values differ: a full join of expected and actual."""

    def bad(p: Plant) -> DataFrame:
        a = whole(p).select(*keys, F.col(value).cast("double").alias("expected"))
        b = part(p).select(*keys, F.col(value).cast("double").alias("actual"))
        both = a.join(b, keys, "full")
        return both.filter(F.col("expected").isNull() | F.col("actual").isNull() | (F.abs(F.col("expected") - F.col("actual")) > 1e-3))

    return bad


def _ambiguous(p: Plant) -> DataFrame:
    """Failure events whose downtime record is not exactly one."""
    p, events = failures(p)
    return events.join(p.fact_downtime.select(F.col("source_record_id").alias("downtime_event_id")), "downtime_event_id", "left").groupBy("downtime_event_id").count().filter("count != 1")


gate("gt1_table_counts", {
    "one_energy_row_per_shift": (lambda p: p.fact_production.join(p.fact_line_energy_detail.select(F.col("production_record_id").alias("source_record_id")), "source_record_id", "left_anti"), "select count(*) from fact_production d where not exists (select 1 from fact_line_energy_detail q where q.production_record_id = d.source_record_id)"),
    "sites_are_five": (lambda p: p.dim_site.agg(F.count("*").alias("n")).filter("n != 5"), "select cast(count(*) <> 5 as bigint) from dim_site"),
    "lines_are_at_least_25": (lambda p: p.dim_line.agg(F.count("*").alias("n")).filter("n < 25"), "select cast(count(*) < 25 as bigint) from dim_line"),
})
gate("gt2_facts", {
    "equipment_of_shift": (lambda p: p.fact_production.join(p.dim_equipment, "equipment_id", "left_anti"), "select count(*) from fact_production d where not exists (select 1 from dim_equipment q where q.equipment_id = d.equipment_id)"),
    "line_of_equipment": (lambda p: p.dim_equipment.join(p.dim_line, "line_id", "left_anti"), "select count(*) from dim_equipment d where not exists (select 1 from dim_line q where q.line_id = d.line_id)"),
    "loss_value_of_product": (lambda p: p.fact_production.join(p.cfg_product_loss_value, "product_code", "left_anti"), "select count(*) from fact_production d where not exists (select 1 from cfg_product_loss_value q where q.product_code = d.product_code)"),
    "good_within_actual": (lambda p: p.fact_production.filter("good_quantity > actual_quantity"), "select count(*) from fact_production where good_quantity > actual_quantity"),
    "repeated_shift": (lambda p: p.fact_production.groupBy("source_record_id").count().filter("count > 1"), "select count(*) from (select 1 from fact_production group by source_record_id having count(*) > 1) g"),
})
gate("gt5_benchmark", {
    "pareto_shares_sum_to_one": (lambda p: _pareto(p).groupBy("site_id").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9"), "select 0"),
    "pareto_ends_at_one": (lambda p: _pareto(p).groupBy("site_id").agg(F.max("cumulative_share").alias("s")).filter("abs(s - 1) > 1e-9"), "select 0"),
    "line_bounds": (lambda p: m.lines(p).filter("oee < 0 OR oee > 1 OR availability > 1 OR quality > 1"), f"select count(*) from ({m._LINES}) l where oee < 0 or oee > 1 or availability > 1 or quality > 1"),
    "changeover_median_in_bounds": (lambda p: production.changeover_summary(p.fact_downtime).filter("median_min < least_min OR median_min > most_min"), "select 0"),
})


def _pareto(p: Plant) -> DataFrame:
    return production.pareto(production.downtime_by_reason(p.fact_downtime), ["site_id"], "downtime_min", ["failure_category", "failure_reason", "planned_flag"])


def _energy(keys: list[str]) -> Callable[[Plant], DataFrame]:
    return lambda p: energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), keys)


gate("gt6_energy", {
    "consumption_is_positive": (lambda p: p.fact_production.filter("electricity_kwh <= 0"), "select count(*) from fact_production where electricity_kwh <= 0"),
    "lines_sum_to_sites": (_unlike(_energy(["site_id"]), lambda p: _energy(["site_id", "line_id"])(p).groupBy("site_id").agg(F.sum("electricity_kwh").alias("electricity_kwh")), ["site_id"], "electricity_kwh"), "select 0"),
    "days_sum_to_sites": (_unlike(_energy(["site_id"]), lambda p: _energy(["date_id", "site_id"])(p).groupBy("site_id").agg(F.sum("electricity_kwh").alias("electricity_kwh")), ["site_id"], "electricity_kwh"), "select 0"),
})
gate("gt7_utilities", {
    "shares_in_bounds": (lambda p: energy.site_auxiliary_kpi(p.fact_site_energy_detail).filter("auxiliary_share < 0 OR auxiliary_share > 1 OR weather_share < 0 OR weather_share > 1"), "select 0"),
    "idle_within_total": (lambda p: p.fact_line_energy_detail.filter("line_idle_electricity_kwh > line_total_electricity_kwh"), "select count(*) from fact_line_energy_detail where line_idle_electricity_kwh > line_total_electricity_kwh"),
    "air_missing": (lambda p: p.fact_line_energy_detail.filter("compressed_air_nm3 IS NULL"), "select count(*) from fact_line_energy_detail where compressed_air_nm3 is null"),
})
gate("gt8_cost", {
    "shifts_without_price": (lambda p: m.cost(p).filter("price_value IS NULL"), "select count(*) from cost where price_value is null"),
    "cost_is_kwh_times_price": (lambda p: m.cost(p).filter("abs(cost_eur - site_total_electricity_kwh * price_value) > 1e-6"), "select 0"),
    "years_outside_band": (lambda p: energy.consumption_band(m.cost(p)).filter("NOT in_band"), "select count(*) from (select sum(site_total_electricity_kwh) / 1000 mwh from cost group by site_id, year(timestamp_start)) c where not (mwh >= 2000 and mwh < 20000)"),
})
gate("gt9_rule_results", {
    "states_add_up": (lambda p: checks.summary(all_rules(p)).filter("pass + warn + fail != rules"), "select 0"),
    "rules_are_29": (lambda p: all_rules(p).agg(F.countDistinct("rule_code").alias("n")).filter("n != 29"), "select 0"),
})
gate("gt10_gold", {
    "repeated_shift_gold": (lambda p: m.gold(p).groupBy("source_record_id").count().filter("count > 1"), "select 0"),
    "missing_domains": (lambda p: all_rules(p).sparkSession.createDataFrame([(d,) for d in sorted(set(RULES.values()))], "domain string").exceptAll(checks.domain_summary(all_rules(p)).select("domain")), "select 0"),
    "site_days_reconcile": (_unlike(lambda p: m.day_gold(p, ["date_id", "site_id"]), lambda p: m.day_gold(p, ["date_id", "site_id", "line_id"]).groupBy("date_id", "site_id").agg(F.sum("electricity_kwh").alias("electricity_kwh")), ["date_id", "site_id"], "electricity_kwh"), "select 0"),
})
gate("gt11_air_layers", {
    "detail_equals_gold": (_unlike(lambda p: p.fact_line_energy_detail.groupBy("site_id").agg(F.sum("compressed_air_nm3").alias("air")), lambda p: m.gold(p).groupBy("site_id").agg(F.sum("compressed_air_nm3").alias("air")), ["site_id"], "air"), "select 0"),
})
gate("gt12_chart", {
    "limits_in_bounds": (lambda p: m.chart(p).filter("lower_limit < 0 OR upper_limit > 1 OR lower_limit > upper_limit"), "select count(*) from spc where lower_limit < 0 or upper_limit > 1 or lower_limit > upper_limit"),
    "repeated_rows": (lambda p: m.chart(p).groupBy("source_record_id").count().filter("count > 1"), "select count(*) from (select 1 from spc group by source_record_id having count(*) > 1) g"),
})
def failures(p: Plant) -> tuple[Plant, DataFrame]:
    """Tables over production rows written once, and their failure events, written once too."""
    return p.once("failures", lambda p: (p.kept(), written(m.events(p.kept()), "events")))


gate("gt13_reliability", {
    "links_not_exactly_one": (_ambiguous, "select 0"),
    "failures_by_month_and_total": (_unlike(lambda p: failures(p)[1].groupBy("site_id").agg(F.count("*").alias("n")), lambda p: m.control.monthly_reliability(failures(p)[1].drop("line_id"), failures(p)[0].fact_production, "site_id").groupBy("site_id").agg(F.sum("failures").alias("n")), ["site_id"], "n"), "select 0"),
    "work_orders_of_no_event": (lambda p: failures(p)[0].fact_maintenance.filter("NOT planned_flag").join(failures(p)[1], "downtime_event_id", "left_anti"), "select count(*) from fact_maintenance d where not planned_flag and not exists (select 1 from ev where ev.downtime_event_id = d.downtime_event_id)"),
})
gate("gt14_failure_downtime", {
    "linked_within_unplanned": (lambda p: m.control.failure_downtime(p.fact_downtime, m.events(p)).filter("linked_count > unplanned_count OR unplanned_count > event_count"), "select 0"),
    "equipment_sums_to_events": (_unlike(lambda p: m.events(p).groupBy("equipment_id").agg(F.count("*").alias("n")), lambda p: m.reliability(p).filter("failure_count > 0").select("equipment_id", F.col("failure_count").alias("n")), ["equipment_id"], "n"), "select 0"),
})
gate("gt15_trend_coverage", {
    "months_without_trend": (lambda p: p.fact_production.select("line_id", F.trunc("timestamp_start", "MM").alias("month")).distinct().exceptAll(m.control.monthly_reliability(m.events(p).drop("site_id"), p.fact_production, "line_id").select("line_id", "month")), "select 0"),
})
