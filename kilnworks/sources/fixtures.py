"""Projection of the test tables onto the manufacturing schema, as temporary views and as SQL text.

The statements are plain SQL that Spark and DuckDB both read: dimensions, facts, reference prices and telemetry are
derived from the order and event tables row by row, so their size follows the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from copy import copy

from pyspark.sql import DataFrame, SparkSession

from kilnworks.sources.shared import written

# The mapping of the order tables to the manufacturing schema.
PROJECTION = {
    "dim_site": "select cast(r_regionkey as int) site_id, concat('SITE-', cast(r_regionkey as string)) site_code, r_name site_name from region",
    "dim_line": "select cast(n_nationkey as int) line_id, cast(n_regionkey as int) site_id, concat('LINE-', cast(n_nationkey as string)) line_code, n_name line_name from nation",
    "dim_equipment": """select s_suppkey equipment_id, cast(s_nationkey as int) line_id, s_name equipment_code,
  case cast(s_suppkey % 4 as int) when 0 then 'FILLER' when 1 then 'CONVEYOR' when 2 then 'PACKER' else 'LABELLER' end equipment_type from supplier""",
    "cfg_product_loss_value": "select * from (values ('ECONOMY',0.12),('SMALL',0.15),('MEDIUM',0.18),('STANDARD',0.18),('LARGE',0.28),('PROMO',0.35)) v(product_code, eur_per_unit)",
    "fact_production": """select concat_ws('-', cast(l.l_orderkey as string), cast(l.l_linenumber as string), cast(l.l_partkey as string), cast(l.l_suppkey as string), cast(cast(l.l_shipdate as date) as string)) source_record_id,
  l.l_shipdate + case l.l_linenumber % 3 when 0 then interval '6' hour when 1 then interval '14' hour else interval '22' hour end timestamp_start,
  cast(extract(year from l.l_shipdate)*10000+extract(month from l.l_shipdate)*100+extract(day from l.l_shipdate) as int) date_id,
  cast(n.n_regionkey as int) site_id, cast(s.s_nationkey as int) line_id, p.p_type product_code,
  case l.l_linenumber % 3 when 0 then 'SHIFT-A' when 1 then 'SHIFT-B' else 'SHIFT-C' end shift_code,
  l.l_suppkey equipment_id, l.l_linenumber,
  cast(l.l_quantity as bigint)*100 planned_quantity,
  cast(l.l_quantity as bigint)*(100-cast(round(l.l_tax*100) as bigint)) actual_quantity,
  cast(l.l_quantity as bigint)*(100-cast(round(l.l_tax*100) as bigint)-cast(round(l.l_discount*100) as bigint)) good_quantity,
  cast(l.l_quantity as bigint)*cast(round(l.l_discount*100) as bigint) reject_quantity,
  cast(l.l_quantity as bigint)*15 nominal_rate,
  cast(480-10*l.l_linenumber as double) operating_time_min, cast(480 as double) planned_production_time_min,
  cast(floor(l.l_extendedprice) as double)/100 electricity_kwh
from lineitem l join supplier s on s.s_suppkey=l.l_suppkey join nation n on n.n_nationkey=s.s_nationkey join part p on p.p_partkey=l.l_partkey""",
    "fact_downtime": """select concat(source_record_id,'-P') source_record_id, source_record_id production_record_id, site_id, line_id, equipment_id, true planned_flag,
  'CHANGEOVER' failure_category, 'Planned changeover' failure_reason, cast(4*l_linenumber as double) duration_min,
  timestamp_start event_start, timestamp_start + interval '4' minute * l_linenumber event_end
from fact_production
union all
select concat(source_record_id,'-U'), source_record_id, site_id, line_id, equipment_id, false,
  case cast(equipment_id % 3 as int) when 0 then 'MECHANICAL' when 1 then 'ELECTRICAL' else 'PROCESS' end,
  concat('reason ', cast(equipment_id % 7 as string)), cast(6*l_linenumber as double),
  timestamp_start + interval '60' minute, timestamp_start + interval '60' minute + interval '6' minute * l_linenumber
from fact_production""",
    "fact_maintenance": """select concat(source_record_id,'-M1') work_order_id, source_record_id downtime_event_id, production_record_id, site_id, equipment_id, false planned_flag,
  event_start + interval '2' minute start_timestamp, event_end end_timestamp, (duration_min-2)/60 duration_hours, duration_min/60 labor_hours, duration_min*0.7 total_cost
from fact_downtime where not planned_flag and duration_min >= 24 and failure_category in ('MECHANICAL','ELECTRICAL')
union all
select concat(source_record_id,'-M2'), source_record_id, production_record_id, site_id, equipment_id, false,
  event_start + interval '5' minute, event_end, (duration_min-5)/60, duration_min/60, duration_min*0.5
from fact_downtime where not planned_flag and duration_min >= 36 and failure_category in ('MECHANICAL','ELECTRICAL')""",
    "fact_quality": """select concat(source_record_id,'-Q1') source_record_id, source_record_id production_record_id, site_id, line_id, product_code, timestamp_start + interval '30' minute event_timestamp, reject_quantity - cast(floor(reject_quantity/2.0) as bigint) rejected_units
from fact_production where reject_quantity > 0
union all
select concat(source_record_id,'-Q2'), source_record_id, site_id, line_id, product_code, timestamp_start + interval '90' minute, cast(floor(reject_quantity/2.0) as bigint)
from fact_production where reject_quantity > 1""",
    "fact_line_energy_detail": """select source_record_id production_record_id, site_id, line_id, product_code, shift_code, date_id, timestamp_start, actual_quantity,
  electricity_kwh*0.95 line_production_electricity_kwh, electricity_kwh*0.05 line_idle_electricity_kwh, electricity_kwh line_total_electricity_kwh,
  case when product_code='PROMO' then null else cast(actual_quantity as double)*20.0/1000.0 end compressed_air_nm3,
  cast(extract(month from timestamp_start) as double)*2.5-3.0 shift_mean_air_temperature_c
from fact_production""",
    "fact_site_energy_detail": """select site_id, shift_code, date_id, timestamp_start, line_kwh line_electricity_kwh, units production_units, t mean_air_temperature_c,
  cast(180 as double) site_auxiliary_base_kw, w site_weather_auxiliary_kw, cast(8 as double) shift_hours,
  (180+w)*8 site_auxiliary_electricity_kwh, line_kwh+(180+w)*8 site_total_electricity_kwh
from (select site_id, shift_code, date_id, timestamp_start, sum(line_total_electricity_kwh) line_kwh, cast(sum(actual_quantity) as bigint) units, max(shift_mean_air_temperature_c) t,
  max(case when shift_mean_air_temperature_c>22 then (shift_mean_air_temperature_c-22)*3 when shift_mean_air_temperature_c<5 then (5-shift_mean_air_temperature_c)*2 else cast(0 as double) end) w
  from fact_line_energy_detail group by site_id, shift_code, date_id, timestamp_start) x""",
    "ref_price": """select s.site_code geo_code, concat(cast(y.yr as string), h.half) period_code, cast(0.10 as double)+0.01*s.site_id+0.002*(y.yr-1995) price_value
from dim_site s cross join (select distinct cast(date_id/10000 as int) yr from (select date_id - date_id % 10000 date_id from fact_production) d) y cross join (values ('-S1'),('-S2')) h(half)""",
    "telemetry": "select event_id, ts event_timestamp, cast(user_id % 5 as int) equipment_id, value tp2, value*0.5+10 tp3, case when event_type='error' then 1 else 0 end comp from events",
    "dim_source_dataset": "select * from (values (1,'METROPT3'),(2,'METROPT3_ENTERPRISE_PDM'),(3,'OTHER')) v(source_dataset_id, source_code)",
    "enterprise_telemetry": """select t.event_id, t.event_timestamp, case when t.event_id % 211 = 0 then t.event_timestamp else t.event_timestamp - interval '4' year end source_event_timestamp,
  cast(case when t.event_id % 89 = 0 then 0 else x.site_id end as int) site_id, t.equipment_id, case when t.event_id % 151 = 0 then 3 else 1 end source_dataset_id, 2 scenario_source_dataset_id,
  case when t.event_id % 173 = 0 then null else 100 - t.tp2 / 10 end condition_score, t.comp*0.5 degradation_index, case when t.comp = 1 then 'DEGRADING' else 'NORMAL' end condition_state,
  case when t.comp = 1 then 'WARNING' else 'NONE' end selected_warning_state, 24 selected_warning_horizon_hours, case when t.event_id % 97 = 0 then null else 'EXTERNAL_REAL' end source_data_origin,
  'SYNTHETIC_ENTERPRISE_ADAPTATION' scenario_type, case when t.event_id % 199 = 0 then 'GUESSED' else 'METROPT_INFORMED' end transformation_basis, 'SYNTHETIC_CONTROLLED' degradation_signal_origin
from telemetry t left join (select e.equipment_id, l.site_id from dim_equipment e join dim_line l on l.line_id = e.line_id) x on x.equipment_id = t.equipment_id""",
    "failure_window": """select failure_id, cast(s as timestamp) failure_start, cast(e as timestamp) failure_end from (values ('1','2024-01-08 10:00:00','2024-01-08 14:00:00'),('2','2024-01-15 00:00:00','2024-01-15 06:00:00'),('3','2024-01-20 12:00:00','2024-01-20 18:00:00'),('4','2024-01-26 09:00:00','2024-01-26 12:00:00')) v(failure_id,s,e)""",
}
RAW = ["region", "nation", "supplier", "part", "lineitem", "events"]


class Plant:
    """The projected tables of one folder, each planned once and shared by what reads it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for name in RAW:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        self._made: dict[str, object] = {}
        self._project(PROJECTION)

    def _project(self, names: Iterable[str]) -> None:
        for name in names:
            self.spark.sql(PROJECTION[name]).createOrReplaceTempView(name)
        self._tables = {name: self.spark.table(name) for name in PROJECTION}

    def once(self, name: str, make: Callable[[Plant], object]) -> object:
        """What make gives for these tables, made the first time only."""
        if name not in self._made:
            self._made[name] = make(self)
        return self._made[name]

    def kept(self) -> Plant:
        """The same tables over production rows that are joined and written once, for plans that read them many times."""
        if "kept" not in self._made:
            written(self.fact_production, "fact_production").createOrReplaceTempView("fact_production")
            made = copy(self)
            made._made = {}
            made._made["kept"] = made
            made._project([name for name in PROJECTION if name != "fact_production"])
            self._made["kept"] = made
        return self._made["kept"]

    def narrow(self, columns: list[str], tables: list[str]) -> Plant:
        """These tables alone, over a few columns of production rows that are joined and written once. Other plants keep their views."""
        if "kept" in self._made:
            return self._made["kept"]
        made = copy(self)
        made._made = {}
        try:
            written(self.fact_production.select(*columns), "fact_production").createOrReplaceTempView("fact_production")
            for name in tables:
                self.spark.sql(PROJECTION[name]).createOrReplaceTempView(name)
            made._tables = {name: self.spark.table(name) for name in ["fact_production", *tables]}
        finally:
            for name in ["fact_production", *tables]:
                self._tables[name].createOrReplaceTempView(name)
        return made

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["_tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def ctes() -> str:
    """All projections as the WITH clause of a statement over the raw tables."""
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in PROJECTION.items())
