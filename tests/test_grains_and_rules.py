"""Roll-ups by grouping sets against one by one, and quality rules on planted rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kilnworks.operators import production
from kilnworks.plans import gates, grains
from kilnworks.plans import manufacturing as m
from kilnworks.sources.fixtures import Plant

SF = "/root/testdata/sf0.001"


def test_grains_in_one_pass_equal_grains_one_by_one(spark):
    kpi = production.shift_production_kpi(
        spark.createDataFrame(
            [(1, 1, None, 100, 90, 80, 10, 60, 480.0, 400.0), (1, 1, 7, 100, 95, 80, 15, 60, 480.0, 0.0), (1, None, 7, 10, 0, 0, 0, 60, 0.0, 0.0), (2, 1, 7, 50, 50, 50, 0, 60, 480.0, 480.0)],
            "date_id int, site_id int, line_id int, planned_quantity long, actual_quantity long, good_quantity long, reject_quantity long, nominal_rate long, planned_production_time_min double, operating_time_min double",
        )
    )
    made = production.kpi_rollup(kpi, grains.KPI_GRAINS)
    for grain, keys in grains.KPI_GRAINS.items():
        one = production.kpi_rollup(kpi, keys)
        mine = made.filter(F.col("grain") == grain).select(*one.columns)
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    with pytest.raises(ValueError, match="same keys"):
        production.kpi_rollup(kpi, {"a": ["site_id"], "b": ["site_id"]})


def test_grains_scan_the_facts_once(spark, capsys):
    p = Plant(spark, SF)
    production.kpi_rollup(m.kpi(p), grains.KPI_GRAINS).explain("formatted")
    plan = capsys.readouterr().out
    tree = plan.split("\n\n")[0]
    assert tree.count("Expand") == 1
    assert sum("lineitem.parquet" in line for line in plan.splitlines() if line.startswith("Location")) == 1


def test_rules_count_planted_rows_and_survive_zero_minutes(spark):
    p = Plant(spark, SF)
    tables = p.__dict__["_tables"]
    first = p.fact_production.orderBy("source_record_id").limit(1)
    before = {r.rule_code: (r.evaluated, r.failed) for r in gates.all_rules(p).collect()}
    zero = first.withColumns({"source_record_id": F.lit("zero"), "planned_production_time_min": F.lit(0.0), "operating_time_min": F.lit(0.0)})
    below = first.withColumns({"source_record_id": F.lit("below"), "electricity_kwh": F.lit(-1.0)})
    tables["fact_production"] = p.fact_production.unionByName(zero).unionByName(below)
    good = {
        "event_id": -1, "site_id": 1, "equipment_id": 1, "source_dataset_id": 1, "scenario_source_dataset_id": 2, "condition_score": 1.0, "degradation_index": Decimal(0), "condition_state": "NORMAL", "selected_warning_state": "NONE",
        "selected_warning_horizon_hours": 24, "source_data_origin": "EXTERNAL_REAL", "scenario_type": "SYNTHETIC_ENTERPRISE_ADAPTATION", "transformation_basis": "METROPT_INFORMED", "degradation_signal_origin": "SYNTHETIC_CONTROLLED",
    }
    kind = StructType([StructField(f.name, f.dataType) for f in p.enterprise_telemetry.schema])
    place = p.dim_equipment.filter("equipment_id = 1").join(p.dim_line, "line_id").first()
    stamp = p.enterprise_telemetry.filter("source_event_timestamp < event_timestamp").first()
    good |= {"site_id": place.site_id, "event_timestamp": stamp.event_timestamp, "source_event_timestamp": stamp.source_event_timestamp}
    assert place.equipment_type == gates.TELEMETRY_EQUIPMENT
    planted = [
        good, {**good, "selected_warning_state": None}, {**good, "site_id": place.site_id + 1}, {**good, "equipment_id": 2}, {**good, "scenario_type": None}, {**good, "source_dataset_id": 3},
        {**good, "source_event_timestamp": stamp.event_timestamp},
    ]
    tables["enterprise_telemetry"] = p.enterprise_telemetry.unionByName(spark.createDataFrame([tuple(r[f.name] for f in kind.fields) for r in planted], kind))
    after = {r.rule_code: (r.evaluated, r.failed) for r in gates.all_rules(p).collect()}
    change = {k: (after[k][0] - before[k][0], after[k][1] - before[k][1]) for k in after}
    assert change["ENERGY_POSITIVE"] == (2, 1)
    assert change["PROD_DUP_SOURCE"] == (2, 0)
    assert change["TELEMETRY_REQUIRED_FIELDS_COMPLETE"] == (7, 2)  # the missing state, and the missing scenario type
    assert change["TELEMETRY_ENTERPRISE_MAPPING_VALID"] == (7, 2)  # another site, and equipment of another type
    assert change["TELEMETRY_LINEAGE_VALID"] == (7, 3)  # no scenario type, another dataset, a source time that isn't earlier
