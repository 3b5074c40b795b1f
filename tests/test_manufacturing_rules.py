"""Data quality rules and the failure Pareto on hand-made rows, bad ones among them."""

import datetime as dt
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import checks, control, production
from kilnworks.plans import manufacturing
from kilnworks.sources.fixtures import Plant

SF = Path("/root/testdata/sf0.001")
START = dt.datetime(1996, 1, 1, 6)
PRODUCTION = "source_record_id string, timestamp_start timestamp_ntz, line_id int, actual_quantity long, good_quantity long, reject_quantity long, operating_time_min double, planned_production_time_min double, electricity_kwh double"


def plant(spark, made, quality):
    return SimpleNamespace(
        fact_production=spark.createDataFrame([(k, START, 1, 100 + rejects, 100, rejects, 400.0, 480.0, kwh) for k, rejects, kwh in made], PRODUCTION),
        fact_downtime=spark.createDataFrame([(f"{k}-P", k) for k, _, _ in made], "source_record_id string, production_record_id string"),
        fact_quality=spark.createDataFrame(quality, "source_record_id string, production_record_id string"),
        telemetry=spark.createDataFrame([(1, START)], "equipment_id int, event_timestamp timestamp_ntz"),
    )


def test_clean_rows_pass_every_rule(spark):
    res = manufacturing.rules(plant(spark, [("a", 1, 12.5), ("b", 100, 2000.0), ("c", 300, 5000.0)], [("a-Q1", "a"), ("b-Q1", "b"), ("c-Q1", "c")]))
    assert {r.status for r in res.collect()} == {"PASS"}
    one = checks.summary(res).first()
    assert (one["rules"], one["pass"], one["warn"], one["fail"], one["score"]) == (9, 9, 0, 0, 1.0)


def test_injected_bad_rows_fail(spark):
    made = [("a", 1, 12.5), ("b", 100, 0.0), ("c", 300, -1.0), ("d", 5, None)]
    quality = [("a-Q1", "a"), ("b-Q1", "b"), ("x-Q1", "x"), ("n-Q1", None)]
    res = manufacturing.rules(plant(spark, made, quality))
    got = {r.rule_code: (r.evaluated, r.failed, r.status) for r in res.collect()}
    assert got.pop("ENERGY_POSITIVE") == (4, 2, "WARN") and got.pop("QUALITY_LINEAGE") == (4, 2, "FAIL")
    assert all(failed == 0 and status == "PASS" for _, failed, status in got.values())
    one = checks.summary(res).first()
    assert (one["warn"], one["fail"], one["score"]) == (1, 1, pytest.approx(1 - 4 / sum([4, 4, 4, 4, 4, 4, 1, 4, 4])))


def test_failure_pareto_counts_downtime_without_work_orders(spark):
    rows = [("1", 1, "jam", False, 60.0), ("2", 1, "leak", False, 180.0), ("3", 1, "leak", False, 60.0), ("4", 1, "clean", True, 30.0), ("5", 2, "jam", True, 10.0)]
    down = spark.createDataFrame(
        [(k, f"p{k}", site, 1, 7, "MECHANICAL", reason, START, planned, m) for k, site, reason, planned, m in rows],
        "source_record_id string, production_record_id string, site_id int, line_id int, equipment_id long, failure_category string, failure_reason string, event_start timestamp_ntz, planned_flag boolean, duration_min double",
    )
    orders = [("1", False, 0.5), ("1", False, 0.2), ("4", False, 0.1), ("2", True, 0.1)]
    work = spark.createDataFrame([(k, planned, START, h, 1.0) for k, planned, h in orders], "downtime_event_id string, planned_flag boolean, start_timestamp timestamp_ntz, duration_hours double, total_cost double")
    events = control.failure_event(work, down)
    made = production.pareto(control.failure_downtime(down, events), ["site_id"], "downtime_hours", ["failure_reason"])
    got = {(r.site_id, r.failure_reason): (r.event_count, r.unplanned_count, r.linked_count, r.downtime_hours, r.linked_hours, r.share, r.cumulative_share, r.pareto_rank) for r in made.collect()}
    assert got == {(1, "leak"): (2, 2, 0, 4.0, None, 0.8, 0.8, 1), (1, "jam"): (1, 1, 1, 1.0, 1.0, 0.2, 1.0, 2), (1, "clean"): (1, 0, 0, None, None, None, 1.0, 3), (2, "jam"): (1, 0, 0, None, None, None, None, 1)}


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_failure_pareto_holds_all_unplanned_downtime(spark):
    p = Plant(spark, str(SF))
    got = manufacturing.QUERIES["v_rel5_failure_pareto"](spark, str(SF)).agg(F.sum("event_count"), F.sum("unplanned_count"), F.sum("linked_count"), F.sum("downtime_hours")).first()
    want = p.fact_downtime.agg(F.count("*"), F.count_if(~F.col("planned_flag")), F.sum(F.when(~F.col("planned_flag"), F.col("duration_min") / 60))).first()
    linked = manufacturing.QUERIES["v_rel2_failure_event"](spark, str(SF)).count()
    assert tuple(got) == (want[0], want[1], linked, pytest.approx(want[2])) and 0 < linked < want[1]
