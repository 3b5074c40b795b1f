"""Rules on keys, and tables that are made once."""

from pyspark.sql import functions as F

from kilnworks.operators import checks
from kilnworks.plans import gates, landing_checks
from kilnworks.sources import fixtures
from kilnworks.sources.fixtures import Plant

SF = "/root/testdata/sf0.001"


def _found(df):
    return {r.rule_code: (r.evaluated, r.failed) for r in df.collect()}


def test_key_rules_equal_single_rules(spark):
    parent = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), (None,)], "id string")
    one = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "up string")
    two = one.filter("up = 'b'")
    got = _found(checks.key_rules(parent, "id", ["D", "E"], {"ONE": (one, "up"), "TWO": (two, "up"), "NONE": (one.limit(0), "up")}))
    want = {k: v for k, v in _found(checks.duplicate_groups(parent, "D", ["id"])).items()}
    want |= {"E": want["D"]}
    for code, child in {"ONE": one, "TWO": two, "NONE": one.limit(0)}.items():
        want |= _found(checks.orphans(child, code, "up", parent, "id"))
    assert got == want == {"D": (6, 2), "E": (6, 2), "ONE": (5, 3), "TWO": (1, 0), "NONE": (0, 0)}
    assert _found(checks.key_rules(parent.limit(0), "id", ["D"], {"ONE": (one, "up")})) == {"D": (0, 0), "ONE": (5, 5)}


def test_rules_are_evaluated_once_over_production_rows_written_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(gates, "written", lambda df, name, f=gates.written: names.append(name) or f(df, name))
    monkeypatch.setattr(fixtures, "written", lambda df, name, f=fixtures.written: names.append(name) or f(df, name))
    p = Plant(spark, SF)
    plain = p.fact_downtime.agg(F.count("*"), F.sum(F.xxhash64(*p.fact_downtime.columns).cast("decimal(38,0)"))).first()
    assert gates.all_rules(p).count() == gates.all_rules(p).count() == 29
    assert names == ["fact_production", "rules"]
    kept = p.kept().fact_downtime
    assert kept.agg(F.count("*"), F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)"))).first() == plain


def test_repeated_keys_of_a_child(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame([("a",), ("a",), ("c",), (None,), (None,)], "up string")
    got = _found(checks.key_rules(parent, "id", ["D"], {"ONE": (child, "up")}, {"AGAIN": "ONE"}))
    assert got == {"D": (2, 0), "ONE": (5, 3)} | _found(checks.duplicate_groups(child, "AGAIN", ["up"]))


def test_reliability_gate_makes_failure_events_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(gates.m, "events", lambda p, f=gates.m.events: calls.append(1) or f(p))
    assert gates.m.QUERIES["gt13_reliability"](spark, SF).columns == ["gate", "bad_rows"]
    assert len(calls) == 1


def test_manifest_reads_production_rows_written_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(fixtures, "written", lambda df, name, f=fixtures.written: names.append((name, len(df.columns))) or f(df, name))
    p = Plant(spark, SF)
    assert landing_checks.checked(p).count() == 20
    assert names == [("fact_production", 6)]
    assert spark.table("fact_production").columns == p.fact_production.columns  # the views of the plant stand as before
    narrow = p.narrow(["source_record_id", "site_id", "line_id", "equipment_id", "l_linenumber", "timestamp_start"], ["fact_downtime"]).fact_downtime
    assert narrow.exceptAll(p.fact_downtime).count() == p.fact_downtime.exceptAll(narrow).count() == 0
