"""Manifests: a right table fits, each planted fault is told by its own statement, and digests name the part."""

import json

import pytest
from pyspark.sql import functions as F

from kilnworks.sources import manifest

KIND = "id long, day date, site string, origin string, units long, kwh double, tags array<string>"
SPEC = manifest.Spec(["id"], ["day", "site"], ["site"], ["day"], ["origin"], ["units", "kwh"])


@pytest.fixture
def table(spark):
    rows = spark.range(200).select(
        "id", F.expr("date_add(date'2024-01-01', int(id div 4))").alias("day"), F.concat(F.lit("S"), F.col("id") % 4).alias("site"), F.lit("REAL").alias("origin"), (F.col("id") * 3).alias("units"),
        (F.col("id") / 7).alias("kwh"), F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, "b")).alias("tags"),
    )
    return rows.select([F.col(c.split()[0]) for c in KIND.split(", ")])


def broken(df, made):
    return {(r.check, r.item): r.bad for r in manifest.verify(df, made).collect() if not r.ok}


def test_a_right_table_fits_in_any_order_and_layout(table):
    made = json.loads(json.dumps(manifest.describe(table, SPEC)))
    assert broken(table.orderBy(F.desc("kwh")).repartition(7), made) == {}
    assert len(made["digests"]) <= manifest.PARTS and sum(d[0] for d in made["digests"].values()) == 200


def test_each_fault_is_told(table, spark):
    made = manifest.describe(table, SPEC)
    at = lambda c, value, where="id = 8": table.withColumn(c, F.when(F.expr(where), value).otherwise(F.col(c)))
    without = lambda found: {k: v for k, v in found.items() if not k[0].startswith("digest")}
    assert without(broken(at("site", F.lit(None)), made)) == {("nulls", "site"): 1}  # its grain is still its own
    assert without(broken(at("site", F.lit("S9")), made)) == {("coverage", "site"): 1}
    assert without(broken(at("day", F.lit("2023-12-31").cast("date")), made)) == {("range", "day"): 1}
    assert without(broken(at("origin", F.lit("FAKE")), made)) == {("constant", "origin"): 1}
    assert without(broken(at("units", F.col("units") + 5), made)) == {("total", "units"): 5}
    assert without(broken(at("kwh", F.col("kwh") + 0.5), made)) == {("total", "kwh"): 0.5}
    assert without(broken(at("id", F.lit(9).cast("long")), made)) == {("key", "id"): 1}
    assert without(broken(at("day", F.lit("2024-01-01").cast("date")), made)) == {("grain", "day,site"): 1}
    again = without(broken(table.union(table.filter("id = 0")), made))
    assert again == {("rows", ""): 1, ("key", "id"): 1, ("grain", "day,site"): 1}
    assert without(broken(table.withColumn("units", F.col("units").cast("int")), made)) == {("columns", ""): 1}
    lost = broken(table.drop("origin"), made)
    assert lost["constant", "origin"] is None and lost["nulls", "origin"] is None and lost["columns", ""] == 4
    assert broken(table.drop("id"), made)["key", "id"] is None
    assert set(without(broken(table.limit(0), made))) >= {("rows", ""), ("coverage", "site"), ("range", "day"), ("total", "units")}


def test_digests_name_the_part_that_differs(table):
    made = manifest.describe(table, SPEC)
    swapped = table.withColumn("tags", F.when(F.col("id") == 8, F.array(F.lit("a"), F.lit(None))).otherwise(F.col("tags")))
    part = table.filter("id = 8").select(F.pmod(F.xxhash64("id"), F.lit(manifest.PARTS))).first()[0]
    assert broken(swapped, made) == {("digest", ""): 1, ("digest of part", str(part)): 1}
    halves = [manifest.digests(table.filter(f"id % 2 = {k}"), ["id"]).collect() for k in (0, 1)]
    whole = {r.part: (r.rows, r.xor, r.total) for r in manifest.digests(table, ["id"]).collect()}
    merged = {}
    for r in [*halves[0], *halves[1]]:
        n, x, t = merged.get(r.part, (0, 0, 0))
        merged[r.part] = (n + r.rows, x ^ r.xor, t + r.total)
    assert merged == whole


def test_a_manifest_takes_one_pass_and_its_check_two(table, monkeypatch):
    passes, collect = [], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda df: passes.append(df) or collect(df))
    made = manifest.describe(table, SPEC)
    assert len(passes) == 1 and made["constants"] == {"origin": "REAL"}
    found = manifest.verify(table.union(table.filter("id < 8")), made)
    assert len(passes) == 3
    assert {(r.check, r.item): r.bad for r in found.collect() if not r.ok and r.check in ("key", "grain")} == {("key", "id"): 8, ("grain", "day,site"): 8}


def test_sets_bounds_and_keys_of_odd_values(spark):
    rows = [(None, 1, "b", 2.0), (None, 1, None, 0.25), (1, None, "é", None), (1, None, "a", float("nan")), (2, None, "B", -0.0), (2, 1, "", 0.0)]
    df = spark.createDataFrame(rows, "a int, b int, t string, x double")
    made = manifest.describe(df, manifest.Spec(["a", "b"], ["x"], ["t"], ["t", "x"], ["b"], ["a"]))
    assert made["coverage"]["t"] == ["", "B", "a", "b", "é"] and made["ranges"]["t"] == ["", "é"]
    assert made["ranges"]["x"][0] in ("0.0", "-0.0") and made["ranges"]["x"][1] == "NaN"
    assert made["totals"] == {"a": "6.000000"} and made["constants"] == {"b": "1"} and sum(d[0] for d in made["digests"].values()) == 6
    assert made["digests"] == {str(r.part): [r.rows, str(r.xor), str(r.total)] for r in manifest.digests(df, ["a", "b"]).collect()}
    assert broken(df, made) == {("key", "a,b"): 2, ("grain", "x"): 1, ("constant", "b"): 3}  # nulls are equal, and so are the zeros
    assert manifest.describe(df.limit(0), manifest.Spec(["a"], [], ["t"], ["t", "x"], ["b"], ["a"])) | {"columns": []} == {
        "columns": [], "rows": 0, "key": ["a"], "grain": [], "nulls": dict.fromkeys("abtx", 0), "coverage": {"t": []}, "ranges": {"t": [None, None], "x": [None, None]},
        "constants": {"b": None}, "totals": {"a": None}, "digests": {}, "parts": manifest.PARTS,
    }
