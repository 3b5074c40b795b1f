"""Queries of manifests, documents, readers and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.plans.manufacturing import query
from kilnworks.sources import documents, manifest
from kilnworks.sources.fixtures import Plant

#: The manifest of downtime: its key, its grain, and what its columns hold.
DOWNTIME = manifest.Spec(["source_record_id"], ["production_record_id", "planned_flag"], ["failure_category", "failure_reason"], ["event_start"], ["site_id"], ["duration_min"])


def faulty(p: Plant) -> DataFrame:
    """Downtime with faults in it: repeated rows, unknown categories, lost reasons, longer changeovers."""
    d = p.fact_downtime
    odd = F.col("equipment_id") % 10 == 3
    d = d.withColumns({
        "failure_category": F.when(odd & ~F.col("planned_flag"), "GREMLINS").otherwise(F.col("failure_category")),
        "failure_reason": F.when(F.col("equipment_id") % 10 != 7, F.col("failure_reason")),
        "duration_min": F.when(F.col("planned_flag"), F.col("duration_min") + 1).otherwise(F.col("duration_min")),
    })
    return d.unionByName(d.filter("equipment_id % 10 = 5"))


def checked(p: Plant) -> DataFrame:
    p = p.narrow(["source_record_id", "site_id", "line_id", "equipment_id", "l_linenumber", "timestamp_start"], ["fact_downtime"])
    found = manifest.verify(faulty(p), manifest.describe(p.fact_downtime, DOWNTIME))
    return found.filter(~F.col("check").startswith("digest"))


_FAULTY = """select * from (select * replace (case when equipment_id % 10 = 3 and not planned_flag then 'GREMLINS' else failure_category end as failure_category, case when equipment_id % 10 <> 7 then failure_reason end as failure_reason,
  case when planned_flag then duration_min + 1 else duration_min end as duration_min) from fact_downtime) d"""
_COLUMNS = "source_record_id production_record_id site_id line_id equipment_id planned_flag failure_category failure_reason duration_min event_start event_end".split()
_BAD = f"""fd as ({_FAULTY} union all {_FAULTY} where equipment_id % 10 = 5)"""
_CHECKS = " union all ".join(
    [
        "select 'columns' as \"check\", '' item, 0.0 bad",
        "select 'rows', '', abs((select count(*) from fd) - (select count(*) from fact_downtime))",
        "select 'key', 'source_record_id', (select count(*) - count(distinct source_record_id) from fd)",
        "select 'grain', 'production_record_id,planned_flag', (select count(*) - (select count(*) from (select distinct production_record_id, planned_flag from fd)) from fd)",
        *[f"select 'nulls', '{c}', abs((select count(*) filter ({c} is null) from fd) - (select count(*) filter ({c} is null) from fact_downtime))" for c in _COLUMNS],
        *[
            f"""select 'coverage', '{c}', (select count(*) from (select distinct {c} v from fd where {c} is not null except select distinct {c} from fact_downtime))
  + (select count(*) from (select distinct {c} v from fact_downtime where {c} is not null except select distinct {c} from fd))"""
            for c in ("failure_category", "failure_reason")
        ],
        "select 'range', 'event_start', (select cast(min(event_start) <> (select min(event_start) from fact_downtime) as int) + cast(max(event_start) <> (select max(event_start) from fact_downtime) as int) from fd)",
        "select 'constant', 'site_id', (select count(*) from fd where site_id is distinct from (select min(cast(site_id as varchar)) from fact_downtime)::int)",
        "select 'total', 'duration_min', abs((select sum(duration_min) from fd) - (select sum(duration_min) from fact_downtime))",
    ]
)
query("src25_manifest", "check item bad~ ok", f"with {_BAD} select \"check\", item, cast(bad as double) bad, bad = 0 ok from ({_CHECKS}) c")(checked)


def cubes(p: Plant) -> DataFrame:
    """A JSON-stat document for each site: electricity by line and quarter, sparse, with a status for the small cells."""
    cells = p.fact_production.groupBy("site_id", "line_id", F.concat(F.lit("Q"), F.quarter("timestamp_start")).alias("quarter")).agg(F.sum("electricity_kwh").alias("kwh"))
    lines = p.dim_line.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "line_name"))).alias("lines"))  # a few lines for each site
    cells = cells.join(lines, "site_id")
    quarter = F.substring("quarter", 2, 1).cast("int") - 1
    place = ((F.array_position(F.transform("lines", lambda x: x["line_id"]), F.col("line_id")) - 1) * 4 + quarter).cast("string")
    by_site = cells.groupBy("site_id", "lines").agg(
        F.map_from_entries(F.collect_list(F.struct(place, F.when(F.col("kwh") >= SMALL, F.col("kwh"))))).alias("value"),
        F.map_from_entries(F.collect_list(F.when(F.col("kwh") < SMALL, F.struct(place, F.lit("c"))))).alias("status"),
    )  # four cells for each line
    code = lambda x: F.concat(F.lit("L"), x["line_id"])
    return by_site.select(
        "site_id",
        F.to_json(
            F.struct(
                F.array(F.lit("line"), F.lit("quarter")).alias("id"),
                F.array(F.size("lines"), F.lit(4)).alias("size"),
                F.struct(
                    F.struct(F.struct(F.transform("lines", code).alias("index"), F.map_from_entries(F.transform("lines", lambda x: F.struct(code(x), x["line_name"]))).alias("label")).alias("category")).alias("line"),
                    F.struct(F.struct(F.create_map(*[y for k in range(4) for y in (F.lit(f"Q{k + 1}"), F.lit(k))]).alias("index")).alias("category")).alias("quarter"),
                ).alias("dimension"),
                F.map_filter("value", lambda k, v: v.isNotNull()).alias("value"),
                "status",
            )
        ).alias("document"),
    )


SMALL = 20_000
query(
    "src4_jsonstat_cells",
    "site_id line line_name quarter value~ status",
    f"""select site_id, concat('L', line_id) as line, line_name, quarter, case when kwh >= {SMALL} then kwh end as value, case when kwh < {SMALL} then 'c' end status
  from (select site_id, line_id, concat('Q', quarter(timestamp_start)) as quarter, sum(electricity_kwh) kwh from fact_production group by all) c join dim_line l using (line_id, site_id)""",
)(
    lambda p: documents.jsonstat_cells(cubes(p), "document", ["site_id"]).select(
        "site_id", F.col("codes")["line"].alias("line"), F.col("labels")["line"].alias("line_name"), F.col("codes")["quarter"].alias("quarter"), "value", "status"
    )
)


def landed(p: Plant) -> DataFrame:
    """Rows of three tables of unlike schemas in one table, read back by field."""
    odd = p.fact_line_energy_detail.withColumn("compressed_air_nm3", F.when(F.col("line_id") % 2 == 0, F.col("compressed_air_nm3")).otherwise(F.lit(float("nan"))))
    frames = {"downtime": p.fact_downtime, "energy": odd, "equipment": p.dim_equipment}
    rows = documents.to_variant_rows(frames, origin="EXTERNAL")
    typed = documents.from_variant_rows(rows, {"site_id": "int", "duration_min": "double", "compressed_air_nm3": "double", "equipment_type": "string", "event_start": "timestamp_ntz"}, keep=["dataset", "origin"])
    return typed.groupBy("dataset", "origin", "site_id", "equipment_type").agg(F.count("*").alias("n"), F.sum("duration_min").alias("minutes"), F.count("compressed_air_nm3").alias("known_air"), F.sum("compressed_air_nm3").alias("air"), F.min("event_start").alias("first"))


query(
    "src18_variant_rows",
    "dataset origin site_id equipment_type n minutes~ known_air air~ first",
    """select 'downtime' dataset, 'EXTERNAL' origin, site_id, null equipment_type, count(*) n, sum(duration_min) as minutes, 0 known_air, cast(null as double) air, min(event_start) as first from fact_downtime group by site_id
  union all select 'energy', 'EXTERNAL', site_id, null, count(*), null, count(*) filter (compressed_air_nm3 is not null and line_id % 2 = 0), sum(compressed_air_nm3) filter (line_id % 2 = 0), null from fact_line_energy_detail group by site_id
  union all select 'equipment', 'EXTERNAL', null, equipment_type, count(*), null, 0, null, null from dim_equipment group by equipment_type""",
)(landed)
