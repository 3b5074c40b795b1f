"""Checks and combinations on the way from raw tables to facts: acceptance counts, positional files, replaced datasets."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.sources.silver import unused


def select_prices(df: DataFrame, geos: list[str], years: list[int], periods_a_year: int = 2, **lineage: str) -> DataFrame:
    """Observations of the given areas and years with lineage literals; fails where any area lacks a period."""
    rows = df.filter(F.col("geo_code").isin(geos) & F.substring("period_code", 1, 4).isin([str(y) for y in years]))
    want = len(set(geos)) * len(set(years)) * periods_a_year
    have = rows.agg(F.countDistinct("geo_code", "period_code").alias("have"))
    checked = rows.crossJoin(F.broadcast(have)).filter(F.when(F.col("have") == want, True).otherwise(F.raise_error(F.lit(f"prices do not cover {want} periods")).cast("boolean"))).drop("have")  # one row
    return checked.withColumns({k: F.lit(v) for k, v in lineage.items()})


def cast_columns(df: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """The columns that df has of {raw name: (new name, type)}; values that don't cast are null."""
    return df.select(*[F.col(raw).try_cast(kind).alias(new) for raw, (new, kind) in names.items() if raw in df.columns])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with the position of each row (from 0) in the order in which Spark reads it.

    Rows are counted by partition, and each partition is shifted by the rows of those before it; the window holds one
    row for each partition. The input must read alike each time, as files do.
    """
    part, row = unused(df.columns, "part"), unused(df.columns, "row")
    placed = df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(part, before.alias(name))
    return placed.join(F.broadcast(shifts), part).withColumn(name, F.col(name) + F.col(row)).drop(part, row)


def format_id(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """df with a text id from the position of each row (from 1), such as 'UNIT-%06d'."""
    at = unused(df.columns, "at")
    return numbered(df, at).withColumn(name, F.format_string(pattern, F.col(at) + 1)).drop(at)


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two positional tables side by side; tables of unlike length fail the job."""
    at = unused([*left.columns, *right.columns], "at")
    both = numbered(left, at).withColumn(f"{at}l", F.lit(True)).join(numbered(right, at).withColumn(f"{at}r", F.lit(True)), at, "full")
    even = F.when(F.col(f"{at}l") & F.col(f"{at}r"), True).otherwise(F.raise_error(F.lit("tables of unlike length")).cast("boolean"))
    return both.filter(even).drop(f"{at}l", f"{at}r", at)


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of all frames by key; of a column that several frames have, the first known value stays."""

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        twice = [c for c in b.columns if c in a.columns and c not in keys]
        named = {c: f"{unused([*a.columns, *b.columns], 'again')}{i}" for i, c in enumerate(twice)}
        both = a.join(b.withColumnsRenamed(named), keys, "full")
        return both.withColumns({c: F.coalesce(c, n) for c, n in named.items()}).drop(*named.values()) if twice else both

    return reduce(merge, frames)


def replace_dataset(df: DataFrame, path: str) -> None:
    """df in place of the dataset at path: written beside it, then swapped by renames; on a failure the old one is back."""
    spark = df.sparkSession
    jvm = spark._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid4().hex}" for kind in ("staged", "old"))
    df.write.parquet(staged)
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not files.rename(at(staged), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"{staged} can't take the place of {path}")
    if had:
        files.delete(at(old), True)


def expect(df: DataFrame, required: list[str], domains: dict[str, list] | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """check, found and ok: missing columns, rows within bounds, and values outside the domain of a column."""
    spark, missing = df.sparkSession, sorted(set(required) - set(df.columns))
    known = {c: v for c, v in (domains or {}).items() if c in df.columns}
    outside = [F.count_if(~F.coalesce(F.col(c).isin(v), F.lit(False))).alias(f"{c} outside its domain") for c, v in known.items()]
    one = df.agg(F.count("*").alias("rows"), *outside)
    names = one.columns
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("found")) for n in names])
    rows = one.select(F.explode(pairs).alias("c")).select("c.*")
    fits = F.when(F.col("check") == "rows", (F.col("found") >= least) & (F.lit(most is None) | (F.col("found") <= F.lit(most or 0)))).otherwise(F.col("found") == 0)
    columns = spark.range(1).select(F.lit("missing columns").alias("check"), F.lit(len(missing)).cast("long").alias("found"))
    return rows.unionByName(columns).withColumn("ok", F.coalesce(fits, F.lit(False)))


def violations(df: DataFrame, rules: dict[str, Column], grain: list[str]) -> DataFrame:
    """rule and bad: rows that break each rule (null counts as broken), and rows that repeat the grain."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("bad")) for n in rules])).alias("c")).select("c.*")
    again = df.groupBy(*grain).agg(F.count("*").alias("n")).agg(F.lit("repeated").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad"))
    return rows.unionByName(again)


def energy_rules(tolerance: float = 1e-6) -> tuple[dict[str, Column], dict[str, Column]]:
    """The identities of line energy and of site energy, for `violations`."""
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b))
    c = F.col
    line = {
        "parts make the total": near(c("line_production_electricity_kwh") + c("line_idle_electricity_kwh"), c("line_total_electricity_kwh")),
        "no negative energy": F.least("line_production_electricity_kwh", "line_idle_electricity_kwh") >= 0,
        "keys are known": c("site_id").isNotNull() & c("line_id").isNotNull() & c("date_id").isNotNull(),
    }
    site = {
        "lines and auxiliaries make the total": near(c("line_electricity_kwh") + c("site_auxiliary_electricity_kwh"), c("site_total_electricity_kwh")),
        "power times hours": near((c("site_auxiliary_base_kw") + c("site_weather_auxiliary_kw")) * c("shift_hours"), c("site_auxiliary_electricity_kwh")),
        "units are positive": c("production_units") > 0,
    }
    return line, site


def areas(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """Area dimension: blank codes are null, sites by their natural key, production areas are those with a line."""
    tidy = lines.withColumn("line_code", F.nullif(F.trim("line_code"), F.lit("")))
    kind = F.when(F.col("line_code").isNotNull(), "PRODUCTION").otherwise("UTILITY")
    return tidy.join(sites.select("site_code", "site_id"), "site_code", "left").withColumn("area_type", kind)


def read_zipped(spark: SparkSession, features: str, labels: str, read) -> DataFrame:
    """Two positional files read by `read(spark, path)`, side by side."""
    return zip_rows(read(spark, features), read(spark, labels))
