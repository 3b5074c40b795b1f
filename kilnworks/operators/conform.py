"""Conformed rows: calendars, coded dimensions, facts with guarded rates, derived energy and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.functions.measures import ratio


def blank_to_null(df: DataFrame) -> DataFrame:
    """Text columns trimmed, blank ones null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in texts})


def calendar(facts: DataFrame, ts: str) -> DataFrame:
    """A row for each day from the first to the last of some facts, with ISO week and day, quarter, names and weekend flag."""
    ends = facts.agg(F.to_date(F.min(ts)).alias("first"), F.to_date(F.max(ts)).alias("last")).filter("first IS NOT NULL")
    days = ends.select(F.explode(F.sequence("first", "last")).alias("full_date"))
    iso_day = F.weekday("full_date") + 1
    return days.select(
        "full_date",
        F.date_format("full_date", "yyyyMMdd").cast("int").alias("date_id"),
        F.weekofyear("full_date").alias("iso_week"),
        iso_day.alias("iso_day"),
        F.quarter("full_date").alias("quarter"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.date_format("full_date", "EEEE").alias("day_name"),
        (iso_day >= 6).alias("is_weekend"),
    )


def resolve(facts: DataFrame, dims: dict[str, tuple[DataFrame, list[str], str]]) -> tuple[DataFrame, DataFrame]:
    """Facts with the ids that codes stand for, and the facts of which a code is unknown: name -> (dimension, codes, id).

    Codes are null-safe, and a dimension must hold each once; a fact is never multiplied or lost without a word.
    """
    df = facts
    for name, (dim, codes, key) in dims.items():
        side = dim.select(*[F.col(c).alias(f"_{c}") for c in codes], F.col(key).alias(name)).dropDuplicates([f"_{c}" for c in codes])
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in codes]
        df = df.join(side, on, "left").drop(*[f"_{c}" for c in codes])
    whole = F.lit(True)
    for name in dims:
        whole = whole & F.col(name).isNotNull()
    return df.filter(whole), df.filter(~whole)


def actual_rate(quantity: str, minutes: str) -> Column:
    """Units an hour of operation; null where there was none."""
    return ratio(F.col(quantity), F.col(minutes) / 60)


def demand_kw(kwh: str, hours: Column) -> Column:
    return ratio(F.col(kwh), hours)


def record_id(prefix: str, *parts: str) -> Column:
    """A deterministic id: the prefix and 24 hexadecimal digits of the SHA-1 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 24))


def weather_kw(temperature: str) -> Column:
    """Auxiliary power of cooling above 22 degrees or heating below 5; 0 between them and where no temperature is known."""
    t = F.col(temperature)
    return F.coalesce(F.greatest(3 * (t - 22), 2 * (5 - t), F.lit(0.0)), F.lit(0.0))


def parent_differences(parents: DataFrame, key: str, value: str, children: DataFrame, child_key: str, child_value: Column, tolerance: float = 1e-6) -> DataFrame:
    """Parents whose children do not sum to them; a parent without children counts as 0."""
    sums = children.groupBy(F.col(child_key).alias("_key")).agg(F.sum(child_value).alias("summed"))
    both = parents.join(sums, F.col(key) == F.col("_key"), "left").withColumn("summed", F.coalesce("summed", F.lit(0.0)))
    return both.filter(F.abs(F.col(value) - F.col("summed")) > tolerance).select(key, F.col(value).cast("double").alias("expected"), "summed")


def outside_parent(children: DataFrame, start: str, end: str, parent_start: str, parent_end: str) -> DataFrame:
    """One row: children that begin early, end late, or end before they begin."""
    return children.agg(
        F.count_if(F.col(start) < F.col(parent_start)).alias("early"), F.count_if(F.col(end) > F.col(parent_end)).alias("late"), F.count_if(F.col(end) < F.col(start)).alias("reversed")
    )


def to_reporting_types(df: DataFrame) -> DataFrame:
    """Decimals as doubles; all else, and the order, as it is."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields])


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with their side; repeated rows count."""
    missing, extra = expected.exceptAll(actual), actual.exceptAll(expected)
    return missing.withColumn("side", F.lit("MISSING")).unionByName(extra.withColumn("side", F.lit("EXTRA")))
