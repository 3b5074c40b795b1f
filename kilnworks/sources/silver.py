"""Readers and normalisers from raw files to typed tables, and table-level sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake(name: str) -> str:
    """Lower case with single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", name.strip())).strip("_").lower()


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, nulls: tuple[str, ...] = ("..", "..."), drop_bad: bool = False) -> DataFrame:
    """CSV with a header; the tokens in `nulls` become null in text columns."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c).isin(*nulls), None).otherwise(F.col(c)) for c in text}) if text and nulls else df


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers: one array of doubles for each line."""
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double")).alias("values"))


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(snake, df.columns))


def rename_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def parse_ts(df: DataFrame, column: str, pattern: str, strict: bool = False) -> DataFrame:
    """Text to timestamp; what doesn't parse is an error if strict, else null."""
    made = F.to_timestamp(column, pattern) if strict else F.try_to_timestamp(F.col(column), F.lit(pattern))
    return df.withColumn(column, made)


#: What texts have to look like for a cast to double or float (digits, hexadecimals, infinity, NaN): all that cast, and little else.
FLOAT_LIKE = r"\A[\x00-\x20]*+[+-]?(?:[0-9]*+(?:\.[0-9]*+)?(?:[eE][+-]?[0-9]++)?[dDfF]?|0[xX][0-9a-fA-F.]++[pP][+-]?[0-9]++[dDfF]?|[iI][nN][fF][a-zA-Z]*+|[nN][aA][nN])[\x00-\x20]*+\z"


def cast_text(value: Column, kind: str) -> Column:
    """Text cast to a kind, null where it doesn't cast. Spark throws an exception inside for each text that is no double or float; such texts are told by their look first."""
    made = value.try_cast(kind)
    return F.when(value.rlike(FLOAT_LIKE), made) if kind.strip().lower() in ("double", "float", "real") else made


def parse_shares(df: DataFrame, columns: list[str], kinds: dict[str, str]) -> dict[str, dict[str, float | None]]:
    """For each kind (a name: a Spark type) the share of the known, non-blank values of each column that cast to it; None for a column without any.

    All columns and kinds are one aggregate.
    """
    values = df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(f"_{i}") for i, c in enumerate(columns)])
    value = [F.when(F.col(c) != "", F.col(c)) for c in values.columns]
    asks = [F.count_if(F.col(c) != "").alias(f"known {i}") for i, c in enumerate(values.columns)]
    asks += [F.count(cast_text(v, kind)).alias(f"cast {name} {i}") for name, kind in kinds.items() for i, v in enumerate(value)]
    one = values.agg(*asks).first() if columns else None
    return {name: {c: one[f"cast {name} {i}"] / one[f"known {i}"] if one[f"known {i}"] else None for i, c in enumerate(columns)} for name in kinds}


def promote(df: DataFrame, kinds: dict[str, str], share: float = 0.95) -> DataFrame:
    """Text columns become the first of kinds (by name: a Spark type) that more than `share` of their known values cast to; what doesn't cast is null."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    shares = parse_shares(df, text, kinds)
    chosen = {c: next((kind for name, kind in kinds.items() if (shares[name][c] or 0) > share), None) for c in text}
    return df.withColumns({c: cast_text(F.nullif(F.trim(c), F.lit("")), kind) for c, kind in chosen.items() if kind})


def find_column(df: DataFrame, aliases: list[str], kind: str, share: float = 0.80, taken: tuple[str, ...] = ()) -> str | None:
    """The column that is meant: the first alias that df has (whatever its case or marks); else the one of which most values cast to a kind, if at least `share` do.

    Columns in `taken` are passed over; ties go to the column that stands first.
    """
    left = [c for c in df.columns if c not in taken]
    named = {snake(c): c for c in reversed(left)}
    for alias in aliases:
        if snake(alias) in named:
            return named[snake(alias)]
    shares = parse_shares(df, left, {"k": kind})["k"]
    best = max(left, key=lambda c: shares[c] or 0, default=None)
    return best if best is not None and (shares[best] or 0) >= share else None


def combine_date_time(date: str, time: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(pattern))


def drop_blank(df: DataFrame) -> DataFrame:
    """Without rows and columns that hold nothing."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()  # one row
    return df.dropna(how="all").drop(*[c for c in df.columns if not counts[c]])


def with_lineage(df: DataFrame, file_name: str | None = None, **values: str) -> DataFrame:
    """df with literals, and with the name of the file that a row was read from, if a column for it is named (only right after a read)."""
    made = df.withColumns({k: F.lit(v) for k, v in values.items()}) if values else df
    return made.withColumn(file_name, F.col("_metadata.file_name")) if file_name else made


def recode(column: str, codes: dict) -> Column:
    """Each code's meaning; null for others."""
    return reduce(lambda out, kv: out.when(F.col(column) == kv[0], kv[1]), codes.items(), F.when(F.lit(False), None))


def melt(df: DataFrame, key: str, values: str, hz: float) -> DataFrame:
    """An array of samples as rows of index, value and seconds from the start."""
    return df.select(key, F.posexplode(values).alias("sample_index", "value")).withColumn("seconds_from_start", F.col("sample_index") / hz)


def melt_sensors(df: DataFrame, key: str, sensor: str, values: str, sensors: DataFrame) -> DataFrame:
    """Samples of many sensors as rows, with seconds by the rate of each sensor, and its unit.

    sensors has a row for each sensor: its name, hz and unit. A sensor without one keeps its samples; seconds are null.
    """
    known = F.broadcast(sensors.select(F.col(sensor), F.col("hz").cast("double").alias("hz"), "unit"))  # a row for each sensor
    rows = df.select(key, sensor, F.posexplode(values).alias("sample_index", "value")).join(known, sensor, "left")
    return rows.select(key, sensor, "sample_index", "value", F.try_divide("sample_index", "hz").alias("seconds_from_start"), "unit")


def decode_jsonstat(df: DataFrame, sizes: list[int], codes: list[list[str]], names: list[str], values: str = "values") -> DataFrame:
    """A cube's map from flat index to value as one row for each cell with its codes (row-major order)."""
    cells = df.select(F.explode(values).alias("flat", "value")).withColumn("flat", F.col("flat").cast("long"))
    step = 1
    coordinate = {}
    for name, size, listed in reversed(list(zip(names, sizes, codes, strict=True))):
        at = F.pmod(F.floor(F.col("flat") / step), F.lit(size))
        coordinate[name] = F.get(F.array(*map(F.lit, listed)), at.cast("int"))
        step *= size
    return cells.select(*[coordinate[n].alias(n) for n in names], "value")


# Names under which weather files hold a quantity, and what turns its unit into ours.
WEATHER = {
    "air_temperature_c": (["t2m", "2m_temperature"], lambda c: c - 273.15),
    "dewpoint_temperature_c": (["d2m", "2m_dewpoint_temperature"], lambda c: c - 273.15),
    "surface_pressure_hpa": (["sp", "surface_pressure"], lambda c: c / 100),
    "solar_radiation_wh_m2": (["ssrd", "surface_solar_radiation_downwards"], lambda c: c / 3600),
    "precipitation_mm": (["tp", "total_precipitation"], lambda c: c * 1000),
}
WIND = (["u10", "10m_u_component_of_wind"], ["v10", "10m_v_component_of_wind"])


def standardize_weather(df: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Kelvin to Celsius, Pa to hPa, J to Wh, m to mm, and wind speed from its two parts; with the attributes of sites, if given.

    Each quantity is read from the first of its names that df has; a quantity without any is null.
    """

    def found(names: list[str]) -> Column:
        have = next((c for c in names if c in df.columns), None)
        return F.col(f"`{have}`").cast("double") if have else F.lit(None).cast("double")

    u, v = map(found, WIND)
    made = df.select("site_code", "timestamp_utc", *[change(found(names)).alias(name) for name, (names, change) in WEATHER.items()], F.sqrt(u**2 + v**2).alias("wind_speed_m_s"))
    return made.join(F.broadcast(sites), "site_code", "left") if sites is not None else made  # a row for each site


def shift_of(ts: str) -> tuple[Column, Column]:
    """Shift code and production date of an hour: 06-14 A, 14-22 B, else C; hours before 6 belong to the day before."""
    hour = F.hour(ts)
    code = F.when((hour >= 6) & (hour < 14), "SHIFT-A").when((hour >= 14) & (hour < 22), "SHIFT-B").otherwise("SHIFT-C")
    return code, F.when(hour < 6, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row for each day with its ISO week and weekday."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) calendar_date")
    return days.select(
        F.date_format("calendar_date", "yyyyMMdd").cast("int").alias("date_id"),
        "calendar_date",
        F.year("calendar_date").alias("year"),
        F.quarter("calendar_date").alias("quarter"),
        F.month("calendar_date").alias("month"),
        F.weekofyear("calendar_date").alias("iso_week"),
        (F.weekday("calendar_date") + 1).alias("iso_day"),
        (F.weekday("calendar_date") >= 5).alias("is_weekend"),
    )


def unused(taken: list[str], name: str) -> str:
    """A name that begins with `name` and that no column's name begins with, whatever the case."""
    while any(c.lower().startswith(name) for c in taken):
        name = f"_{name}"
    return name


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """base with the rows of incoming; where a key stands in both, incoming wins, or base if not update.

    A null key equals a null key. Incoming rows that repeat a key have no defined winner: the job fails.
    """
    n = unused(incoming.columns, "n")
    once = F.when(F.col(n) == 1, True).otherwise(F.raise_error("incoming rows repeat a key").cast("boolean"))
    incoming = incoming.withColumn(n, F.count("*").over(Window.partitionBy(*keys))).filter(once).drop(n)
    left, right = (base, incoming) if update else (incoming, base)
    named = right.select(*[F.col(k).alias(f"{unused(left.columns, 'key')}{i}") for i, k in enumerate(keys)])
    same = reduce(lambda x, y: x & y, [left[k].eqNullSafe(named[c]) for k, c in zip(keys, named.columns, strict=True)])
    kept = left.join(named, same, "left_anti")
    return kept.unionByName(incoming) if update else base.unionByName(kept)


def replace_by_source(df: DataFrame, path: str, source: str = "source_dataset_id") -> None:
    """Replaces the partitions of the sources in df; other sources stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("source_row_json"))


def profile(df: DataFrame, ts: str) -> DataFrame:
    """One row: rows, missing cells, repeated rows, first and last time, and least, median and greatest step."""
    day = F.floor(F.col("_t") / 86_400_000_000)
    times = df.filter(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp_ltz")).alias("_t")).distinct().withColumn("_day", day)
    # Steps inside a day, and from each day's last time to the next day's first; only days meet in one task.
    inside = times.select((F.col("_t") - F.lag("_t").over(Window.partitionBy("_day").orderBy("_t"))).alias("_s"))
    days = times.groupBy("_day").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    between = days.select((F.col("lo") - F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("_day"))).alias("_s"))
    steps = inside.union(between).select((F.col("_s") / 1e6).alias("_s"))
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    one = df.agg(F.count("*").alias("rows"), missing.alias("missing_cells"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    repeated = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))
    bounds = steps.agg(F.min("_s").alias("least_step_s"), F.percentile("_s", 0.5).alias("median_step_s"), F.max("_s").alias("most_step_s"))
    return one.crossJoin(F.broadcast(repeated)).crossJoin(F.broadcast(bounds))  # one row each


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, and order-free digests of the whole content: equal tables have equal fingerprints in any order of rows.

    The hash skips nulls, so each column is hashed with a mark that says whether it is null; nested columns as JSON.
    """
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    parts = [(F.col(c).isNull(), F.to_json(c, {"ignoreNullFields": "false"}) if c in nested else F.col(c)) for c in sorted(df.columns)]
    h = F.xxhash64(*[x for pair in parts for x in pair])
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))
