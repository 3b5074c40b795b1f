"""Documents: statistical cubes from their JSON text, and rows of any schema landed as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CUBE = "id array<string>, size array<int>, dimension map<string, struct<label: string, category: struct<index: string, label: map<string, string>>>>, value string, status string"


def _by_place(text: Column, kind: str) -> Column:
    """A list or an object of flat places as a map from place to value."""
    listed = F.from_json(text, f"array<{kind}>")
    placed = F.map_from_entries(F.transform(listed, lambda x, i: F.struct(i.cast("string"), x)))
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), placed).when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, f"map<string, {kind}>"))


def _codes(category: Column) -> Column:
    """The codes of a dimension in their order: a list, an object of places, or (for a single one) the labels' key."""
    index = category["index"]
    listed = F.when(F.startswith(F.ltrim(index), F.lit("[")), F.from_json(index, "array<string>"))
    placed = F.from_json(index, "map<string, int>")
    ordered = F.transform(F.array_sort(F.transform(F.map_entries(placed), lambda e: F.struct(e["value"], e["key"]))), lambda e: e["key"])
    return F.coalesce(listed, F.when(F.startswith(F.ltrim(index), F.lit("{")), ordered), F.map_keys(category["label"]))


def jsonstat_cells(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """One row for each cell that a JSON-stat document names: codes and labels by dimension, value and status.

    Values and statuses may be lists or objects of flat places (row-major order); one status may hold for all cells. A
    cell with a status and no value has a null value; one that is null and without a status is no cell. Codes without a
    label are their own. A text that isn't JSON, or without dimensions, gives no row. Each document has its own dimensions.
    """
    keep = keep or []
    cube = df.select(*keep, F.from_json(text, _CUBE).alias("c")).filter("c.id is not null and c.size is not null")
    names = F.col("c.id")
    dims = F.transform(names, lambda d: F.col("c.dimension")[d]["category"])
    cube = cube.select(
        *keep,
        names.alias("names"),
        F.col("c.size").alias("sizes"),
        F.transform(dims, _codes).alias("codes"),
        F.transform(dims, lambda c: c["label"]).alias("labels"),
        _by_place(F.col("c.value"), "double").alias("held"),
        _by_place(F.col("c.status"), "string").alias("flags"),
        F.when(~F.startswith(F.ltrim("c.status"), F.lit("[")) & ~F.startswith(F.ltrim("c.status"), F.lit("{")), F.col("c.status")).alias("one"),
    )
    places = F.array_distinct(F.concat(F.coalesce(F.map_keys("held"), F.array().cast("array<string>")), F.coalesce(F.map_keys("flags"), F.array().cast("array<string>"))))
    cells = cube.withColumn("place", F.explode(places))
    cells = cells.withColumns({"value": F.try_element_at("held", F.col("place")), "status": F.coalesce(F.try_element_at("flags", F.col("place")), F.col("one")), "flat": F.col("place").cast("long")})
    cells = cells.filter("value is not null or status is not null")
    after = lambda i: F.aggregate(F.slice("sizes", i + 2, F.size("sizes")), F.lit(1).cast("long"), lambda n, s: n * s)
    at = F.transform("sizes", lambda s, i: F.pmod(F.floor(F.col("flat") / after(i)), s).cast("int"))
    cells = cells.withColumn("at", at)
    code = F.transform("at", lambda a, i: F.get(F.get("codes", i), a))
    cells = cells.withColumn("code", code)
    label = F.transform("code", lambda c, i: F.coalesce(F.try_element_at(F.get("labels", i), c), c))
    return cells.select(*keep, F.map_from_arrays("names", "code").alias("codes"), F.map_from_arrays("names", label).alias("labels"), "value", "status")


def to_variant_rows(frames: dict[str, DataFrame], **lineage: str) -> DataFrame:
    """dataset, lineage literals and `row` (VARIANT) for the rows of tables of any schemas; NaN is null, times are ISO text."""

    def one(name: str, df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)
        clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kind[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns]
        text = F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})
        return df.select(F.lit(name).alias("dataset"), *[F.lit(v).alias(k) for k, v in lineage.items()], F.parse_json(text).alias("row"))

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in frames.items()])


def from_variant_rows(rows: DataFrame, fields: dict[str, str], row: str = "row", keep: list[str] | None = None) -> DataFrame:
    """Typed columns of landed rows: {name: type}; a field that a row lacks, or whose value doesn't fit, is null there."""
    return rows.select(*(keep or []), *[F.try_variant_get(row, f"$.{name}", kind).alias(name) for name, kind in fields.items()])
