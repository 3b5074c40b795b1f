"""Column names that do not clash with those of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(name: str, df: DataFrame) -> str:
    """name, with as many underscores as make it unlike every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(columns: list[str]) -> Column:
    """The columns as one struct, out of the way of any helper column."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
