"""Guarded ratios and the aggregate measures that hold at any grain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den where den is positive, else null."""
    num, den = col(num), col(den)
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def total(x: str, kind: str = "double") -> Column:
    return F.sum(x).cast(kind)


def share(num: str, den: str) -> Column:
    """A ratio of sums, for use in agg() at any grain."""
    return ratio(F.sum(num), F.sum(den))


def measures() -> dict[str, Column]:
    """Semantic measures over joined shift rows: each is an aggregate and so follows the grouping it is used in."""
    return {
        "planned_units": F.sum("planned_quantity"),
        "actual_units": F.sum("actual_quantity"),
        "good_units": F.sum("good_quantity"),
        "reject_units": F.sum("reject_quantity"),
        "attainment": share("actual_quantity", "planned_quantity"),
        "yield_rate": share("good_quantity", "actual_quantity"),
        "reject_rate": share("reject_quantity", "actual_quantity"),
        "availability": share("operating_time_min", "planned_production_time_min"),
        "performance": ratio(F.sum("actual_quantity"), F.sum(F.col("operating_time_min") / 60 * F.col("nominal_rate"))),
        "electricity_kwh": F.sum("electricity_kwh"),
        "kwh_per_1000": ratio(F.sum("electricity_kwh") * 1000, F.sum("actual_quantity")),
    }


def gold_measures() -> dict[str, Column]:
    """Measures over gold shift rows (losses, money, energy, air), at any grain."""
    money = {"performance_eur": "performance_loss_units", "quality_eur": "quality_loss_units", "planned_downtime_eur": "planned_downtime_loss_units", "unplanned_downtime_eur": "unplanned_downtime_loss_units"}
    units = ["planned_downtime_loss_units", "unplanned_downtime_loss_units", "performance_loss_units", "quality_loss_units", "total_technical_loss_units"]
    return {
        **{u: F.sum(u) for u in units},
        "technical_opportunity_eur": F.sum("total_technical_eur"),
        **{k: F.sum(F.col(u) * F.col("eur_per_unit").cast("double")) for k, u in money.items()},
        "oee": share("operating_time_min", "planned_production_time_min") * ratio(F.sum("actual_quantity"), F.sum(F.col("operating_time_min") / 60 * F.col("nominal_rate"))) * share("good_quantity", "actual_quantity"),
        "line_electricity_kwh": F.sum("electricity_kwh"),
        "kwh_per_1000_good": ratio(F.sum("electricity_kwh") * 1000, F.sum("good_quantity")),
        "idle_kwh": F.sum("idle_kwh"),
        "idle_energy_share": ratio(F.sum("idle_kwh"), F.sum("detail_kwh")),
        "air_nm3": F.sum("compressed_air_nm3"),
        "air_nm3_per_1000": ratio(F.sum("compressed_air_nm3") * 1000, F.sum("actual_quantity")),
    }


def selected(name: str, otherwise: str) -> Column:
    """The only value of a column in the group, or a label where there are several."""
    return F.when(F.countDistinct(name) == 1, F.max(name)).otherwise(otherwise)
