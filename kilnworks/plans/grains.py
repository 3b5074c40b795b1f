"""Roll-ups of all grains in one pass, by grouping sets, beside the queries of each grain."""

from __future__ import annotations

from kilnworks.operators import energy, production
from kilnworks.plans import manufacturing as m
from kilnworks.plans.manufacturing import query

KPI_GRAINS = {"line_day": ["date_id", "site_id", "line_id"], "site_day": ["date_id", "site_id"], "line": ["site_id", "line_id"]}
LOSS_GRAINS = {"line_day": ["date_id", "site_id", "line_id"], "site_day": ["date_id", "site_id"], "site": ["site_id"]}
ENERGY_GRAINS = {"line_day": ["date_id", "site_id", "line_id"], "site_day": ["date_id", "site_id"], "line": ["site_id", "line_id"], "site": ["site_id"]}


def _union(grains: dict[str, list[str]], columns: str, one) -> str:
    """The separate statements of all grains, put together."""
    every = list(dict.fromkeys(k for own in grains.values() for k in own))
    names = ", ".join(f'"{c.rstrip("~")}"' for c in columns.split())
    return " union all ".join(f"select '{g}' grain, {', '.join(k if k in own else f'null {k}' for k in every)}, {names} from ({one(', '.join(own))}) g" for g, own in grains.items())


_ENERGY = f"electricity_kwh~ {m.ENERGY}"
_LOSS = f"good_quantity {m.ACC}"
_sums = ", ".join(f"sum({c}) {c}" for c in production.LOSSES)
_loss = lambda keys: f"select {keys}, {m._bigs('good_quantity')}, {_sums}, sum(good_quantity) / sum(theoretical_capacity_units) technical_output_efficiency from acc group by {keys}"
query("kpi_all_grains", f"grain date_id site_id line_id {m.ROLL}", _union(KPI_GRAINS, m.ROLL, m._roll_sql))(lambda p: production.kpi_rollup(m.kpi(p), KPI_GRAINS))
query("loss_all_grains", f"grain date_id site_id line_id {_LOSS}", _union(LOSS_GRAINS, _LOSS, _loss))(lambda p: production.loss_rollup(m.accounting(p), LOSS_GRAINS))
query("energy_all_grains", f"grain date_id site_id line_id {_ENERGY}", _union(ENERGY_GRAINS, _ENERGY, m._energy_sql))(lambda p: energy.energy_rollup(energy.shift_energy_kpi(p.fact_production), ENERGY_GRAINS))
