"""Names of the manufacturing queries, each with its Spark plan and its SQL oracle."""

from __future__ import annotations

from kilnworks.plans import gates, grains, landing_checks, manufacturing, modelling, raw_files, reporting, streams  # noqa: F401  (the others register their queries when imported)

QUERIES = dict(manufacturing.QUERIES)
ORACLES = dict(manufacturing.ORACLES)
FLAGSHIP = "v_oee4_site_daily_kpi"
