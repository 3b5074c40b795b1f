"""Alert policies: failure windows from raw columns, grids of policies judged on failures, and a condition scenario.

Grids are small and fixed; rows are multiplied by the number of policies and aggregated by policy at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.operators.blocks import in_blocks, trailing_quantiles
from kilnworks.operators.control import HOUR, seconds
from kilnworks.operators.telemetry import near_windows
from kilnworks.sources.silver import find_column

# The grid that is compared, and the alert budget a policy has to keep.
QUANTILES = (0.985, 0.990, 0.9925, 0.995)
PERSISTENCE = ((2, 3), (3, 4))
FALSE_PER_DAY, ALERT_PCT = 0.50, 3.00
# Fixed values of the condition scenario.
PRECURSOR_HOURS, YEARS_LATER = 6.0, 4
OFFSETS = {"reservoir_pressure": -0.60, "oil_temperature": 6.0, "motor_current": 10.0}
#: Scores this little below a limit reach it, so that the last bit of an interpolated quantile decides nothing.
TOLERANCE = 1e-9
POLICY = ["quantile", "required", "window"]


def parse_windows(df: DataFrame, starts: list[str], ends: list[str]) -> DataFrame:
    """failure_start and failure_end from the first known of the candidate columns.

    Reversed windows are turned round, those without both ends go. Candidates that df lacks are passed over; if it has
    none of a list, that is an error.
    """
    have = set(df.columns)
    a, b = ([F.col(c).cast("timestamp_ntz") for c in names if c in have] for names in (starts, ends))
    if not a or not b:
        raise ValueError(f"none of {starts if not a else ends} is a column")
    begin, end = F.coalesce(*a), F.coalesce(*b)
    return df.filter(begin.isNotNull() & end.isNotNull()).withColumns({"failure_start": F.least(begin, end), "failure_end": F.greatest(begin, end)})


def infer_windows(df: DataFrame, starts: list[str], ends: list[str], share: float = 0.80) -> DataFrame:
    """parse_windows on a table whose columns may have other names: the start is the first known name, else the column of which most values are times, the end likewise among the others."""
    start = find_column(df, starts, "timestamp_ntz", share)
    end = find_column(df, ends, "timestamp_ntz", share, taken=(start,) if start else ())
    if start is None or end is None:
        raise ValueError(f"no column holds times for {starts if start is None else ends}")
    text = df.select(*[F.col(f"`{c}`").cast("string").try_cast("timestamp_ntz").alias(c) if c in (start, end) else F.col(f"`{c}`") for c in df.columns])
    return parse_windows(text, [start], [end])


def grid_alerts(
    df: DataFrame, entity: str, ts: str, score: str, quantiles: tuple = QUANTILES, persistence: tuple = PERSISTENCE, lag: int = 288, lookback: int = 2016, least: int = 864
) -> DataFrame:
    """alert and start of each row under each policy: k of n scores at or over a lagged trailing quantile."""
    limited = trailing_quantiles(df, entity, ts, score, list(quantiles), lag, lookback, least, "limits")
    grid = [F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("quantile"), F.lit(k).alias("required"), F.lit(n).alias("window")) for i, q in enumerate(quantiles) for k, n in persistence]
    sizes = sorted({n for _, n in persistence})

    def judged(rows: DataFrame, keys: list[str]) -> DataFrame:
        each = rows.withColumn("p", F.explode(F.array(*grid))).withColumns({"limit": F.get("limits", F.col("p.i"))} | {c: F.col(f"p.{c}") for c in POLICY}).drop("p", "limits")
        hot = each.withColumn("hot", F.coalesce(F.col(score) >= F.col("limit") - TOLERANCE, F.lit(False)))
        return with_persistence(hot, [*keys, *POLICY], ts, "hot", sizes)

    return in_blocks(limited, entity, ts, max(sizes), judged)


def with_persistence(df: DataFrame, keys: list[str], ts: str, hot: str, windows: list[int]) -> DataFrame:
    """alert where `required` of the last `window` rows (both columns) are hot, and start of each run of alerts."""
    order = Window.partitionBy(*keys).orderBy(ts)

    def met(n: int) -> Column:
        frame = order.rowsBetween(-(n - 1), 0)
        return (F.sum(F.col(hot).cast("int")).over(frame) >= F.col("required")) & (F.count(F.lit(1)).over(frame) == n)

    alert = reduce(lambda out, n: out.when(F.col("window") == n, met(n)), windows[1:], F.when(F.col("window") == windows[0], met(windows[0])))
    return df.withColumn("alert", alert).withColumn("start", F.col("alert") & ~F.coalesce(F.lag("alert").over(order), F.lit(False)))


def judge(alerts: DataFrame, ts: str, keys: list[str], windows: DataFrame, horizon_h: Column | float, early_h: float = 2.0) -> DataFrame:
    """By policy (keys): failures, those detected in [s - horizon, e], early ones, median lead, false starts and burden.

    horizon_h is a number, or a column of windows that is one of keys too.
    """
    t = seconds(F.col(ts))
    h = F.lit(horizon_h) if isinstance(horizon_h, (int, float)) else horizon_h
    bounds = windows.select("failure_id", seconds(F.col("failure_start")).alias("_s"), seconds(F.col("failure_end")).alias("_e"))
    near = lambda rows, how: near_windows(rows, t, bounds, F.col("_s") - h * HOUR, F.col("_e"), how)
    first = near(alerts.filter("alert").select(ts, *keys), "inner").groupBy(*keys, "failure_id", "_s").agg(F.min(t).alias("_t"))
    lead = (F.col("_s") - F.col("_t")) / HOUR
    found = first.groupBy(*keys).agg(F.count("*").alias("detected"), F.count_if(lead >= early_h).alias("early"), F.median(lead).alias("median_lead_h"))
    false = near(alerts.filter("start").select(ts, *keys), "left").groupBy(*keys).agg(F.count_if(F.col("failure_id").isNull()).alias("false_alerts"))
    days = F.greatest((F.max(t) - F.min(t)) / 86400, F.lit(1e-9))
    base = alerts.groupBy(*keys).agg(days.alias("days"), (100 * F.avg(F.col("alert").cast("int"))).alias("alert_pct"))
    made = base.join(found, keys, "left").join(false, keys, "left").na.fill(0, ["detected", "early", "false_alerts"])
    return made.crossJoin(F.broadcast(windows.agg(F.count("*").alias("events")))).withColumn("false_per_day", F.col("false_alerts") / F.col("days"))  # one row


def choose(judged: DataFrame, ties: list[str] = POLICY, false_per_day: float = FALSE_PER_DAY, alert_pct: float = ALERT_PCT) -> DataFrame:
    """Marks the policies within budget and the selected one: the best within budget, or the least burden if none is.

    Its windows hold one row for each policy of the grid.
    """
    within = (F.col("false_per_day") <= false_per_day) & (F.col("alert_pct") <= alert_pct)
    rows = judged.withColumn("within_budget", within)
    some = F.max("within_budget").over(Window.partitionBy(F.lit(0)))
    burden, gain = ["false_per_day", "alert_pct"], [-F.col("early"), -F.col("detected")]
    order = [F.desc("within_budget"), *[F.when(F.col("_some"), c) for c in gain], *burden, *gain, *ties]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.withColumn("_some", some).withColumn("is_selected", place == 1).drop("_some")


def policy_kpi(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of judged policies from several splits or scenarios."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in parts.items()])


def selected_kpi(kpi: DataFrame) -> DataFrame:
    """The selected policy with its success rate, as reports show it."""
    return kpi.filter("is_selected").select("split", *POLICY, F.col("events").alias("events_evaluated"), F.col("detected").alias("events_warned"), (F.col("events") - F.col("detected")).alias("events_missed"), F.try_divide("detected", "events").alias("warning_success_rate"), "false_alerts", "false_per_day")


def condition_scenario(df: DataFrame, ts: str, score: str, windows: DataFrame, signals: dict[str, str]) -> DataFrame:
    """Degradation towards the next failure, shifted signals, condition score and state, at times some years later.

    signals maps a name in OFFSETS to a column. Of several failures at once the latest to start counts.
    """
    bounds = windows.select("failure_id", seconds(F.col("failure_start")).alias("_s"), seconds(F.col("failure_end")).alias("_e"))
    t = seconds(F.col(ts))
    met = near_windows(df.select(ts).distinct(), t, bounds, F.col("_s") - PRECURSOR_HOURS * HOUR, F.col("_e"))
    before, inside = t < F.col("_s"), t >= F.col("_s")
    near = met.groupBy(ts).agg(
        F.max(F.when(before, (F.col("_s") - t) / HOUR)).alias("hours_to_fault"),
        F.max_by("failure_id", F.when(before, F.col("_s"))).alias("precursor_failure_id"),
        F.max_by("failure_id", F.when(inside, F.col("_s"))).alias("source_fault_event_id"),
    )
    out = df.join(near, ts, "left")
    # least and greatest pass over nulls, so rows without a failure ahead are told apart first.
    ramp = F.when(F.col("hours_to_fault").isNull(), 0.0).otherwise(F.greatest(F.least(1 - F.col("hours_to_fault") / PRECURSOR_HOURS, F.lit(1.0)), F.lit(0.0)))
    out = out.withColumn("degradation", ramp).withColumns({f"scenario_{k}": F.col(c) + OFFSETS[k] * F.col("degradation") for k, c in signals.items()})
    sigmoid = 1 / (1 + F.exp(-8 * F.col(score)))
    condition = F.when(F.col(score).isNotNull(), F.greatest(F.least(100 - 60 * F.col("degradation") - 10 * sigmoid, F.lit(100.0)), F.lit(0.0)))
    state = F.when(F.col("source_fault_event_id").isNotNull(), "FAULT").when(F.col("degradation") > 0, "DEGRADING").otherwise("NORMAL")
    return out.withColumns({"condition_score": condition, "condition_state": state, "event_timestamp": F.col(ts) + F.expr(f"INTERVAL '{YEARS_LATER}' YEAR")})


def horizon_alerts(scenario: DataFrame, entity: str, ts: str, horizons: tuple[int, ...], required: int = 2, window: int = 3) -> DataFrame:
    """Alerts of each horizon: degradation above 1 - horizon / PRECURSOR_HOURS, required times in the last window rows."""
    each = scenario.withColumn("horizon_h", F.explode(F.array(*map(F.lit, horizons)))).withColumns({"required": F.lit(required), "window": F.lit(window)})
    hot = each.withColumn("hot", F.col("degradation") > 1 - F.col("horizon_h") / PRECURSOR_HOURS)
    return with_persistence(hot, [entity, "horizon_h"], ts, "hot", [window])
