"""Causal features of telemetry by equipment, alerts, and their evaluation against failure windows.

Every function works per entity and looks back only. Failure windows are joined by day, then by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions.measures import ratio
from kilnworks.operators.blocks import in_blocks, numbered, trailing_quantiles
from kilnworks.operators.control import HOUR, seconds
from kilnworks.operators.ranks import exact_quantiles, running_totals


def clean_series(df: DataFrame, entity: str, ts: str, tie: list[str]) -> DataFrame:
    """Drops rows without a time and keeps the first (by tie) of each time."""
    order = Window.partitionBy(entity, ts).orderBy(*tie)
    return df.filter(F.col(ts).isNotNull()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def bin_features(df: DataFrame, entity: str, ts: str, width: str, analog: list[str], digital: list[str], expected: int, coverage: float = 0.8) -> DataFrame:
    """Tumbling bins, empty ones included: counts, coverage, and statistics of each signal.

    Differences cross the edges of bins; the first row of a digital signal counts as a transition.
    """

    def moves(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(ts)
        steps = {f"_d_{c}": F.abs(F.col(c) - F.lag(c).over(order)) for c in analog}
        return rows.withColumns(steps | {f"_t_{c}": F.coalesce(F.col(c) != F.lag(c).over(order), F.lit(True)).cast("int") for c in digital})

    df = in_blocks(df, entity, ts, 1, moves)
    begin = F.window(ts, width)["start"].cast("timestamp_ntz").alias("bin")
    aggs = []
    for c in analog:
        known = F.when(F.col(c).isNotNull(), F.col(ts))
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.max_by(c, known).alias(f"{c}_last"), F.min_by(c, known).alias(f"{c}_first"), F.avg(f"_d_{c}").alias(f"{c}_move")]
    for c in digital:
        aggs += [F.avg(c).alias(f"{c}_active"), F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"{c}_last"), F.sum(f"_t_{c}").alias(f"{c}_transitions")]
    bins = df.groupBy(entity, begin).agg(F.count("*").alias("samples"), *aggs)
    span = bins.groupBy(entity).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    grid = span.select(entity, F.explode(F.sequence("lo", "hi", F.expr(f"interval {width}"))).alias("bin"))
    out = grid.join(bins, [entity, "bin"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    out = out.withColumns({f"{c}_range": F.col(f"{c}_max") - F.col(f"{c}_min") for c in analog} | {f"{c}_change": F.col(f"{c}_last") - F.col(f"{c}_first") for c in analog})
    return out.withColumn("coverage", F.col("samples") / F.lit(expected)).withColumn("valid", F.col("coverage") >= coverage)


def trailing_context(bins: DataFrame, entity: str, columns: list[str], n: int = 12, least: int = 6) -> DataFrame:
    """Mean, spread and deviation over the last n bins, where at least `least` of them hold a value; slope over n bins."""

    def context(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("bin")
        frame = order.rowsBetween(-(n - 1), 0)
        for c in columns:
            enough = F.count(c).over(frame) >= least
            rows = rows.withColumns({f"{c}_context": F.when(enough, F.avg(c).over(frame)), f"{c}_context_std": F.when(enough, F.stddev_pop(c).over(frame)), f"{c}_slope": F.col(c) - F.lag(c, n).over(order)})
            rows = rows.withColumn(f"{c}_deviation", F.col(c) - F.col(f"{c}_context"))
        return rows

    return in_blocks(bins, entity, "bin", n, context)


def near_windows(times: DataFrame, t: Column, windows: DataFrame, lo: Column, hi: Column, how: str = "inner") -> DataFrame:
    """Rows of times joined to the windows whose [lo, hi] holds t, both in seconds; _lo and _hi are the bounds.

    Windows are dealt to the days they touch, so that the join has a key; a window meets a time on one day only.
    """
    day = lambda x: F.floor(x / 86400)
    dealt = windows.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").withColumn("_day", F.explode(F.sequence(day(F.col("_lo")), day(F.col("_hi")))))
    inside = (day(t) == F.col("_day")) & (t >= F.col("_lo")) & (t <= F.col("_hi"))
    return times.join(dealt, inside, how).drop("_day")


def label_windows(df: DataFrame, ts: str, windows: DataFrame, before_h: int = 24, after_h: int = 24) -> DataFrame:
    """in_failure [s, e], in_warning [s - before, e], excluded [s - before, e + after], and the last window's failure_id."""
    w = windows.withColumns({"_s": seconds(F.col("failure_start")), "_e": seconds(F.col("failure_end"))})
    t = seconds(F.col(ts))
    times = df.select(ts).distinct()
    met = near_windows(times, t, w, F.col("_s") - before_h * HOUR, F.col("_e") + after_h * HOUR)
    inside = (t >= F.col("_s")) & (t <= F.col("_e"))
    flags = met.groupBy(ts).agg(
        F.bool_or(inside).alias("in_failure"), F.bool_or(t <= F.col("_e")).alias("in_warning"), F.max_by("failure_id", F.when(inside, F.struct("failure_start", "failure_id"))).alias("failure_id"), F.lit(True).alias("excluded")
    )
    out = df.join(flags, ts, "left")
    return out.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("in_failure", "in_warning", "excluded")})


def k_of_n(df: DataFrame, entity: str | list[str], ts: str, flag: Column, k: int, n: int) -> Column:
    """Whether k of the last n rows are flagged; never before n rows have been seen."""
    frame = Window.partitionBy(entity).orderBy(ts).rowsBetween(-(n - 1), 0)
    return (F.sum(flag.cast("int")).over(frame) >= k) & (F.count(F.lit(1)).over(frame) == n)


def episode_starts(entity: str | list[str], ts: str, alert: str) -> Column:
    """The first row of each run of alerts."""
    return F.col(alert) & ~F.coalesce(F.lag(alert).over(Window.partitionBy(entity).orderBy(ts)), F.lit(False))


def persistent_alerts(df: DataFrame, entity: str, ts: str, flag: str, k: int, n: int, **sizes: int) -> DataFrame:
    """df with alert (k of the last n rows of the entity are flagged) and start (first alert of a run), in blocks of rows."""

    def judged(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.withColumn("alert", k_of_n(rows, keys, ts, F.col(flag), k, n))
        return rows.withColumn("start", episode_starts(keys, ts, "alert"))

    return in_blocks(df, entity, ts, n, judged, **sizes)


def adaptive_threshold(df: DataFrame, entity: str, ts: str, score: str, q: float, lag: int = 288, lookback: int = 2016, least: int = 864) -> DataFrame:
    """entity, ts, score and threshold: the exact quantile of the scores in a lagged window of rows; null until `least` of them are there."""
    made = trailing_quantiles(df, entity, ts, score, [q], lag, lookback, least, "_limits")
    return made.withColumn("threshold", F.get("_limits", F.lit(0))).drop("_limits")


def evaluate_any_alert(df: DataFrame, ts: str, alert: str, windows: DataFrame, horizon_h: int = 24, early_h: float = 2.0) -> DataFrame:
    """For each failure: the first alert in [s - horizon, e], its lead in hours, and whether it was early; misses stay."""
    t = seconds(F.col(ts))
    w = windows.withColumns({"_s": seconds(F.col("failure_start")), "_e": seconds(F.col("failure_end"))})
    alerts = df.filter(F.col(alert)).select(ts)
    met = near_windows(alerts, t, w, F.col("_s") - horizon_h * HOUR, F.col("_e")).groupBy("failure_id").agg(F.min(t).alias("_first"))
    lead = (F.col("_s") - F.col("_first")) / HOUR
    return w.join(met, "failure_id", "left").select("failure_id", F.col("_first").isNotNull().alias("detected"), lead.alias("lead_hours"), F.coalesce(lead >= early_h, F.lit(False)).alias("early"))


def evaluate_starts(df: DataFrame, ts: str, start: str, windows: DataFrame, horizon_h: int = 24) -> DataFrame:
    """One row: episodes, those that begin in [s - horizon, s) of a failure, precision, recall and false episodes a day."""
    t = seconds(F.col(ts))
    w = windows.withColumn("_s", seconds(F.col("failure_start")))
    starts = df.filter(F.col(start)).select(F.struct(*df.columns).alias("_id"), t.alias("_t"))  # an episode is its row: entity and time
    met = near_windows(starts, F.col("_t"), w, F.col("_s") - horizon_h * HOUR, F.col("_s"), "left")
    warns = F.col("_t") < F.col("_s")  # the join takes the failure's own second too
    days = df.agg(F.greatest((F.max(t) - F.min(t)) / 86400, F.lit(1e-9)).alias("days"))
    one = met.agg(F.countDistinct("_id").alias("episodes"), F.countDistinct(F.when(warns, F.col("_id"))).alias("true_episodes"), F.countDistinct(F.when(warns, F.col("failure_id"))).alias("warned"))
    total = windows.agg(F.count("*").alias("failures"))
    out = one.crossJoin(F.broadcast(days)).crossJoin(F.broadcast(total))  # one row each
    return out.select("episodes", "true_episodes", "warned", "failures", F.try_divide("true_episodes", "episodes").alias("precision"), F.try_divide("warned", "failures").alias("recall"), ((F.col("episodes") - F.col("true_episodes")) / F.col("days")).alias("false_per_day"))


def robust_z(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Largest distance from the training median over all columns, in interquartile ranges; a range of 0 counts as none."""
    quartiles = exact_quantiles(df.filter(train), columns, [0.25, 0.5, 0.75])
    z = []
    for c in columns:
        low, middle, high = quartiles[c]
        z.append(F.abs(F.col(c) - F.lit(middle).cast("double")) / F.lit(high - low if middle is not None and high > low else None).cast("double"))
    return df.withColumn("robust_z", F.greatest(*z) if len(z) > 1 else z[0])


def forecast_features(df: DataFrame, entity: str, date: str, target: str, lags: tuple[int, ...] = (1, 7, 14, 28), rolls: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Lags, and means and spreads over full windows that end the day before; calendar columns."""
    order = Window.partitionBy(entity).orderBy(date)
    df = df.withColumns({f"lag_{k}": F.lag(target, k).over(order) for k in lags})
    for k in rolls:
        frame = order.rowsBetween(-k, -1)
        full = F.count(target).over(frame) == k
        df = df.withColumns({f"mean_{k}": F.when(full, F.avg(target).over(frame)), f"std_{k}": F.when(full, F.stddev_pop(target).over(frame))})
    return df.withColumns({"day_of_week": F.weekday(date), "day_of_month": F.dayofmonth(date), "month": F.month(date), "week": F.weekofyear(date), "weekend": F.weekday(date) >= 5})


def regression_report(df: DataFrame, y: str, yhat: str, keys: list[str]) -> DataFrame:
    """MAE, RMSE, R2 and MAPE (where the truth isn't 0) by key."""
    err = F.col(yhat) - F.col(y)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), (1 - F.sum(err * err) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"), F.avg(F.when(F.abs(y) > 1e-9, F.abs(err / F.col(y)))).alias("mape")
    )


def cycle_features(df: DataFrame, cycle: str, sensor: str, value: str) -> DataFrame:
    """Mean, spread, bounds, range and root mean square of each cycle and sensor."""
    v = F.col(value).cast("double")
    return df.groupBy(cycle, sensor).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), (F.max(v) - F.min(v)).alias("range"), F.sqrt(F.avg(v * v)).alias("rms"))


def classwise_split(df: DataFrame, label: str, order: str, held_out: float = 0.2) -> DataFrame:
    """Marks the last part of each class (at least one row, at most all but one) as held out."""
    w = Window.partitionBy(label)
    n = F.count("*").over(w)
    first = F.greatest(F.lit(1), F.floor(n * (1 - held_out)))
    return df.withColumn("held_out", F.row_number().over(w.orderBy(order)) > first)


def split_by_position(df: DataFrame, entity: str, ts: str, share: float) -> DataFrame:
    """part of each row: TRAIN for the first share of the rows of an entity by position, CALIBRATION for the rest."""
    many = df.groupBy(F.col(entity).alias("_e")).agg(F.count("*").alias("_many"))
    placed = numbered(df, entity, ts, "_place").join(many, F.col(entity).eqNullSafe(F.col("_e")))
    return placed.withColumn("part", F.when(F.col("_place") < F.floor(F.round(share * F.col("_many"), 6)), "TRAIN").otherwise("CALIBRATION")).drop("_place", "_e", "_many")


def split_by_month(df: DataFrame, entity: str, ts: str, excluded: str, share: float = 0.7, least: int = 100) -> DataFrame:
    """part of each row: TRAIN and CALIBRATION in the first calendar month of an entity, cut at the time of its row number `share`; HOLDOUT later.

    Excluded rows of the first month count for the cut, but are EXCLUDED from both parts. Rows of one time stay together.
    An entity with fewer than `least` rows in its first month is an error. Rows without a time have no part.
    """
    timed = numbered(df.filter(F.col(ts).isNotNull()), entity, ts, "_place").select(F.col(entity).alias("_e"), F.col(ts).alias("_t"), "_place")
    begins = timed.groupBy("_e").agg(F.add_months(F.trunc(F.min("_t"), "month"), 1).cast("timestamp_ntz").alias("_later"))
    first = timed.join(begins.withColumnRenamed("_e", "_e2"), F.col("_e").eqNullSafe(F.col("_e2"))).filter(F.col("_t") < F.col("_later"))
    many = first.groupBy("_e", "_later").agg(F.count("*").alias("_n"))
    enough = F.when(F.col("_n") >= least, F.floor(F.round(share * F.col("_n"), 6))).otherwise(F.raise_error(F.lit(f"fewer than {least} rows in a first month")).cast("long"))
    cut = many.select(F.col("_e").alias("_e3"), enough.alias("_at"), F.col("_later").alias("_next"))  # a row for each entity
    ends = first.join(cut, F.col("_e").eqNullSafe(F.col("_e3")) & (F.col("_place") == F.col("_at"))).select("_e3", F.col("_t").alias("_end"), "_next")
    made = df.join(ends, F.col(entity).eqNullSafe(F.col("_e3")), "left")
    t, out = F.col(ts), F.coalesce(F.col(excluded), F.lit(False))
    part = F.when(t >= F.col("_next"), "HOLDOUT").when(t.isNull(), None).when(out, "EXCLUDED").when(t < F.col("_end"), "TRAIN").otherwise("CALIBRATION")
    return made.withColumn("part", part).drop("_e3", "_end", "_next")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: precision at each distinct score, weighted by the recall it adds; null where nothing is positive.

    Rows are summed by score; scores are cut into ranges, so no task holds all of them.
    """
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.count_if(label).alias("pos"))
    made = running_totals(by, "score", ["pos", "n"], descending=True).crossJoin(F.broadcast(by.agg(F.sum("pos").alias("total"))))  # one row
    return made.agg(F.sum(ratio("pos", "total") * F.col("run_pos") / F.col("run_n")).alias("average_precision"))
