"""Exact order statistics and running totals over whole tables, without one task that holds all rows.

Quantiles come by selection: a pass counts the values of each wanted rank's interval in CELLS cells, and the cell that holds
the rank is the next interval, until its few values come to the driver. Running totals come by ranges: approximate
quantiles cut the values into RANGES, ranges are summed, and a window inside each range starts from the sum of those before.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of an interval in one pass; values that may come to the driver at the end; ranges of a running total.
CELLS, FEW, RANGES = 1024, 10_000, 64


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], cells: int = CELLS, few: int = FEW) -> dict[str, list[float | None]]:
    """Interpolated quantiles of the known values (neither null nor NaN) of each column; None for a column without any.

    Passes read the columns alone; each shrinks every interval by up to `cells`, so two or three are usual. df is read
    once a pass and should be cheap to read again.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    first = df.agg(*[f(v).alias(f"{n}{k}") for k, v in enumerate(value.values()) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    wanted = {(k, r) for k in range(len(columns)) if first[f"n{k}"] for p in probabilities for at in [p * (first[f"n{k}"] - 1)] for r in (floor(at), ceil(at))}
    # Of each wanted rank: bounds of its interval, values below it, values inside.
    open_ = {t: (first[f"lo{t[0]}"], first[f"hi{t[0]}"], 0, first[f"n{t[0]}"]) for t in wanted}
    known = {}
    while True:
        for t, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                known[t] = lo
                del open_[t]
        if not open_:
            break
        spans = sorted({(t[0], lo, hi, below, inside) for t, (lo, hi, below, inside) in open_.items()})
        parts = [F.when(v.between(lo, hi), F.struct(F.lit(i).alias("i"), v.alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for i, (k, lo, hi, _, _) in enumerate(spans) for v in [list(value.values())[k]]]
        inside = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
        if sum(s[4] for s in spans) <= few:
            held: dict[int, list[float]] = {}
            for i, v in inside.select("i", "v").collect():
                held.setdefault(i, []).append(v)
            values = {s: sorted(held[i]) for i, s in enumerate(spans)}
            known |= {t: values[t[0], lo, hi, below, n][t[1] - below] for t, (lo, hi, below, n) in open_.items()}
            break
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as a whole width may be infinite
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        counted = inside.groupBy("i", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r.i, r.lo)):
            by.setdefault(r.i, []).append(r)
        for t, (lo, hi, below, n) in open_.items():
            for r in by[spans.index((t[0], lo, hi, below, n))]:
                if t[1] < below + r.n:
                    open_[t] = (r.lo, r.hi, below, r.n)
                    break
                below += r.n
    out = {}
    for k, c in enumerate(columns):
        n = first[f"n{k}"]
        ends = [(p * (n - 1), known[k, floor(p * (n - 1))], known[k, ceil(p * (n - 1))]) for p in probabilities] if n else []
        out[c] = [a if a == b else a + (b - a) * (at - floor(at)) for at, a, b in ends] if n else [None] * len(probabilities)
    return out


def running_totals(df: DataFrame, by: str, sums: list[str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """df, one row for each value of the numeric column `by` (not null), with column run_<c> for each of sums: the sum up to this row.

    Only a summary with a row for each range passes through one task. df is read three times.
    """
    cuts = sorted({x for x in df.approxQuantile(by, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if x == x})
    edges = [float("-inf"), *[c for c in cuts if c not in (float("-inf"), float("inf"))], float("inf")]
    at = F.col(by).cast("double")
    placed = df.withColumn("_by", at)
    placed = Bucketizer(splits=edges, inputCol="_by", outputCol="_range", handleInvalid="keep").transform(placed) if len(edges) > 2 else placed.withColumn("_range", F.lit(0.0))
    order = lambda c: F.desc(c) if descending else F.asc(c)
    held = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_range", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])  # a row for each range
    within = Window.partitionBy("_range").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    made = placed.join(F.broadcast(held), "_range")
    return made.select(*df.columns, *[(F.col(f"_before_{c}") + F.sum(c).over(within)).alias(f"run_{c}") for c in sums])


def quantile_literals(quantiles: list[float | None]) -> Column:
    """An array of numbers as a literal."""
    return F.array(*[F.lit(q).cast("double") for q in quantiles])
