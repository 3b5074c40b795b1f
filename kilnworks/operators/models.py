"""Trained models: boosted trees, balanced logistic regression, an isolation forest and class reports.

Fits are distributed (MLlib, or one task for each isolation tree); only model parameters reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_cut(df: DataFrame, keys: list[str], ts: str, share: float) -> DataFrame:
    """By key, the last time of the first `share` of its rows; rows of one time stay together.

    Rows are counted by time first, so the window holds one row for each time.
    """
    by = df.groupBy(*keys, ts).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    seen = F.sum("n").over(part.orderBy(ts))
    made = by.withColumns({"seen": seen, "all": F.sum("n").over(part)})
    # The earliest time always counts, so that no key is left without learning rows.
    return made.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("seen") <= share * F.col("all"), F.col(ts))), F.min(ts)).alias("cut"))


def boosted(train: DataFrame, rows: DataFrame, target: str, numeric: list[str], category: str, name: str, trees: int = 20, depth: int = 5, rate: float = 0.1) -> DataFrame:
    """rows with the expectation (name) of boosted regression trees learnt from train; new categories get no column."""
    steps = [
        StringIndexer(inputCol=category, outputCol="_index", handleInvalid="keep"),
        OneHotEncoder(inputCol="_index", outputCol="_hot"),
        VectorAssembler(inputCols=[*numeric, "_hot"], outputCol="_features"),
        GBTRegressor(labelCol=target, featuresCol="_features", predictionCol=name, maxIter=trees, maxDepth=depth, stepSize=rate, seed=42),
    ]
    return Pipeline(stages=steps).fit(train).transform(rows).drop("_index", "_hot", "_features")


def forecast_holdout(feat: DataFrame, entity: str, date: str, target: str, numeric: list[str], days: int = 60, naive: str = "lag_7") -> DataFrame:
    """The last `days` days with forecasts of trees and of a week before; selected is the one of lower absolute error."""
    known = feat.dropna(subset=[target, *numeric]).withColumn("_entity", F.col(entity).cast("string")).withColumn("_day", F.to_date(date))
    last = known.agg(F.max("_day").alias("last"))
    split = known.crossJoin(F.broadcast(last)).withColumn("_test", F.col("_day") > F.date_sub("last", days))  # one row
    test = boosted(split.filter("NOT _test"), split.filter("_test"), target, numeric, "_entity", "ml_forecast")
    test = test.drop("_entity", "_day", "last", "_test")
    better = test.agg((F.avg(F.abs(F.col("ml_forecast") - F.col(target))) <= F.avg(F.abs(F.col(naive) - F.col(target)))).alias("_ml"))
    out = test.crossJoin(F.broadcast(better))  # one row
    chosen = F.when(F.col("_ml"), F.col("ml_forecast")).otherwise(F.col(naive))
    out = out.withColumns({"selected_model": F.when(F.col("_ml"), "boosted_trees").otherwise("seasonal_naive"), "selected_forecast": chosen, "abs_error": F.abs(chosen - F.col(target))})
    return out.withColumn("pct_error", F.when(F.abs(F.col(target)) > 1e-9, 100 * F.col("abs_error") / F.abs(F.col(target)))).drop("_ml")


def contextual_anomaly(base: DataFrame, test: DataFrame, target: str, numeric: list[str], line: str, ts: str, low: float = 0.005, high: float = 0.995, share: float = 0.8) -> DataFrame:
    """test with its expectation, relative residual and state against the calibration residuals of its line.

    Trees learn from the first `share` of base by time, limits come from the rest; lines without any get those of all.
    """
    cut = time_cut(base, [], ts, share)
    dealt = base.crossJoin(F.broadcast(cut)).withColumn("_train", F.col(ts) <= F.col("cut")).drop("cut")  # one row
    train = dealt.filter("_train").drop("_train")
    both = dealt.filter("NOT _train").drop("_train").withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)))
    made = boosted(train, both, target, numeric, line, "expected")
    made = made.withColumn("residual", F.col(target) - F.col("expected")).withColumn("residual_pct", F.col("residual") / F.nullif("expected", F.lit(0.0)))
    # Approximate percentiles are bounded in memory for any number of shifts; their rank is off by 1e-5 at most.
    limits = F.percentile_approx("residual_pct", [low, high], 100_000)
    cal = made.filter("NOT _test")
    out = made.filter("_test").drop("_test").join(F.broadcast(cal.groupBy(line).agg(limits.alias("_own"))), line, "left").crossJoin(F.broadcast(cal.agg(limits.alias("_all"))))  # lines; one row
    bound = lambda i: F.coalesce(F.col("_own")[i], F.col("_all")[i])
    out = out.withColumns({"low_threshold": bound(0), "high_threshold": bound(1)}).drop("_own", "_all")
    return out.withColumn("status", F.when(F.col("residual_pct") > F.col("high_threshold"), "HIGH_ENERGY").when(F.col("residual_pct") < F.col("low_threshold"), "LOW_ENERGY").otherwise("NORMAL"))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weight n / (classes x rows of the class)."""
    each = df.groupBy(label).agg(F.count("*").alias("_c"))
    whole = each.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    factors = each.crossJoin(F.broadcast(whole)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))  # a row for each class
    return df.join(F.broadcast(factors), label)


def warning_probability(train: DataFrame, rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """rows with the probability of the label under a balanced logistic regression over standardised features.

    The penalty is half the squared weights against the summed loss. Both classes must occur in train.
    """
    weighted = balanced(train.withColumn("_label", F.col(label).cast("double")), "_label")
    rows_learnt, classes = train.agg(F.count("*"), F.countDistinct(label)).first()  # one row
    if classes != 2:
        raise ValueError("the learning rows need both classes")
    steps = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        LogisticRegression(labelCol="_label", featuresCol="_features", weightCol="weight", regParam=1 / rows_learnt, standardization=False, probabilityCol="_p", maxIter=200),
    ]
    made = Pipeline(stages=steps).fit(weighted).transform(rows)
    return made.withColumn("probability", vector_to_array("_p")[1]).drop("_raw", "_features", "_p", "rawPrediction", "prediction")


def _tree(x: np.ndarray, deepest: int, rng: np.random.Generator) -> list[tuple[int, int, float, int]]:
    """Nodes in heap order of slots: (slot, feature or -1, threshold, rows), children of slot s at 2 s + 1 and 2 s + 2."""
    nodes, open_ = [], [(0, 0, x)]
    while open_:
        slot, depth, part = open_.pop()
        lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(x.shape[1]),) * 2
        wide = np.flatnonzero(hi > lo)
        if depth >= deepest or len(part) < 2 or not len(wide):
            nodes.append((slot, -1, 0.0, len(part)))
            continue
        f = int(rng.choice(wide))
        at = float(rng.uniform(lo[f], hi[f]))
        nodes.append((slot, f, at, len(part)))
        open_ += [(2 * slot + 1, depth + 1, part[part[:, f] <= at]), (2 * slot + 2, depth + 1, part[part[:, f] > at])]
    return nodes


def usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(train: DataFrame, rows: DataFrame, features: list[str], key: Column, trees: int = 300, sample: int = 256) -> DataFrame:
    """rows with isolation_score (0 to 1, higher: easier to isolate), from trees fitted in parallel tasks.

    Each tree draws rows of train by a hash of (key, tree), `sample` on average. Features are scaled by median and
    interquartile range; rows that lack a feature get none of the scores. train must not be empty.
    """
    known = train.dropna(subset=features)
    ask = known.agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 100_000).alias(f"q{i}") for i, c in enumerate(features)]).first()  # one row
    if not ask["n"]:
        raise ValueError("no learning rows")
    middle = np.array([ask[f"q{i}"][1] for i in range(len(features))])
    spread = np.array([(ask[f"q{i}"][2] - ask[f"q{i}"][0]) or 1.0 for i in range(len(features))])
    chance, deepest = min(1.0, sample / ask["n"]), math.ceil(math.log2(max(2, min(sample, ask["n"]))))
    scaled = [((F.col(c).cast("double") - float(m)) / float(s)).alias(f"f{i}") for i, (c, m, s) in enumerate(zip(features, middle, spread, strict=True))]
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(key, t), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30))))
    picked = known.select(*scaled, F.explode(drawn).alias("tree"))
    names = [f"f{i}" for i in range(len(features))]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = part[names].sort_values(names).to_numpy()
        made = pd.DataFrame(_tree(x, deepest, np.random.default_rng(tree)), columns=["slot", "feature", "at", "n"])
        return made.assign(tree=tree)

    # At most trees x 2^(deepest + 1) nodes, whatever the number of rows.
    nodes = picked.groupBy("tree").applyInPandas(fit, "slot int, feature int, at double, n int, tree int").toPandas()
    slots = 2 ** (deepest + 1) - 1
    ids = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    place = nodes["tree"].map(ids).to_numpy()
    feature, at, size = np.full((len(ids), slots), -1), np.zeros((len(ids), slots)), np.zeros((len(ids), slots))
    for made, column in ((feature, "feature"), (at, "at"), (size, "n")):
        made[place, nodes["slot"].to_numpy()] = nodes[column].to_numpy()
    whole = float(usual_path(min(sample, ask["n"])))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = part.to_numpy(dtype=float)
            total = np.zeros(len(x))
            for k in range(len(ids)):
                slot, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                for _ in range(deepest):
                    f = feature[k, slot]
                    inner = f >= 0
                    right = x[np.arange(len(x)), np.maximum(f, 0)] > at[k, slot]
                    slot = np.where(inner, 2 * slot + 1 + right, slot)
                    depth += inner
                total += depth + usual_path(size[k, slot])
            made = 2.0 ** (-total / len(ids) / (whole or 1.0))
            yield pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, made))

    value = score(F.struct(*scaled))
    return rows.withColumn("isolation_score", F.when(F.isnan(value), None).otherwise(value))


def forest_classes(train: DataFrame, rows: DataFrame, label: str, features: list[str], trees: int = 50, depth: int = 8) -> DataFrame:
    """rows with the class predicted by a random forest over balanced classes, and majority, the commonest of train."""
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    steps = [
        VectorAssembler(inputCols=features, outputCol="_features"),
        RandomForestClassifier(labelCol="_label", featuresCol="_features", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", predictionCol="_p", seed=42),
        IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels),
    ]
    made = Pipeline(stages=steps).fit(index.transform(balanced(train, label))).transform(rows)
    most = train.groupBy(label).agg(F.count("*").alias("n")).agg(F.max_by(label, F.struct("n", label)).alias("majority"))
    return made.drop("_features", "_p", "rawPrediction", "probability").crossJoin(F.broadcast(most))  # one row


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Support, precision, recall and F1 of each class, with accuracy, balanced accuracy and macro F1 of all.

    Everything comes from the counts of the confusion matrix.
    """
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")))).alias("s")).select("s.*")
    by = sides.groupBy(F.col("c").alias("class")).agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])
    by = by.withColumns({"precision": F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0)), "recall": F.try_divide("hits", "support")})
    by = by.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("claimed")), F.lit(0.0)))
    every = by.agg(F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    return by.drop("claimed", "hits").crossJoin(F.broadcast(every))  # one row
