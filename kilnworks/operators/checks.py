"""Rule-based data quality: rules of one table share a scan; results are rows of (rule, evaluated, failed, rate, status)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """Fails on each row for which `bad` holds."""

    code: str
    bad: Column


def run_row_rules(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """All rules of a table in one aggregate."""
    one = df.agg(F.count("*").alias("evaluated"), *[F.count_if(r.bad).alias(r.code) for r in rules])
    return one.unpivot("evaluated", [r.code for r in rules], "rule_code", "failed").select("rule_code", "evaluated", "failed")


def duplicate_groups(df: DataFrame, code: str, keys: list[str]) -> DataFrame:
    """Fails once for each key that stands more than once."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.count_if(F.col("n") > 1).alias("failed")).select(F.lit(code).alias("rule_code"), "evaluated", "failed")


def extra_rows(df: DataFrame, code: str, keys: list[str]) -> DataFrame:
    """Fails once for each row beyond the first of its key."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failed")).select(F.lit(code).alias("rule_code"), "evaluated", "failed")


def orphans(df: DataFrame, code: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Fails for each row whose parent is missing."""
    known = parent.select(F.col(parent_key).alias("_k"), F.lit(True).alias("_found")).distinct()
    return df.join(known, F.col(key) == F.col("_k"), "left").agg(F.count("*").alias("evaluated"), F.count_if(F.col("_found").isNull()).alias("failed")).select(F.lit(code).alias("rule_code"), "evaluated", "failed")


def key_rules(parent: DataFrame, key: str, duplicates: list[str], children: dict[str, tuple[DataFrame, str]], repeats: dict[str, str] | None = None) -> DataFrame:
    """`duplicate_groups` of the parent's key under each code, and `orphans` of its children (code: rows and their key), by one grouping.

    repeats has codes of `duplicate_groups` of a child's key, with the code of the child.

    Keys travel as digests of 128 bits, once for each row of parent and children. A null key groups, and has no parent.
    """

    def side(df: DataFrame, name: str, kind: int) -> DataFrame:
        digest = lambda *salt: F.when(F.col(name).isNotNull(), F.xxhash64(*salt, F.col(name)))
        return df.select(digest().alias("_a"), digest(F.lit("key")).alias("_b"), F.lit(kind).cast("byte").alias("_kind"))

    sides = [side(parent, key, 0), *[side(df, name, k) for k, (df, name) in enumerate(children.values(), 1)]]
    # Dealt out before they are grouped: keys hardly repeat inside a task, so there is nothing to sum up before.
    rows = reduce(DataFrame.unionByName, sides).repartition("_a", "_b")
    by = rows.groupBy("_a", "_b").agg(*[F.count_if(F.col("_kind") == k).alias(f"_{k}") for k in range(len(sides))])
    found = {code: ("_0", F.count_if(F.col("_0") > 1)) for code in duplicates}
    of = {code: f"_{k}" for k, code in enumerate(children, 1)}
    found |= {code: (of[child], F.count_if(F.col(of[child]) > 1)) for code, child in (repeats or {}).items()}
    alone = F.col("_a").isNull() | (F.col("_0") == 0)
    found |= {code: (f"_{k}", F.coalesce(F.sum(F.when(alone, F.col(f"_{k}"))), F.lit(0))) for k, code in enumerate(children, 1)}
    made = [F.struct(F.lit(code).alias("rule_code"), F.coalesce(F.sum(n), F.lit(0)).alias("evaluated"), failed.alias("failed")) for code, (n, failed) in found.items()]
    return by.agg(F.array(*made).alias("_rules")).select(F.inline("_rules"))


def results(parts: list[DataFrame], warn: set[str] = frozenset()) -> DataFrame:
    """All results with rate and status; a failed rule of `warn` is WARN."""
    df = reduce(DataFrame.unionByName, parts)
    failed = F.when(F.col("rule_code").isin(sorted(warn)), "WARN").otherwise("FAIL") if warn else F.lit("FAIL")
    return df.withColumns({"failure_rate": F.when(F.col("evaluated") > 0, F.col("failed") / F.col("evaluated")).otherwise(0.0), "status": F.when(F.col("failed") == 0, "PASS").otherwise(failed)})


def summary(res: DataFrame) -> DataFrame:
    """One row: rules by status and the share of evaluated rows that passed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return res.agg(F.count("*").alias("rules"), count("PASS"), count("WARN"), count("FAIL"), (1 - F.sum("failed") / F.sum("evaluated")).alias("score"))


def domain_summary(res: DataFrame) -> DataFrame:
    """Rules by status and the share of evaluated rows that passed, for each domain."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    made = res.groupBy("domain").agg(F.count("*").alias("rules"), count("PASS"), count("WARN"), count("FAIL"), F.sum("evaluated").alias("evaluated"), F.sum("failed").alias("failed"))
    return made.withColumn("score", 1 - F.col("failed") / F.col("evaluated"))


def with_runs(res: DataFrame) -> DataFrame:
    """Results of an earlier run, in which nothing was evaluated, and of the present one, told apart by run."""
    before = res.withColumns({"evaluated": F.lit(0).cast("long"), "failed": F.lit(0).cast("long"), "status": F.lit("PASS"), "run": F.lit(1)})
    return before.unionByName(res.withColumn("run", F.lit(2)))


def latest(res: DataFrame, run: str = "run") -> DataFrame:
    """The result of the last run of each rule."""
    order = Window.partitionBy("rule_code").orderBy(F.desc(run))
    return res.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")
