"""From raw documents to packed batches: quality, near duplicates, benchmark leaks, secrets, packing.

Edge cases, for every stage: rows travel as one struct beside their key, so further columns of documents, whatever
their names, come out as they went in; an empty table gives an empty one; rows that share a doc_id, or have none, are
judged by their own texts. A null or empty text fails the quality rules; further on it is nobody's duplicate, leak or
secret, and has length 0. Of repeated rows (same doc_id and text) the near-duplicate stage keeps one. Ties between
near duplicates go to the least doc_id, then the least hash of the text.

What a stage decides is written as keys and verdicts, not as texts, and the stage reads its documents again: those that
are surely not on its list (`sketch.apart`) pass as they are, and only the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import decontaminate, jaccard, packing, quality_rules, secrets
from kilnworks.llm.names import whole_row
from kilnworks.llm.scratch import cut, drop
from kilnworks.llm.sketch import apart


def _back(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of documents out of the structs of rows."""
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """row, id, copy (hash of the text) and key (of both) of each document."""
    rows = docs.select(whole_row(docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("copy"))
    return rows.withColumn("key", F.xxhash64("id", "copy"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key is not on a written list."""
    sure, others = apart(rows, gone)
    return sure.union(others.join(gone, "key", "left_anti").select(*rows.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))
    judged = quality_rules.apply_rules(docs.select(key.alias("key"), "text", "lang"), carry=["key"])
    gone = cut(judged.filter(~F.coalesce("kept", F.lit(False))).select("key").distinct(), "failed")
    return _back(_without(docs.select(whole_row(docs.columns).alias("row"), key.alias("key")), gone), docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id."""
    found = jaccard.near_duplicates(docs).select(F.xxhash64("doc_id", "copy").alias("key"), "representative")
    # Keys that are not kept as they are: a text that is not the first of its group, or a repeated row.
    keys = found.groupBy("key").agg(F.max("representative").alias("stays"), F.count("*").alias("n"))
    doubtful = cut(keys.filter("NOT stays OR n > 1").drop("n"), "doubtful")
    rows = _keyed(docs)
    sure, others = apart(rows, doubtful)
    others = others.join(doubtful, "key", "left").filter(F.coalesce("stays", F.lit(True))).dropDuplicates(["key", "id", "copy"])
    return _back(sure.union(others.select(*rows.columns)), docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_copy=True)
    gone = cut(found.select(F.xxhash64("doc_id", "copy").alias("key")).distinct(), "leaks")
    return _back(_without(_keyed(docs), gone), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    found = secrets.find_spans(docs.select(whole_row(docs.columns).alias("row"), "text"))
    found = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return _back(found, docs.columns, text=F.col("text"), n_chars=n_chars)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of each document."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Components of a similarity graph and a shortest-path choice of boundaries are no plain SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
            drop(before)
    return docs
