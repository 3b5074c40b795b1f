"""Rows apart by a sketch of a list of keys."""

import pytest
from pyspark.sql import functions as F

from kilnworks.llm import sketch
from kilnworks.llm.scratch import cut


@pytest.mark.parametrize("buckets", [sketch.BUCKETS, 1])
def test_rows_of_the_list_are_never_sure(spark, monkeypatch, buckets):
    monkeypatch.setattr(sketch, "BUCKETS", buckets)
    rows = spark.range(60_000).select(F.xxhash64("id").alias("key"), "id").union(spark.createDataFrame([(None, -1)], "key long, id long"))
    listed = cut(rows.filter("id % 10 = 0").select("key"), "listed")
    sure, others = sketch.apart(rows, listed)
    assert sure.columns == others.columns == rows.columns
    here, there = {r.id for r in sure.collect()}, {r.id for r in others.collect()}
    assert here | there == {*range(-1, 60_000)} and not here & there
    assert there >= set(range(0, 60_000, 10)) and len(there) < (10_500 if buckets > 1 else 18_000)


def test_an_empty_list_holds_nothing(spark):
    rows = spark.range(10).withColumnRenamed("id", "key")
    sure, others = sketch.apart(rows, cut(rows.limit(0), "listed"))
    assert sure.count() == 10 and others.count() == 0
