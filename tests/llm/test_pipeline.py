"""The pipeline's stages on a small folder, stage by stage against brute force."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kilnworks.llm import jaccard
from kilnworks.llm.scratch import shared_dir


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    body = lambda k: " ".join(f"the w{(k * 31 + j * 7) % 997} of kiln{k} and glaze{j}" for j in range(30))
    rows = [(k, body(k), "en", "s", len(body(k))) for k in range(30)]
    rows += [(100, body(3) + " tail", "en", "s", 1), (101, body(3), "en", "s", 1), (102, "too short", "en", "s", 9), (103, None, None, None, None), (104, body(40) + " alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1), (105, body(41) + " token = abcdef12345", "en", "s", 1)]
    rows += [rows[5], rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    quality, near, leaks, safe = seen.values()
    assert set(quality) == {*range(30), 100, 101, 104, 105}
    assert set(near) == set(quality) - {100, 101}
    assert set(leaks) == set(near) - {104} and set(safe) == set(leaks)
    assert safe[105].text.endswith("[secret]") and safe[105].n_chars == len(safe[105].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(safe)


def test_run_gives_the_same_rows(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == 31 and len({r.doc_id for r in rows}) == 31


def test_one_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    groups = jaccard.near_duplicates(docs).filter("n_shingles > 0").select("component_id").distinct().count()
    assert corpus_pipeline.one_of_each(spark, docs, folder).filter("text IS NOT NULL").count() == groups


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    helpers = ["_copy", "_spans", "_id", "_copy_of", "n_words", "kept", "row", "key", "copy", "id"]
    named = docs.select(*docs.columns, *[F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in helpers])
    long = named.filter("doc_id = 7").withColumns({"doc_id": F.lit(500).cast("long"), "text": F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda k: F.concat(F.lit("the w"), k, F.lit(" of kiln"), 7 * k, F.lit(" and glaze"), k)))})
    named = named.union(long)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        named = stage(spark, named, folder).cache()
        for r in named.collect():
            assert all(r[c] == c + str(7 if r.doc_id == 500 else r.doc_id) for c in helpers)
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert {r.doc_id for r in named.collect()} >= {500}
    assert corpus_pipeline.packed(spark, docs.limit(0), folder).count() == 0


def test_stages_leave_no_texts_between_steps(spark, folder, tmp_path):
    """What the first three stages write besides their result is smaller than a tenth of their texts."""
    rng = random.Random(1)
    rows = [(k, "the and of " + "".join(chr(rng.randrange(97, 123)) for _ in range(40_000)) + " " + " ".join(f"of w{k}x{j} and" for j in range(9)), "en", "s", 1) for k in range(40)]
    spark.createDataFrame([*rows, rows[3], (50, rows[4][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    written = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = written()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k + 1}")
        assert written() - before < 160_000, name
        docs = spark.read.parquet(f"{tmp_path}/{k + 1}")
    assert docs.count() in (0, 40)
