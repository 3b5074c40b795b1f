"""Benchmark decontamination: short test items found inside documents of any length.

Words are runs of letters and digits in lower case; an item is the set of its runs of five words (all of its words,
if it has fewer). Items are partitioned by the size of that set into powers of two. Each item keeps a MinHash
sketch: the k shingles of smallest hash, k fixed by its partition's largest size so that a document that holds the
asked share of the item must hold one of them (if at most a quarter of u shingles may be absent, k is a quarter of
u plus one). A document's shingles are looked up among the sketches alone; what is hit is a candidate, and a
candidate counts if the exact share of the item's shingles inside the document reaches the threshold.

The table of sketches grows with the benchmark alone and has three numbers in a row. It is broadcast only while the
items have at most `broadcast_rows` shingles (24 MB of numbers); beyond that the same join shuffles.

Edge cases: null or empty documents and items without a word match nothing; repeated documents each match; rows that
share a doc_id with different texts are judged apart, and the id is returned once for each; repeated items with an
equal id and text are one item; only the named columns are read, so further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.llm.native_text import NOT_WORD, window_hashes, words

MATCHES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())]
)


def _tokens(df: DataFrame, text: str) -> DataFrame:
    df = df.withColumn("_words", words(F.lower(F.col(text)), NOT_WORD))
    return df.withColumn("_n", F.size("_words"))


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text", share: float = 0.75, window: int = 5) -> DataFrame:
    """A row for each shingle of each item: item, item_id, size (words of a shingle), h, n_item, in_sketch."""
    df = _tokens(items.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_id), F.col(text)).alias("item"), F.col(text).alias("_text")), "_text")
    df = df.filter("_n > 0").dropDuplicates(["item", "item_id"]).withColumn("size", F.least("_n", F.lit(window)))
    hashes = F.when(F.col("_n") >= window, window_hashes(F.col("_words"), F.col("_n"), window)).otherwise(F.array(F.xxhash64("_words")))
    df = df.withColumn("_h", F.array_sort(F.array_distinct(hashes))).withColumn("n_item", F.size("_h").cast("long"))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double"))))
    df = df.withColumn("_k", F.floor(largest * (1 - share)) + 1)
    return df.select("item", "item_id", "size", "n_item", "_k", F.posexplode("_h").alias("_rank", "h")).select("item", "item_id", "size", "h", "n_item", (F.col("_rank") < F.col("_k")).alias("in_sketch"))


def find_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.75, window: int = 5, broadcast_rows: int = 1_000_000, with_copy: bool = False
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every item of which a document holds `share` or more.

    with_copy adds the hash of the text, which tells rows of one id apart.
    """
    table = item_shingles(items, item_id, item_text, share, window)
    sizes = {r["size"]: r["count"] for r in table.groupBy("size").count().collect()}  # a row for each shingle size, five at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], T.StructType(MATCHES.fields + [T.StructField("copy", T.LongType())] * with_copy))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumn("copy", F.xxhash64("_text"))
    sized = lambda n: F.transform(window_hashes(F.col("_words"), F.col("_n"), n), lambda h: F.struct(F.lit(n).alias("size"), h.alias("h")))
    made = [sized(n) for n in sorted(sizes)]
    probes = _tokens(texts, "_text").select("doc_id", "copy", F.explode(made[0] if len(made) == 1 else F.concat(*made)).alias("s")).select("doc_id", "copy", "s.size", "s.h")
    sketches = table.filter("in_sketch").select("size", "h", "item")
    sketches = F.broadcast(sketches) if sum(sizes.values()) <= broadcast_rows else sketches
    candidates = probes.join(sketches, ["size", "h"]).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy_of"), "item").distinct()
    # Texts are read again for candidates alone, and their shares counted exactly.
    wanted = table.groupBy("item", "item_id", "size", "n_item").agg(F.collect_set("h").alias("_wanted"))
    again = candidates.join(wanted, "item").hint("shuffle_hash")
    pairs = texts.join(again, (F.col("copy") == F.col("_copy_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["doc_id", "copy", "item"])
    there = F.array().cast("array<bigint>")
    for n in sizes:
        there = F.when(F.col("size") == n, window_hashes(F.col("_words"), F.col("_n"), n)).otherwise(there)
    # A row for each hash: an array compared in place would be worked out again wherever the planner repeats it.
    held = _tokens(pairs, "_text").select("doc_id", "copy", "item", "item_id", "n_item", "_wanted", F.explode(there).alias("h"))
    shared = held.filter(F.array_contains("_wanted", F.col("h"))).groupBy("doc_id", "copy", "item", "item_id", "n_item").agg(F.countDistinct("h").alias("n_shared"))
    shared = shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= share)
    return shared.select(*MATCHES.names, *["copy"] * with_copy)
