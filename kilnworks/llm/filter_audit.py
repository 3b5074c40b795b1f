"""What each filter removes in each order of filters.

Five filters are judged once for each document and become a mask of five bits; counts by part and mask hold everything
that any order of the filters can show, so no order is run. Four filters look at the text alone. The fifth asks whether
a document of a smaller id has the same text, which a counting Bloom filter prepares: each text adds one to PROBES
counters of the bucket of its hash; the counters of all tasks are added up, and those of two or more become one bitmap
for each bucket. A text with a counter below two stands alone, for sure. Only the others are shuffled, whole, for the
least id of each; a document of such a text fails if it isn't the one of least id.

The bitmaps have CELLS bits for each document and are broadcast, as they are bounded by BUCKETS (128 MB, enough for 67
million documents); larger tables get as many bits, so more lone texts are shuffled, with the same result.

Edge cases: a null text is empty, a null source (part) too; documents without an id never fail the fifth filter and
make none fail; rows that repeat id and text don't make each other fail; repeated labels of a document count if any of
them holds; labels without an id are no one's; a part has all its rows though all counts are zero; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.scratch import cut

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Bits of a bitmap as Spark builds them; bitmaps at most; bits for each document; counters for each text.
BITS, BUCKETS, CELLS, PROBES = 32_768, 32_768, 16, 4


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: few words, few different words, many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(fails)), F.lit(0))


def _probes(hashed: Column) -> list[Column]:
    """The places of a text's counters in its bucket."""
    return [F.xxhash64(hashed, F.lit(k)).bitwiseAND(F.lit(BITS - 1)).cast("int") for k in range(PROBES)]


def repeat_sketch(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """From column `hash` of all rows: the bitmap (of counters that reached two) of each bucket that has one, and the number of buckets."""
    buckets = max(1, min(BUCKETS, -(-rows * CELLS // BITS)))
    cells = hashes.select(F.pmod("hash", F.lit(buckets)).alias("bucket"), F.explode(F.array_distinct(F.array(*_probes(F.col("hash"))))).alias("cell"))
    counters = cells.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    return counters.filter("n >= 2").groupBy("bucket").agg(F.bitmap_construct_agg("cell").alias("bitmap")), buckets


def possible_repeats(rows: DataFrame, sketch: DataFrame, buckets: int) -> DataFrame:
    """rows (with column `hash`) and column `repeats`, false where the text stands alone."""
    byte = lambda at: F.conv(F.hex(F.substring("bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bits = [byte(at).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), at % 8 + 1)) != 0 for at in _probes(F.col("hash"))]
    met = bits[0]
    for bit in bits[1:]:
        met = met & bit
    return rows.withColumn("bucket", F.pmod("hash", F.lit(buckets))).join(F.broadcast(sketch), "bucket", "left").withColumn("repeats", F.coalesce(met, F.lit(False))).drop("bucket", "bitmap")


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, mask and n: how many documents of an id and part fail these filters."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    judged = cut(texts.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.xxhash64("text").alias("hash"), F.sha2("text", 256).alias("digest")), "audit-masks")
    sketch, buckets = repeat_sketch(judged.select("hash"), judged.count())
    sketch = cut(sketch, "audit-sketch")
    again = possible_repeats(texts.select("doc_id", "text", F.xxhash64("text").alias("hash")), sketch, buckets).filter("repeats")
    least = again.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select(F.sha2("text", 256).alias("digest"), "doc_id", F.lit(True).alias("first"))
    judged = possible_repeats(judged, sketch, buckets)
    # One row for each id, part and text, so that rows that are all alike don't meet in one task of the join.
    repeats = judged.filter("repeats").groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")).join(least, ["digest", "doc_id"], "left")
    failed = F.col("doc_id").isNotNull() & F.col("first").isNull()
    repeats = repeats.select("doc_id", "part", F.when(failed, F.col("mask") + REPEAT).otherwise(F.col("mask")).alias("mask"), "n")
    return judged.filter("not repeats").select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n")).unionByName(repeats)


def counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", **columns: str) -> DataFrame:
    """part, mask, n, good and toxic: documents of each part that fail exactly these filters, and how many of them have these labels."""
    marks = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    rows = masks(docs, doc_id, **columns).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "doc_id", "left")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("bad").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    parts = counts(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 masks at most
    orders = F.array(*[F.lit("".join(x)) for x in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    step, order = F.col("step"), F.col("filter_order")
    bits = {name: 1 << k for k, name in enumerate(FILTERS)}
    earlier = sum((F.when(F.instr(order, name) < step, bit).otherwise(0) for name, bit in bits.items()), F.lit(0))
    own = sum((F.when(F.instr(order, name) == step, bit).otherwise(0) for name, bit in bits.items()), F.lit(0))
    rows = rows.withColumns({"earlier": earlier, "own": own})
    before, here = (lambda m: m["mask"].bitwiseAND(F.col("earlier")) != 0), (lambda m: m["mask"].bitwiseAND(F.col("own")) != 0)
    total = lambda which, value: F.aggregate("masks", F.lit(0).cast("long"), lambda n, m: n + F.when(which(m), value(m)).otherwise(F.lit(0).cast("long")))
    gone = lambda m: here(m) & ~before(m)
    n = lambda m: m["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~here(m) & ~before(m), n).alias("kept"),
        total(gone, n).alias("removed"),
        total(lambda m: here(m) & before(m), n).alias("redundant"),
        total(lambda m: m["mask"] == F.col("own"), n).alias("unique_fails"),
        total(gone, lambda m: m["good"]).alias("good_lost"),
        total(gone, lambda m: m["toxic"]).alias("toxic_lost"),
        # A filter comes first among those that a document fails in one of as many of the 120 orders as it fails filters.
        total(here, lambda m: m["n"] * (120 / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )
