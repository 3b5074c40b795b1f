"""Which rows may have a key of a list, so that only those, not all texts, are shuffled to be compared with it.

Keys of the list set one bit each, CELLS bits for a key, in bitmaps that are broadcast; BUCKETS bounds them to 128 MB.
A row whose bit is not set is surely not on the list; others are joined with the list itself, so bits decide cost alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.scratch import cut

#: Bits of a bitmap as Spark builds them; bitmaps at most; bits for each key.
BITS, BUCKETS, CELLS = 32_768, 32_768, 16


def _cell(key: str) -> Column:
    return F.xxhash64(F.col(key), F.lit(1)).bitwiseAND(F.lit(BITS - 1)).cast("int")


def apart(rows: DataFrame, listed: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """rows that surely have no key of the list, and rows that may have one; listed is read twice, so it should be a written table."""
    buckets = max(1, min(BUCKETS, -(-listed.count() * CELLS // BITS)))
    bucket = F.pmod(F.col(key), F.lit(buckets)).alias("_bucket")
    bitmaps = cut(listed.select(bucket, _cell(key).alias("cell")).groupBy("_bucket").agg(F.bitmap_construct_agg("cell").alias("_bitmap")), "sketch")
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(_cell(key), 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), _cell(key) % 8 + 1)) != 0
    seen = rows.withColumn("_bucket", bucket).join(F.broadcast(bitmaps), "_bucket", "left").withColumn("_seen", F.coalesce(bit, F.lit(False)))
    side = lambda test: seen.filter(test).select(*rows.columns)
    return side(~F.col("_seen")), side("_seen")
