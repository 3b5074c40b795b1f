"""Packing into optimal length buckets.

The histogram of lengths over all documents has a row for each length that occurs. A corpus of w words has at most
sqrt(2 w) different lengths, so the histogram of five thousand million words has at most 100,000 rows. Dynamic
programming over them picks the bucket boundaries with the least padding in all; the first length of the last bucket
never falls as lengths grow, so each step searches by halves. Inside a bucket, documents are numbered and cut into
batches whose padded size stays within a token budget (a document longer than the budget is a batch of its own).

Lengths are counts of word pieces under the vocabulary of `token_counts`, unless another length is given. Numbers come
from counts by hash shard, summed up, and a row number inside each shard; a bucket that holds most documents therefore
spreads over as many tasks as it has shards, and so do rows that are all alike, as the hash takes in their place.

Edge cases: null and empty texts have length 0 and go to the smallest bucket; an empty table gives an empty result;
repeated rows take slots of their own; ids may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm.scratch import cut
from kilnworks.llm.token_counts import count_tokens

BUCKETS = 16
BUDGET = 16_384
SHARD_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _extend(best: np.ndarray, top: np.ndarray, rows: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of cells 0 to j with one bucket more than in `best`, and the first cell of its last bucket, for each j of 1 or more.

    The padding fulfils the quadrangle inequality, so the first cell for j lies between those for cells on both sides
    of j: middles are solved level by level, all of a level at once.
    """
    n = len(top)
    now, first = np.full(n, np.inf), np.full(n, -1, dtype=np.int64)
    a, b, low, high = (np.array([x], dtype=np.int64) for x in (1, n - 1, 1, n - 1))
    while len(a):
        mid = (a + b) // 2
        size = np.minimum(high, mid) - low + 1
        ends = np.cumsum(size)
        starts = ends - size
        i = np.arange(ends[-1]) - np.repeat(starts - low, size)
        j = np.repeat(mid, size)
        value = best[i - 1] + top[j] * (rows[j + 1] - rows[i]) - (total[j + 1] - total[i])
        least = np.minimum.reduceat(value, starts)
        at = np.minimum.reduceat(np.where(value == np.repeat(least, size), i, n), starts)
        now[mid], first[mid] = least, at
        a, b, low, high = np.concatenate([a, mid + 1]), np.concatenate([mid - 1, b]), np.concatenate([low, at]), np.concatenate([at, high])
        keep = a <= b
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
    return now, first


def boundaries(cells: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most `buckets` buckets with the least padding, from (greatest length, rows, summed length) of each cell."""
    if not cells:
        return []
    cells = sorted(cells)
    top = np.array([c[0] for c in cells], dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum([float(c[1]) for c in cells])])
    total = np.concatenate([[0.0], np.cumsum([float(c[2]) for c in cells])])
    n = len(cells)
    best, back = top * rows[1:] - total[1:], [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        now, first = _extend(best, top, rows, total)
        back.append(np.where(now < best, first, -1))
        best = np.minimum(now, best)
    out, j = [], n - 1
    for k in range(len(back) - 1, -1, -1):
        first = int(back[k][j])
        if first < 0:
            continue
        out.append(int(top[j]))
        j = first - 1
        if j < 0:
            break
    return sorted(out)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, slot and padding of each row; batches are numbered inside their bucket from 0."""
    columns = [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy")]
    if length is None:
        sizes = count_tokens(docs.select(*columns, F.col(text).alias("text"))).select("doc_id", "copy", "n_tokens")
    else:
        sizes = docs.select(*columns, length.cast("long").alias("n_tokens"))
    sizes = cut(sizes.withColumn("place", F.monotonically_increasing_id()), "lengths")
    counts = sizes.groupBy("n_tokens").count().collect()
    tops = boundaries([(size, rows, size * rows) for size, rows in counts], buckets)
    shards = max(1, -(-sum(rows for _, rows in counts) // SHARD_ROWS))
    bucket = F.lit(max(len(tops) - 1, 0))
    limit = F.lit(tops[-1] if tops else 0)
    for k in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= tops[k], k).otherwise(bucket)
        limit = F.when(F.col("n_tokens") <= tops[k], tops[k]).otherwise(limit)
    placed = sizes.withColumns({"bucket": bucket.cast("int"), "bucket_tokens": limit.cast("long"), "shard": F.pmod(F.xxhash64("doc_id", "copy", "place"), F.lit(shards))})
    held = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = placed.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "copy", "place")) - 1).join(held, ["bucket", "shard"])
    in_batch = F.greatest(F.lit(1), F.floor(budget / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    at = F.col("before") + F.col("row")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(at / in_batch).cast("long").alias("batch"), (at % in_batch).cast("int").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )
