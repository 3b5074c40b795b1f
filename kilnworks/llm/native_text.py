"""Word and shingle columns from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column, gap: str = SPACE) -> Column:
    """The words of a text between matches of gap; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def window_hashes(tokens: Column, n_tokens: Column, size: int) -> Column:
    """A 64-bit hash for each run of `size` words, in order; none when there are fewer words."""
    return F.when(
        n_tokens >= size,
        F.transform(F.sequence(F.lit(1), n_tokens - (size - 1)), lambda i: F.xxhash64(F.slice(tokens, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))
