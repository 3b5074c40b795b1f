"""Windows over long series, computed in blocks of rows.

A window by entity alone puts the whole series of an entity into one task. Here the rows of an entity are numbered
without such a window (counts by stretch of time, summed up, plus a number inside the stretch), cut into blocks of equal
size, and each block also gets the last `halo` rows before it. Whatever looks back no further than the halo then comes out
the same in its block, by windows over (entity, block); rows of the halo are dropped afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block beside its halo, and the stretch of time within which rows are numbered by a window.
BLOCK, STRETCH_S = 65_536, 7 * 86_400


def numbered(df: DataFrame, entity: str, ts: str, name: str, stretch_s: int = STRETCH_S) -> DataFrame:
    """df with the place (from 0) of each row in the time order of its entity. Rows without a time come first; times of an entity must differ, else their order is open."""
    stretch = F.floor(F.unix_seconds(F.col(ts).cast("timestamp_ltz")) / stretch_s)
    df = df.withColumn("_stretch", F.coalesce(stretch, F.lit(-(1 << 60))))
    held = df.groupBy(entity, "_stretch").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(entity).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(F.col(entity).alias("_e"), F.col("_stretch").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each stretch
    within = F.row_number().over(Window.partitionBy(entity, "_stretch").orderBy(ts)) - 1
    made = df.withColumn("_within", within).join(held, F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_stretch") == F.col("_s")))
    return made.withColumn(name, F.col("_before") + F.col("_within")).drop("_stretch", "_within", "_e", "_s", "_before")


def in_blocks(df: DataFrame, entity: str, ts: str, halo: int, compute: Callable[[DataFrame, list[str]], DataFrame], block: int = BLOCK, stretch_s: int = STRETCH_S) -> DataFrame:
    """compute(rows, keys) on blocks with `halo` rows before each; `keys` replace the entity in its windows.

    compute may add columns and repeat rows; it has to keep the columns that begin with an underscore.
    """
    place = numbered(df, entity, ts, "_place", stretch_s)
    own = F.floor(F.col("_place") / block)
    # A row stands in its own block and, as halo, in each later block that begins within `halo` rows behind it.
    last = F.floor((F.col("_place") + halo) / block)
    cut = place.withColumn("_block", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_block") == own)
    return compute(cut, [entity, "_block"]).filter("_own").drop("_place", "_block", "_own")


class SlidingOrder:
    """The known values of a moving frame in order: one value enters, one leaves, and any rank is read, each in O(log w) steps.

    Values lie in chunks of about sqrt(w); a search over the chunks' ends finds the one to change.
    """

    def __init__(self, load: int = 512) -> None:
        self.load, self.chunks, self.n = load, [[]], 0

    def _chunk(self, value: float) -> int:
        return min(bisect_left([c[-1] for c in self.chunks if c], value), len(self.chunks) - 1) if self.n else 0

    def add(self, value: float) -> None:
        k = self._chunk(value)
        chunk = self.chunks[k]
        insort(chunk, value)
        self.n += 1
        if len(chunk) > 2 * self.load:
            self.chunks[k : k + 1] = [chunk[: self.load], chunk[self.load :]]

    def remove(self, value: float) -> None:
        k = self._chunk(value)
        chunk = self.chunks[k]
        del chunk[bisect_left(chunk, value)]
        self.n -= 1
        if not chunk and len(self.chunks) > 1:
            del self.chunks[k]

    def __getitem__(self, rank: int) -> float:
        for chunk in self.chunks:
            if rank < len(chunk):
                return chunk[rank]
            rank -= len(chunk)
        raise IndexError(rank)

    def quantile(self, q: float) -> float:
        """Interpolated between the ranks around q."""
        at = q * (self.n - 1)
        low = int(at)
        a = self[low]
        return a if low == at else a + (self[low + 1] - a) * (at - low)


def sliding_quantiles(values: Iterable[float | None], quantiles: list[float], lag: int, lookback: int, least: int) -> list[list[float] | None]:
    """For each value the quantiles of the known ones among the `lookback` values that end `lag` before it; None below `least` of them."""
    order, frame, waiting, out = SlidingOrder(), deque(), deque(), []
    for value in values:
        waiting.append(None if value is None or value != value else float(value))
        if len(waiting) > lag:
            new = waiting.popleft()
            frame.append(new)
            if new is not None:
                order.add(new)
            if len(frame) > lookback and (old := frame.popleft()) is not None:
                order.remove(old)
        out.append([order.quantile(q) for q in quantiles] if order.n >= max(least, 1) else None)
    return out


def trailing_quantiles(
    df: DataFrame, entity: str, ts: str, score: str, quantiles: list[float], lag: int, lookback: int, least: int, name: str, block: int = BLOCK, stretch_s: int = STRETCH_S
) -> DataFrame:
    """entity, ts, score and array `name`: exact quantiles of the scores in the `lookback` rows that end `lag` rows before each; null below `least` known ones.

    A block with its halo goes to one task; its frame moves by one value in and one out.
    """
    kind = dict(df.dtypes)
    out = f"{entity} {kind[entity]}, {ts} {kind[ts]}, {score} {kind[score]}, {name} array<double>, _own boolean, _place long, _block long"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        part[name] = sliding_quantiles(part[score].tolist(), quantiles, lag, lookback, least)
        return part[part["_own"]][[entity, ts, score, name, "_own", "_place", "_block"]]

    return in_blocks(df.select(entity, ts, score), entity, ts, lag + lookback - 1, lambda rows, keys: rows.groupBy(*keys).applyInPandas(one, out), max(block, lag + lookback), stretch_s)
