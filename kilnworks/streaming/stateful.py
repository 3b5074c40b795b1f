"""Telemetry by event time on keyed state: rows wait until the watermark has passed them, so their order of arrival is of no account.

State lives in RocksDB. Rows of an entity are held for the allowed lateness at most; what Spark finds later than the
watermark it drops and counts (numRowsDroppedByWatermark in the progress of the query). A timer of each entity fires
when its next rows or its next bin are due, or when it has been idle too long; the state of an idle entity goes away.
Both operators give what their batch forms in operators/telemetry.py give on the rows up to the watermark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an entity that are put in order at once, about.
STRETCH = 1 << 19


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.withColumn(ts, F.col(ts).cast("timestamp_ltz")).withWatermark(ts, late).withColumn("us", F.unix_micros(ts))


def _ms(us: int) -> int:
    """The first whole millisecond not before a time; timers know milliseconds only."""
    return -(-us // 1000)


def _packed(part: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(part, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class _Waiting(StatefulProcessor):
    """Rows that wait for the watermark, in the list state `rows` as compressed Arrow batches (times in microseconds first), the least of them, and one timer.

    No more than one batch and one stretch of about STRETCH rows are held as columns, and no row as a Python object before its bin is due.
    """

    memory_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "lo long, hi long, n long, data binary")
        self.least = handle.getValueState("least", "us long")
        self.memory = handle.getValueState("memory", self.memory_schema)

    def first(self) -> int | None:
        """The least time that waits."""
        return self.least.get()[0] if self.least.exists() else None

    def append(self, part: pd.DataFrame) -> int | None:
        """Lets rows wait; gives the least time that waits now."""
        part, least = part.dropna(subset=["us"]), self.first()
        if len(part):
            lo, hi = int(part["us"].min()), int(part["us"].max())
            self.rows.appendValue((lo, hi, len(part), _packed(part)))
            if least is None or lo < least:
                least = lo
                self.least.update((least,))
        return least

    def last_due(self, bound: int) -> tuple[int, int | None]:
        """How many rows are at most as late as the bound (at most), and the latest of them."""
        n, last = 0, None
        for lo, hi, size, data in self.waiting():
            if lo <= bound:
                n += size
                own = hi if hi <= bound else int(_unpacked(data)["us"].loc[lambda us: us <= bound].max())
                last = own if last is None else max(last, own)
        return n, last

    def waiting(self) -> Iterator[tuple]:
        return iter(self.rows.get()) if self.rows.exists() else iter(())

    def between(self, start: int, stop: int) -> pd.DataFrame:
        """The rows from start until before stop, in order of all their columns."""
        parts = []
        for lo, hi, _, data in self.waiting():
            if lo < stop and hi >= start:
                part = _unpacked(data)
                parts.append(part[(part["us"] >= start) & (part["us"] < stop)])
        made = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        return made.sort_values(list(made.columns), ignore_index=True, na_position="last") if len(made) else made

    def stretches(self, n: int, start: int, stop: int, width: int = 1) -> Iterator[tuple[int, int]]:
        """Stretches of time from start until before stop, as many as n rows need, cut at multiples of the width."""
        step = max(1, -(-(stop - start) // max(1, -(-n // STRETCH)) // width)) * width
        at = start // width * width
        while at < stop:
            yield at, min(at + step, stop)
            at += step

    def drop_due(self, bound: int) -> int | None:
        """Lets go of the rows up to the bound; gives the least time of the rest."""
        rest, least = [], None
        for lo, hi, n, data in self.waiting():
            if hi > bound:
                if lo <= bound:
                    part = _unpacked(data)
                    part = part[part["us"] > bound]
                    lo, n, data = int(part["us"].min()), len(part), _packed(part)
                rest.append((lo, hi, n, data))
                least = lo if least is None else min(least, lo)
        if rest:
            self.rows.put(rest)
            self.least.update((least,))
        else:
            self.rows.clear()
            self.least.clear()
        return least

    def alarm(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def forget(self) -> None:
        self.rows.clear()
        self.least.clear()
        self.memory.clear()

    def close(self) -> None:
        pass


class _Alerts(_Waiting):
    memory_schema = "flags array<int>, before boolean, last long"

    def __init__(self, k: int, n: int, idle_us: int) -> None:
        self.k, self.n, self.idle = k, n, idle_us

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = self.first()
        for part in rows:
            least = self.append(pd.DataFrame({"us": part["us"], "hot": part["hot"].eq(True).fillna(False).astype(bool)}))
        if least is not None:
            self.alarm(_ms(least))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        n, latest = self.last_due(mark)
        flags, before, last = self.memory.get() if self.memory.exists() else ([], False, 0)
        flags = list(flags)
        for start, stop in self.stretches(n, self.first(), latest + 1) if n else ():
            due = self.between(start, stop)
            if not len(due):
                continue
            every = np.concatenate([np.array(flags, dtype=np.int64), due["hot"].to_numpy(np.int64)])
            total = np.concatenate([[0], np.cumsum(every)])
            end = np.arange(len(flags), len(every)) + 1
            alert = (end >= self.n) & (total[end] - total[np.maximum(end - self.n, 0)] >= self.k)
            made = pd.DataFrame({"us": due["us"].to_numpy(np.int64), "alert": alert, "start": alert & ~np.concatenate([[before], alert[:-1]])})
            made.insert(0, "entity", [key[0]] * len(made))
            flags, before = every[-self.n :].tolist(), bool(alert[-1])
            yield made
        rest = self.drop_due(mark)
        last = latest if n else last
        if not n and rest is None and last + self.idle <= mark:
            self.forget()
            return
        self.memory.update((flags, before, last))
        self.alarm(_ms(last + self.idle if rest is None else rest))


def ordered_alerts(stream: DataFrame, entity: str, ts: str, flag: str, k: int, n: int, late: str = "10 minutes", idle_s: int = 86_400) -> DataFrame:
    """entity, ts, alert (k of the last n flags by event time) and start (first alert of a run), once the watermark has passed a row.

    A null flag counts as not hot. An entity without rows for `idle_s` seconds of event time starts anew when it returns.
    """
    timed = _timed(stream, ts, late)
    kind = dict(timed.dtypes)
    rows = timed.select(F.col(entity).alias("entity"), ts, "us", F.col(flag).alias("hot"))
    made = rows.groupBy("entity").transformWithStateInPandas(_Alerts(k, n, idle_s * 1_000_000), f"entity {kind[entity]}, us long, alert boolean, start boolean", "Append", "EventTime")
    return made.select(F.col("entity").alias(entity), F.timestamp_micros("us").alias(ts), "alert", "start")


def _known(values: list) -> list[float]:
    return [v for v in values if v is not None]


class _Bins(_Waiting):
    def __init__(self, width_us: int, analog: int, digital: int, idle_us: int) -> None:
        self.width, self.analog, self.digital, self.idle = width_us, analog, digital, idle_us
        signals = [*(f"a{k} double" for k in range(analog)), *(f"d{k} double" for k in range(digital))]
        self.memory_schema = ", ".join(["seen boolean", "bin long", "last long", *signals])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = self.first()
        for part in rows:
            least = self.append(part.drop(columns=["entity"]))
        if least is not None:
            at = least // self.width
            if self.memory.exists():
                at = min(at, self.memory.get()[1])
            self.alarm(_ms((at + 1) * self.width))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        closed = mark // self.width  # bins before this one are over
        n, latest = self.last_due(closed * self.width - 1)
        first = self.first()
        seen, at, last, *before = self.memory.get() if self.memory.exists() else (False, first // self.width, first, *[None] * (self.analog + self.digital))
        end = min(closed, (max(last, last if latest is None else latest) + self.idle) // self.width + 1)
        begin = min(at * self.width, first) if n else at * self.width
        for start, stop in self.stretches(n, begin, max(end * self.width, at * self.width), self.width):
            # The first of each time, by tie.
            due = self.between(start, stop)
            due = due.drop_duplicates("us", ignore_index=True) if len(due) else due
            edges = np.searchsorted(due["us"].to_numpy() if len(due) else np.zeros(0), np.arange(max(at, start // self.width), -(-stop // self.width) + 1) * self.width)
            out = []
            for k, b in enumerate(range(max(at, start // self.width), -(-stop // self.width))):
                own = [(int(r[0]), r[1], *(None if v is None or v != v else float(v) for v in r[2:])) for r in due.iloc[edges[k] : edges[k + 1]].itertuples(index=False, name=None)]
                row, before, seen = self.summary(own, list(before), seen)
                out.append((key[0], b * self.width, *row))
                last = own[-1][0] if own else last
            if out:
                yield pd.DataFrame(out, columns=["entity", "us", "samples", *self.names()])
        rest = self.drop_due(closed * self.width - 1)
        if rest is None and last + self.idle <= mark:
            self.forget()
        else:
            self.memory.update((seen, max(at, end), last, *before))
            self.alarm(_ms((max(at, end) + 1) * self.width))

    def names(self) -> list[str]:
        parts = [f"a{k}_{x}" for k in range(self.analog) for x in ("mean", "std", "min", "max", "last", "first", "move")]
        return parts + [f"d{k}_{x}" for k in range(self.digital) for x in ("active", "last", "transitions")]

    def summary(self, rows: list[tuple], before: list, seen: bool) -> tuple[list, list, bool]:
        """The figures of a bin, and the values of its last row (or those before it)."""
        out: list = [len(rows)]
        for k in range(self.analog + self.digital):
            line = [r[2 + k] for r in rows]
            known = _known(line)
            prior = [before[k], *line[:-1]]
            if k < self.analog:
                moves = _known([abs(a - b) if a is not None and b is not None else None for a, b in zip(line, prior, strict=False)])
                mean = math.fsum(known) / len(known) if known else None
                out += [mean, float(np.std(known)) if known else None, min(known, default=None), max(known, default=None), known[-1] if known else None, known[0] if known else None, math.fsum(moves) / len(moves) if moves else None]
            else:
                changes = [a is None or b is None or a != b for a, b in zip(line, prior, strict=False)]
                if rows and not seen:
                    changes[0] = True
                out += [math.fsum(known) / len(known) if known else None, known[-1] if known else None, sum(changes) if rows else None]
        return out, (list(rows[-1][2:]) if rows else before), seen or bool(rows)


def closed_bins(
    stream: DataFrame, entity: str, ts: str, width_s: int, analog: list[str], digital: list[str], expected: int, coverage: float = 0.8, tie: Column | None = None, late: str = "10 minutes", idle_s: int = 86_400
) -> DataFrame:
    """The columns of `telemetry.bin_features` for each bin that the watermark has passed, empty bins included.

    Differences, transitions and last values cross the edges of bins. Of rows of one time the least by `tie` counts. An
    idle entity gets empty bins for `idle_s` seconds after its last row; if it returns later, its grid begins anew.
    """
    timed = _timed(stream, ts, late).filter(F.col(ts).isNotNull())
    kind = dict(timed.dtypes)
    signals = [F.col(c).cast("double").alias(f"{x}{k}") for x, names in (("a", analog), ("d", digital)) for k, c in enumerate(names)]
    rows = timed.select(F.col(entity).alias("entity"), "us", (F.lit("") if tie is None else tie.cast("string")).alias("tie"), *signals)
    bins = _Bins(width_s * 1_000_000, len(analog), len(digital), idle_s * 1_000_000)
    out = ", ".join([f"entity {kind[entity]}", "us long", "samples long", *(f"{c} double" for c in bins.names())])
    made = rows.groupBy("entity").transformWithStateInPandas(bins, out, "Append", "EventTime")
    names = {f"a{k}": c for k, c in enumerate(analog)} | {f"d{k}": c for k, c in enumerate(digital)}
    columns = []
    for c in bins.names():
        signal, what = c.split("_")
        value = F.col(c).cast("long") if what == "transitions" else F.col(c).cast(kind[names[signal]]) if what == "last" or what in ("min", "max", "first") else F.col(c)
        columns.append(value.alias(f"{names[signal]}_{what}"))
    made = made.select(F.col("entity").alias(entity), F.timestamp_micros("us").cast("timestamp_ntz").alias("bin"), "samples", *columns)
    made = made.withColumns({f"{c}_range": F.col(f"{c}_max") - F.col(f"{c}_min") for c in analog} | {f"{c}_change": F.col(f"{c}_last") - F.col(f"{c}_first") for c in analog})
    return made.withColumn("coverage", F.col("samples") / F.lit(expected)).withColumn("valid", F.col("coverage") >= coverage)
