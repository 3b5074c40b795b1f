"""Rows that wait for the watermark: held as batches, put in order a stretch at a time."""

import numpy as np
import pandas as pd
import pytest

from kilnworks.streaming import stateful


class _State:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, value):
        self.held = value

    put = update

    def appendValue(self, value):  # noqa: N802
        self.held = [*(self.held or []), value]

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.timers = []

    getListState = getValueState = lambda self, *a: _State()
    listTimers = lambda self: list(self.timers)
    deleteTimer = lambda self, at: self.timers.remove(at)
    registerTimer = lambda self, at: self.timers.append(at)


class _Times:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def _run(processor, batches, marks):
    processor.init(_Handle())
    out = []
    for parts, mark in zip(batches, marks, strict=True):
        list(processor.handleInputRows((1,), iter(parts), None))
        assert all(isinstance(r[3], bytes) for r in processor.rows.get())
        while processor.handle.timers and processor.handle.timers[0] <= mark:
            processor.handle.timers.clear()
            out += list(processor.handleExpiredTimer((1,), _Times(mark), None))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("stretch", [1, 7, 1 << 19])
def test_alerts_and_bins_do_not_depend_on_stretches(monkeypatch, stretch):
    monkeypatch.setattr(stateful, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    us = rng.integers(0, 400, 300) * 1000
    rows = pd.DataFrame({"us": us, "hot": rng.random(300) < 0.5})
    early, late = rows[rows.us < 200_000], rows[rows.us >= 150_000]
    early = early[early.us < 150_000]
    got = _run(stateful._Alerts(2, 3, 10**9), [[early.iloc[:40], early.iloc[40:]], [late]], [120, 500])
    order = rows.sort_values(["us", "hot"], ignore_index=True)
    alert = order.hot.astype(int).rolling(3).sum() >= 2
    assert got.us.tolist() == order.us.tolist() and got.alert.tolist() == alert.tolist()
    assert got.start.tolist() == (alert & ~alert.shift(fill_value=False)).tolist()

    signals = pd.DataFrame({"entity": 1, "us": us, "tie": [f"{k:03d}" for k in rng.permutation(300)], "a0": rng.random(300), "d0": rng.integers(0, 2, 300).astype(float)})
    signals.loc[::9, "a0"] = None
    early, late = signals[signals.us < 150_000], signals[signals.us >= 150_000]
    made = _run(stateful._Bins(10_000, 1, 1, 10**9), [[early.iloc[:40], early.iloc[40:]], [late]], [121, 400])
    one = signals.sort_values(["us", "tie"]).drop_duplicates("us").reset_index(drop=True)
    by = one.groupby(one.us // 10_000)
    assert made.us.tolist() == list(range(int(us.min()) // 10_000 * 10_000, 400_000, 10_000))
    assert made.samples.tolist() == by.size().tolist()
    assert np.allclose(made.a0_mean, by.a0.mean()) and made.a0_max.tolist() == by.a0.max().tolist()
    changes = one.d0.ne(one.d0.shift()).groupby(one.us // 10_000).sum()
    assert made.d0_transitions.tolist() == changes.tolist()
