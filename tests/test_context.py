"""Range statistics of an index against NumPy."""

import datetime as dt
import random

import numpy as np
import pytest

from firstprint.operators import context as C
from pyspark.sql import functions as F


@pytest.mark.parametrize("broadcast", [True, False])
def test_range_volatility_is_merged_from_pieces(spark, monkeypatch, broadcast):
    """All lengths and both sides of every block; a flat stretch behind wild ones has volatility 0 exactly."""
    if not broadcast:
        monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", 10)
    rng, start = np.random.default_rng(3), dt.date(2019, 1, 1)
    closes = {"A": np.exp(np.cumsum(rng.normal(0, 0.02, 300))) * 100, "B": np.exp(np.cumsum(rng.normal(0, 1e-7, 77))) * 5e6, "C": np.array([7.0])}
    closes["A"][200:260] = closes["A"][200]
    days = {s: [start + dt.timedelta(days=int(3 * i + i % 2)) for i in range(len(c))] for s, c in closes.items()}
    bars = spark.createDataFrame([(s, d, float(c) * 0.99, float(c)) for s in closes for d, c in zip(days[s], closes[s])],
                                 "index_symbol string, d date, open double, close double")
    draw, rows = random.Random(5), []
    for i in range(400):
        s = draw.choice("AABC")
        a = draw.randint(-5, 3 * len(closes[s]) + 5)
        rows.append((i, s, start + dt.timedelta(days=a), start + dt.timedelta(days=a + draw.choice([0, 1, 3, 9, 30, 200, 900]))))
    rows += [(400, "A", days["A"][201], days["A"][259]), (401, "Z", start, start + dt.timedelta(days=9))]
    windows = spark.createDataFrame(rows, "id int, ix string, win_start date, win_end date")
    got = {r.id: r for r in C.with_index_stats(windows, C.index_calendar(bars), F.col("ix"), "x").collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"id", "ix", "win_start", "win_end", "x_n", "x_return", "x_vol"}
    checked = 0
    for i, s, lo, hi in rows:
        at = [k for k, d in enumerate(days.get(s, [])) if lo <= d < hi]
        assert (got[i].x_n or 0) == len(at)
        if len(at) > 2:
            want = np.std(np.diff(np.log(closes[s][at])), ddof=1)
            assert got[i].x_vol == pytest.approx(want, rel=1e-12, abs=0) if want else got[i].x_vol == 0.0
            checked += 1
        elif at:
            assert got[i].x_vol == 0.0
    assert checked > 150 and got[400].x_vol == 0.0
