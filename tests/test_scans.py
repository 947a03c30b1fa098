"""Blocked scans against pandas, and plans of what must not sort whole symbols."""

import datetime
from collections import deque

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import finance, recursive, scans


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(9)
    rows, start = [], datetime.date(2019, 12, 20)
    for s, n in (("long", 900), ("short", 3), ("one", 1), ("gaps", 400)):
        for i in range(n):
            v = None if s == "gaps" and (i < 5 or i % 7 == 0 or 100 < i < 220) else float(100 + r.normal() * 10)
            rows.append((s, start + datetime.timedelta(days=i if s != "gaps" else i * 3), v, "kept"))
    return spark.createDataFrame(rows, "symbol string, Date date, Close double, other string").repartition(4)


@pytest.mark.parametrize("args", [{"span": 12}, {"com": 13, "least": 0}, {"span": 200}, {"span": 2}])
@pytest.mark.parametrize("block", ["month", "year"])
def test_ema_across_blocks(series, args, block):
    got = scans.ema_scan(series, "Close", "e", block=block, **args).toPandas().sort_values(["symbol", "Date"])
    assert set(got.columns) == {"symbol", "Date", "Close", "other", "e"} and len(got) == series.count()
    for _, p in got.groupby("symbol"):
        want = recursive.ema(p["Close"].astype(float), **args)
        assert (p["e"].isna().to_numpy() == want.isna().to_numpy()).all()
        assert np.allclose(p["e"].astype(float), want, rtol=1e-12, atol=0, equal_nan=True)


def test_one_symbol_spreads_over_blocks(spark):
    rows = spark.range(0, 4000).selectExpr("'a' symbol", "date_add(DATE '2000-01-01', cast(id AS int)) Date", "cast(id % 17 AS double) Close")
    plan = scans.ema_scan(rows, "Close", "e", 12)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(symbol" in plan and "_block" in plan
    got = scans.macd_scan(rows).toPandas().sort_values("Date")
    want = recursive.macd(got[["Close"]])
    for c in ("macd", "macd_sign", "macd_diff"):
        assert np.allclose(got[c].astype(float), want[c], atol=1e-12, equal_nan=True)


def test_affine_scan():
    x = np.random.default_rng(1).normal(size=777)
    y, want = 0.0, []
    for v in x:
        y = 0.9 * y + v
        want.append(y)
    assert np.allclose(scans.affine_scan(x, 0.9), want, rtol=1e-12) and len(scans.affine_scan(x[:0], 0.9)) == 0


def test_drawdown_folds_months(series, spark):
    got = dict(finance.max_drawdown(series).collect())
    for s, p in series.toPandas().sort_values("Date").groupby("symbol"):
        v = p["Close"].dropna().to_numpy(dtype=float)
        assert abs(got[s] - (v / np.maximum.accumulate(v) - 1).min()) < 1e-15
    assert finance.max_drawdown(series.filter("Close is null")).filter("max_drawdown is not null").count() == 0
    plan = finance.max_drawdown(series)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [1, 2, 5, 25])
@pytest.mark.parametrize("kind", ["ties", "normal", "rising", "falling"])
def test_first_extreme_is_that_of_a_queue(n, kind):
    r = np.random.default_rng(n)
    x = {"ties": r.integers(0, 4, 203).astype(float), "normal": r.normal(size=203), "rising": np.arange(203.0), "falling": -np.arange(203.0)}[kind]
    queue, want = deque(), []
    for i, v in enumerate(x):
        while queue and x[queue[-1]] < v:
            queue.pop()
        queue.append(i)
        if queue[0] <= i - n:
            queue.popleft()
        want.append(queue[0])
    assert recursive.first_extreme(x, n).tolist() == want
    assert len(recursive.first_extreme(x[:0], n)) == 0


def test_mean_distance_of_windows():
    x = np.round(np.random.default_rng(2).normal(size=120) * 4) / 4
    mean, away = recursive.deviation_from_mean(x, 20)
    for i in range(len(x)):
        w = x[max(0, i - 19) : i + 1]
        assert np.isnan(away[i]) if len(w) < 20 else abs(away[i] - np.abs(w - w.mean()).mean()) < 1e-12 and abs(mean[i] - w.mean()) < 1e-12
    flat = pd.DataFrame({c: [2.0] * 30 for c in ("High", "Low", "Close")})
    assert recursive.cci(flat)["cci"].isna().all()
