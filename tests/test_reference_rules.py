"""Rules that the SQL twins could repeat wrongly, on panels small enough to work out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from marketloom import panel
from marketloom.operators import candles, indicators, recursive, trading

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, **more):
    rows = pd.DataFrame({"symbol": "x", "Date": [DAY + dt.timedelta(i) for i in range(len(closes))], "Close": np.array(closes, dtype=float)})
    for c in ("Open", "High", "Low", "AdjClose"):
        rows[c] = rows["Close"]
    rows["Volume"] = 10.0
    for c, v in more.items():
        rows[c] = v
    return spark.createDataFrame(rows)


def series(df, c):
    return df.orderBy("Date").toPandas()[c].tolist()


@pytest.mark.parametrize("after,split,factor", [(50, 2.0, 0.5), (66.7, 1.5, 1.0), (200, 0.5, 1.0), (1000, 0.1, 10.0)])
def test_split_adjust(spark, after, split, factor):
    b = bars(spark, [100, 100, after, after], Split=[1.0, 1.0, split, 1.0])
    assert series(panel.split_adjust(b), "AdjClose") == pytest.approx([100 * factor, 100 * factor, after * factor, after])


def test_clean_bars_looks_at_the_newest_row_as_given(spark):
    b = bars(spark, [1, 2, 3, 4], Volume=[10.0, 10.0, 10.0, 0.0], AdjClose=[1.0, 2.0, 3.0, None], Split=1.0, Dividend=0.0)
    assert series(panel.clean_bars(b), "Close") == [1, 2]
    kept = bars(spark, [1, 2, 3], Volume=[0.0, 0.0, 10.0], Split=1.0, Dividend=0.0)
    assert series(panel.clean_bars(kept), "Close") == [1, 2, 3]


def test_windows_that_must_be_full(spark):
    b = bars(spark, list(range(1, 41)))
    assert [np.isnan(x) for x in series(indicators.bollinger(b), "mavg")] == [i < 19 for i in range(40)]
    assert [np.isnan(x) for x in series(candles.body_size_class(b.withColumn("High", b.Close + 1).withColumn("Open", b.Close - 1)), "shadow_diff")] == [i < 29 for i in range(40)]


def test_obv_is_empty_before_the_first_move(spark):
    got = series(indicators.obv(bars(spark, [5, 5, 6, 6, 4])), "obv")
    assert np.isnan(got[:2]).all() and got[2:] == [10, 10, 0]


def test_mfi_without_negative_flow(spark):
    assert series(indicators.mfi(bars(spark, list(range(1, 17)))), "mfi")[13:] == [100, 100, 100]


def test_rsi_and_tsi_from_the_first_move(spark):
    got = recursive.recursive_block(bars(spark, [10, 11, 10, 12]), ["rsi", "tsi"])
    w = 13 / 14
    up, down = (1 * w**2 + 2) / (w**2 + w + 1), w / (w**2 + w + 1)
    assert series(got, "rsi")[1:] == pytest.approx([100, 100 * w / (w + 1), 100 * up / (up + down)])
    assert series(got, "tsi")[0] == -100  # 10 against the mean of 10.75


def test_backtest_stops(spark):
    run = lambda closes, signals, **k: trading.backtest(bars(spark, closes, signal=list(signals)), 103.0, **k)
    assert series(run([10, 12, 12], "bnn", stop_profit=0.2), "stock") == [10, 0, 0]
    assert series(run([10, 9, 9], "bnn", stop_loss=-0.1), "stock") == [10, 0, 0]
    assert series(run([10, 11.9, 9.1], "bnn", stop_profit=0.2, stop_loss=-0.1), "stock") == [10, 10, 10]
    # The second b buys nothing, but the holding return counts from it.
    assert series(run([10, 11, 12.5], "bbn", stop_profit=0.2), "stock") == [10, 10, 10]
    # A sale for less than the fee is not made.
    assert series(run([10, 0.2, 0.2], "bsn"), "stock") == [10, 10, 10]
