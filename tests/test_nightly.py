"""Nights from a state against the whole history."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.operators import recursive
from marketloom.plans import analysis, nightly

SF = "/root/testdata/sf0.001"


def plain(df):
    pdf = df.toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True)
    return pdf[sorted(pdf.columns)]


def alike(got, want):
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            a, b = got[c].astype(float), want[c].astype(float)
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), (c, got[~np.isclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)][["symbol", "Date", c]].head(), want[~np.isclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)][c].head())
        else:
            assert (got[c].fillna("") == want[c].fillna("")).all(), c


@pytest.fixture(scope="module")
def bars(spark):
    kept = panel.trade_bars(spark, SF, "p_brand").filter("symbol IN ('Brand#11', 'Brand#12') AND Date > DATE '1998-06-01'").toPandas()
    r = np.random.default_rng(7)
    rows, price = [], 50.0
    for i in range(200):  # quiet stretches, equal closes and days without a range
        price += r.choice([0.0, 0.0, 0.5, -0.5, 1.0])
        o = price - r.choice([0.0, 0.25])
        rows.append(("flat", datetime.date(1998, 6, 2) + datetime.timedelta(days=4 * i), o, max(o, price) + r.choice([0.0, 1.0]), min(o, price) - r.choice([0.0, 1.0]), price, 100.0))
    rows += [("late", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), 5.0 + i % 7, 6.0 + i % 7, 4.0 + i % 5, 5.0 + i % 3, 10.0) for i in range(40)]
    return spark.createDataFrame(pd.concat([kept, pd.DataFrame(rows, columns=kept.columns)]), "symbol string, Date date, Open double, High double, Low double, Close double, Volume double").repartition(4).cache()


@pytest.fixture(scope="module")
def whole(bars):
    return plain(nightly.causal_features(bars))


def test_recursions_are_those_of_whole_series(bars, whole):
    want = plain(recursive.recursive_block(bars, ["kama_lines", "adx", "rsi"]))
    alike(whole[sorted(nightly.RECURSIVE)], want[sorted(nightly.RECURSIVE)])


def test_nights_equal_the_whole_run(spark, bars, whole):
    """Two nights of different length; states and nights are written and read."""
    at = datetime.date(1999, 12, 15)
    state, seen = analysis.staged(nightly.state_of(nightly.causal_features(bars.filter(F.col("Date") <= at))), "state"), []
    for days in (2, 300):
        first, at = at + datetime.timedelta(days=1), at + datetime.timedelta(days=days)
        day = bars.filter(F.col("Date").between(first - datetime.timedelta(days=5), at))  # what the state has already is left out
        done = analysis.staged(nightly.night(state, day), "night")
        state = analysis.staged(nightly.next_state(state, done), "state")
        got = plain(done)
        alike(got, whole[(whole["Date"] >= first) & (whole["Date"] <= at)].reset_index(drop=True))
        seen.append(len(got))
    assert seen[0] < 10 and sum(seen) > 100
    assert all(r["count"] <= nightly.TAIL for r in state.groupBy("symbol").count().collect())
    # A night without new bars gives nothing and changes nothing.
    none = analysis.staged(nightly.night(state, day), "night")
    assert none.count() == 0 and plain(nightly.next_state(state, none)).equals(plain(state))
