"""Stop and reverse and the trend cycle against plain versions of their rules."""

import math

import pandas as pd
import pytest

from marketloom.operators import indicators, trends
from marketloom.operators.recursive import INDICATORS, recursive_block

BARS = [("a", i, 10 + 4 * math.sin(i / 5) + i % 3 * 0.3, i % 4) for i in range(90)] + [("b", 0, 5.0, 1), ("c", 0, 5.0, 1), ("c", 1, 6.0, 1)]


@pytest.fixture(scope="module")
def bars():
    return pd.DataFrame([(s, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), c, c + 1 + w * 0.1, c - 1 - w * 0.05, c, 100.0) for s, i, c, w in BARS], columns=["symbol", "Date", "Open", "High", "Low", "Close", "Volume"])


def test_stop_and_reverse(spark, bars):
    got = recursive_block(spark.createDataFrame(bars), ["psar"]).toPandas().sort_values(["symbol", "Date"])
    for _, p in got.groupby("symbol"):
        p = p.reset_index(drop=True)
        assert p["psar"][:2].tolist() == p["Close"][:2].tolist() and p["psar_up"][:2].isna().all() and p["psar_down"][:2].isna().all()
        later = p.iloc[2:]
        assert (later["psar_up"].isna() != later["psar_down"].isna()).all()
        assert (later["psar_up"].fillna(later["psar_down"]) == later["psar"]).all()
        for i in range(3, len(p)):
            if p["psar_up"].notna()[i] and p["psar_up"].notna()[i - 1]:  # still rising: under the lows before it
                assert p["psar"][i] <= max(p["Low"][i - 1], p["Low"][i - 2]) and p["Low"][i] >= p["psar"][i - 1]
            if p["psar_down"].notna()[i] and p["psar_up"].notna()[i - 1]:  # turned: at the highest high of the rise
                assert p["psar"][i] in set(p["High"][:i])
    assert got["psar_up"].notna().any() and got["psar_down"].notna().any()


def test_trend_cycle(bars):
    p = bars[bars["symbol"] == "a"].reset_index(drop=True)
    got = INDICATORS["stc"][0](p)["stc"]

    def ema(x, n):
        out = []
        for i in range(len(x)):
            pairs = [(x[j], (1 - 2 / (n + 1)) ** (i - j)) for j in range(i + 1) if x[j] is not None]
            out.append(sum(a * b for a, b in pairs) / sum(b for _, b in pairs) if len(pairs) >= n else None)
        return out

    def place(x):
        out = []
        for i in range(len(x)):
            w = x[max(0, i - 9) : i + 1]
            full = len(w) == 10 and None not in w
            out.append(100 * (x[i] - min(w)) / (max(w) - min(w)) if full and max(w) > min(w) else None)
        return ema(out, 3)

    close = p["Close"].tolist()
    macd = [None if b is None else a - b for a, b in zip(ema(close, 23), ema(close, 50))]
    want = place(place(macd))
    assert any(v is not None for v in want)
    for a, b in zip(got, want):
        assert (b is None and pd.isna(a)) or a == pytest.approx(b, abs=1e-6)


def test_renko(spark, bars):
    p = pd.DataFrame({"Close": [100.0, 101, 93, 80, 100, 101]}).assign(High=lambda x: x["Close"], Low=lambda x: x["Close"])
    got = INDICATORS["renko_fixed"][0](p)
    want = {"renko_o": [84.7, 92.4, None, 92.4, None, 92.4], "renko_c": [92.4, 100.1, None, 84.7, None, 100.1], "renko_distance": [7.7, 7.7, None, -7.7, None, 7.7], "renko_brick_number": [1, 1, None, 1, None, 1]}
    for name, values in want.items():
        assert [None if pd.isna(x) else round(x, 6) for x in got[name]] == values
    flat = p.assign(Close=0.0, High=0.0, Low=0.0)
    assert all(x.isna().all() for name in ("renko", "renko_fixed") for x in INDICATORS[name][0](flat).values())
    out = trends.renko_place(indicators.candle_shape(recursive_block(spark.createDataFrame(bars), ["renko"])))
    assert out.count() == len(bars) and trends.renko_place(indicators.candle_shape(recursive_block(spark.createDataFrame(bars).limit(0), ["renko"]))).count() == 0


def test_channel_of_few_rows(spark, bars):
    got = trends.trend_channel(spark.createDataFrame(bars)).toPandas()
    assert len(got) == len(bars)
    assert got[got["symbol"] != "a"][["linear_fit_high", "linear_fit_low"]].isna().all().all()
    assert got[got["symbol"] == "a"].sort_values("Date")["linear_fit_high"].notna().iloc[-1]
