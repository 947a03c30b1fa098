"""A night of the analysis from a state: each symbol's last rows, the hidden values of its recursions and its open runs.

The state is a table of the last TAIL rows a symbol, as causal_features gives them. A night reads it and the day's bars, whatever
the history's length, and gives the day's features and the next state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.operators import candles, indicators, patterns, scores, trends

BARS = ["symbol", "Date", "Open", "High", "Low", "Close", "Volume"]
#: Rows of a symbol that the longest window looks back on (senkou_b: 52 rows, shown 26 later), and how many a night keeps to go on from.
TAIL, ANCHORS = 80, 4

#: Exponential means that recursions carry: name -> (decay, values before the mean counts).
_EMAS = {name: (1 - 2 / (span + 1), span) for name, span in {"up": 14, "down": 14, "gap": 5, "power": 14, "drift": 3, "ahead": 5}.items()} | {name: (13 / 14, 1) for name in ("gain", "loss")}
_KAMA = {"kama_fast": (10, 2, 30), "kama_slow": (20, 4, 60)}
HIDDEN = ["_row", *[f"_{n}_{part}" for n in _EMAS for part in ("num", "den", "n")], *[f"_{n}_ratio" for n in _KAMA]]
RECURSIVE = [*_KAMA, "pdi", "mdi", "adx_strength", "adx_value", "adx_value_prediction", "rsi", "srsi"]


class _Means:
    """The exponential means of one symbol, one value at a time; a missing value only decays."""

    def __init__(self, hidden: dict[str, float]):
        self.at = {n: [*(hidden.get(f"_{n}_{part}", 0.0) for part in ("num", "den", "n"))] for n in _EMAS}

    def take(self, name: str, x: float) -> float:
        (decay, least), s = _EMAS[name], self.at[name]
        s[0], s[1] = s[0] * decay, s[1] * decay
        if x == x:
            s[0], s[1], s[2] = s[0] + x, s[1] + 1, s[2] + 1
        return s[0] / s[1] if s[2] >= least else np.nan

    def hidden(self) -> dict[str, float]:
        return {f"_{n}_{part}": v for n, s in self.at.items() for part, v in zip(("num", "den", "n"), s)}


def _advance(p: pd.DataFrame) -> pd.DataFrame:
    """Fill RECURSIVE and HIDDEN in the rows of one symbol that are not stored yet, going on from the last one that is."""
    p = p.sort_values("Date").reset_index(drop=True)
    high, low, close = (p[c].to_numpy(dtype=float) for c in ("High", "Low", "Close"))
    out = {c: p[c].to_numpy(dtype=float, na_value=np.nan).copy() for c in (*RECURSIVE, *HIDDEN)}
    known = int(p["_stored"].sum())
    means = _Means({c: out[c][known - 1] for c in HIDDEN} if known else {})
    with np.errstate(all="ignore"):
        for i in range(known, len(p)):
            row = out["_row"][i] = out["_row"][i - 1] + 1 if i else 0.0
            before = i - 1 if i else None
            move = lambda x: x[i] - x[before] if before is not None else np.nan
            true_range = np.nanmax([high[i] - low[i], *([abs(high[i] - close[before]), abs(low[i] - close[before])] if i else [])])
            pdi = 100 * np.float64(means.take("up", np.maximum(move(high), 0.0))) / true_range
            mdi = 100 * np.float64(means.take("down", np.maximum(-move(low), 0.0))) / true_range
            value = means.take("gap", pdi - mdi)
            strength = means.take("power", 100 * abs(pdi - mdi) / (pdi + mdi))
            drift = means.take("drift", value - (out["adx_value"][before] if i else np.nan))
            gain, loss = means.take("gain", np.maximum(move(close), 0.0)), means.take("loss", np.maximum(-move(close), 0.0))
            rsi = 100 * np.float64(gain) / (gain + loss)
            held = np.append(out["rsi"][max(0, i - 13) : i], rsi)
            held = held[~np.isnan(held)]
            lo, hi = (held.min(), held.max()) if len(held) else (np.nan, np.nan)
            found = {"pdi": pdi, "mdi": mdi, "adx_value": value, "adx_strength": strength, "adx_value_prediction": means.take("ahead", value + drift), "rsi": rsi, "srsi": (rsi - lo) / np.float64(hi - lo)}
            for name, (n1, n2, n3) in _KAMA.items():
                ratio = np.nan
                if row >= n1:
                    steps = np.abs(np.diff(close[i - n1 : i + 1])).sum()
                    ratio = abs(close[i] - close[i - n1]) / steps
                ratio = ratio if np.isfinite(ratio) else out[f"_{name}_ratio"][before] if i else np.nan
                smooth = (ratio * (2 / (n2 + 1) - 2 / (n3 + 1)) + 2 / (n3 + 1)) ** 2
                last = out[name][before] if i else np.nan
                found[name] = np.nan if row < n1 - 1 else close[i] if np.isnan(last) else last + smooth * (close[i] - last)
                out[f"_{name}_ratio"][i] = ratio
            for c, v in (found | means.hidden()).items():
                out[c][i] = v
    return p.assign(**out)


def _recursions(rows: DataFrame) -> DataFrame:
    """rows (BARS, _stored, RECURSIVE and HIDDEN, null where not stored, and others) with RECURSIVE and HIDDEN filled."""
    return rows.groupBy("symbol").applyInPandas(_advance, rows.schema)


def _windows(rows: DataFrame) -> DataFrame:
    """What bounded windows give: the lines of ichimoku, shape, size and place of candles, rates."""
    out = indicators.ichimoku(rows).drop("chikan")  # chikan looks ahead
    return panel.change_rate(candles.candle_place(candles.body_size_class(out)))


def _runs(rows: DataFrame) -> DataFrame:
    """What runs and single rows give: trends of lines and of adx, position, the trend's state. Goes on from stored rows (series.going_on)."""
    out = trends.line_trend(trends.line_trend(rows, "kama", "kama_fast", "kama_slow"), "ichimoku", "tankan", "kijun")
    out = scores.trend_state(patterns.position_score(trends.adx_trend(out)))
    return out.drop("adx_distance", "adx_distance_change")  # against the whole series, so they look ahead


def _empty(columns: list[str]) -> dict:
    return {c: F.lit(None).cast("double") for c in columns}


def _shown(df: DataFrame) -> DataFrame:
    """Infinite recursive values as nulls, like recursive_block; the state keeps them as they are."""
    inf = float("inf")
    return df.withColumns({c: F.when(F.isnan(c) | F.col(c).isin(inf, -inf), None).otherwise(F.col(c)) for c in RECURSIVE})


def causal_features(bars: DataFrame) -> DataFrame:
    """Every column of the analysis up to the trend's state that does not look ahead, with HIDDEN, of whole histories."""
    rows = bars.select(BARS).withColumns({"_stored": F.lit(False)} | _empty(RECURSIVE + HIDDEN))
    return _runs(_windows(_shown(_recursions(rows)))).drop("_stored")


def state_of(features: DataFrame) -> DataFrame:
    """The last TAIL rows of each symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))
    return features.withColumn("_back", back).filter(F.col("_back") <= TAIL).drop("_back")


def next_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state for the next night, of a state and the features that night gave for it; symbols without a new bar keep theirs."""
    return state_of(state.unionByName(done))


def night(state: DataFrame, day: DataFrame) -> DataFrame:
    """Features of the day's bars (any number of new dates a symbol), with what next_state needs.

    State rows and new rows are dealt by symbol once. Symbols that the state does not know start with the bars given. Bars no newer
    than a symbol's state are left out. Write the result, and the state made from it, before the next night.
    """
    old = state.withColumn("_stored", F.lit(True))
    last = state.groupBy("symbol").agg(F.max("Date").alias("_last"))
    fresh = day.select(BARS).join(last, "symbol", "left").filter(F.col("_last").isNull() | (F.col("Date") > F.col("_last"))).drop("_last")
    kept = [c for c in state.columns if c not in BARS]
    made = [c for c in kept if c not in RECURSIVE + HIDDEN]
    rows = old.unionByName(fresh.withColumns({"_stored": F.lit(False)}), allowMissingColumns=True)
    # What was stored stands aside under _was_, so that the operators make their columns anew and runs go on from it.
    rows = _recursions(rows.withColumnsRenamed({c: f"_was_{c}" for c in made}))
    rows = _windows(_shown(rows))
    # Bars come after all that is stored, so places tell old from new.
    rows = rows.withColumns({"_n_old": F.count_if("_stored").over(Window.partitionBy("symbol")), "_place": F.row_number().over(panel.by_symbol())})
    near = rows.filter(F.col("_place") > F.col("_n_old") - ANCHORS).withColumn("_anchor", F.col("_place") == F.col("_n_old")).drop("_n_old", "_place")
    return _runs(near).filter("NOT _stored").select(state.columns)
