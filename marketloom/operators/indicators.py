"""Indicators made of built-in window expressions only: one exchange by symbol whatever is chained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.series import boundary, crossover, rolling, rule_value
from marketloom.panel import by_symbol, div, lag, rows, whole


def _c(name: str) -> Column:
    return F.col(name)


def dpo(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.withColumn("dpo", lag("Close", n // 2 + 1) - rolling("Close", n, full=False)).withColumn("_zero", F.lit(0.0))
    return crossover(out, "dpo", "_zero", "dpo_signal").drop("_zero")


def ichimoku(df: DataFrame, short: int = 9, medium: int = 26, long: int = 52, shift: bool = True, original: bool = False) -> DataFrame:
    """Lines midway between extremes, or with original between the means of High and Low over full windows."""
    def mid(n: int) -> Column:
        return (rolling("High", n) + rolling("Low", n)) / 2 if original else (rolling("High", n, "max", False) + rolling("Low", n, "min", False)) / 2

    out = df.withColumns({"tankan": mid(short), "kijun": mid(medium), "senkou_b": mid(long), "chikan": F.lead("Close", medium).over(by_symbol())})
    out = out.withColumn("senkou_a", (_c("tankan") + _c("kijun")) / 2)
    return out.withColumns({x: lag(x, medium) for x in ("senkou_a", "senkou_b")}) if shift else out


def kst(df: DataFrame, r: tuple = (10, 15, 20, 30), n: tuple = (10, 10, 10, 15), sign: int = 9) -> DataFrame:
    out = df.withColumns({f"_r{i}": div(_c("Close") - lag("Close", k), lag("Close", k)) for i, k in enumerate(r)})
    out = out.withColumn("kst", sum((rolling(f"_r{i}", k, full=False) * (100 * (i + 1)) for i, k in enumerate(n)), F.lit(0.0)))
    out = out.withColumn("kst_sign", rolling("kst", sign, full=False)).withColumn("_d", _c("kst") - _c("kst_sign"))
    return out.withColumn("kst_diff", div(_c("_d") - F.avg("_d").over(whole()), F.stddev_samp("_d").over(whole()))).drop("_d", *[f"_r{i}" for i in range(len(r))])


def vortex(df: DataFrame, n: int = 14) -> DataFrame:
    out = df.withColumns({"_tr": F.greatest("High", lag("Close")) - F.least("Low", lag("Close")), "_p": F.abs(_c("High") - lag("Low")), "_m": F.abs(_c("Low") - lag("High"))})
    out = out.withColumns({"vortex_pos": div(rolling("_p", n, "sum", False), rolling("_tr", n, "sum")), "vortex_neg": div(rolling("_m", n, "sum", False), rolling("_tr", n, "sum"))})
    return crossover(out.withColumn("vortex_diff", _c("vortex_pos") - _c("vortex_neg")), "vortex_pos", "vortex_neg", "vortex_signal").drop("_tr", "_p", "_m")


def _clv() -> Column:
    return F.coalesce(div((_c("Close") - _c("Low")) - (_c("High") - _c("Close")), _c("High") - _c("Low")), F.lit(0.0))


def adi(df: DataFrame) -> DataFrame:
    out = df.withColumn("_a", _clv() * _c("Volume"))
    return out.withColumn("adi", _c("_a") + lag("_a")).drop("_a")


def cmf(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.withColumn("_a", _clv() * _c("Volume"))
    out = out.withColumn("cmf", div(rolling("_a", n, "sum", False), rolling("Volume", n, "sum", False))).drop("_a")
    return out.withColumn("cmf_signal", boundary(_c("cmf"), _c("cmf"), 0.05, -0.05))


def eom(df: DataFrame, n: int = 20) -> DataFrame:
    move = div((_c("High") - lag("High") + _c("Low") - lag("Low")) * (_c("High") - _c("Low")), _c("Volume") * 2)
    out = df.withColumn("_e", move).withColumn("eom", rolling("_e", n, full=False)).withColumn("eom_ma_14", rolling("eom", 14)).withColumn("_d", _c("eom") - _c("eom_ma_14"))
    return out.withColumn("eom_diff", div(_c("_d") - F.avg("_d").over(whole()), F.stddev_samp("_d").over(whole()))).drop("_e", "_d")


def nvi(df: DataFrame) -> DataFrame:
    step = F.when(lag("Volume") > _c("Volume"), (div(_c("Close"), lag("Close")) - 1) * 100).otherwise(0.0)
    return df.withColumn("_s", step).withColumn("nvi", F.lit(1000.0) + F.sum("_s").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def obv(df: DataFrame) -> DataFrame:
    step = F.when(_c("Close") > lag("Close"), _c("Volume")).when(_c("Close") < lag("Close"), -_c("Volume"))  # null until the first move
    return df.withColumn("_s", step).withColumn("obv", F.sum("_s").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def vpt(df: DataFrame) -> DataFrame:
    out = df.withColumn("_v", _c("Volume") * (div(_c("Close"), lag("Close")) - 1))
    return out.withColumn("vpt", _c("_v") + lag("_v")).drop("_v")


def ao(df: DataFrame, short: int = 5, long: int = 34) -> DataFrame:
    out = df.withColumn("_m", (_c("High") + _c("Low")) / 2).withColumn("ao", rolling("_m", short, full=False) - rolling("_m", long, full=False)).drop("_m")
    return out.withColumn("ao_ma", rolling("ao", 2))


def mfi(df: DataFrame, n: int = 14, bounds: tuple = (20, 80)) -> DataFrame:
    out = df.withColumn("_tp", (_c("High") + _c("Low") + _c("Close")) / 3)
    out = out.withColumn("_f", _c("_tp") * _c("Volume") * F.coalesce(F.signum(_c("_tp") - lag("_tp")), F.lit(0.0)))
    out = out.withColumns({"_up": rolling(F.greatest("_f", F.lit(0.0)), n, "sum"), "_dn": rolling(F.greatest(-_c("_f"), F.lit(0.0)), n, "sum")})
    none = (_c("_dn") == 0) & (_c("_up") > 0)
    out = out.withColumn("mfi", F.when(none, 100.0).otherwise(F.lit(100) - div(F.lit(100.0), 1 + div(_c("_up"), _c("_dn"))))).drop("_tp", "_f", "_up", "_dn")
    return out.withColumn("mfi_signal", boundary(_c("mfi"), _c("mfi"), bounds[1], bounds[0]))


def stoch(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    lo, hi = rolling("Low", n, "min", False), rolling("High", n, "max", False)
    out = df.withColumn("stoch_k", div(_c("Close") - lo, hi - lo) * 100).withColumn("stoch_d", rolling("stoch_k", d, full=False))
    return out.withColumn("stoch_diff", _c("stoch_k") - _c("stoch_d"))


def uo(df: DataFrame, s: int = 7, m: int = 14, l: int = 28, w: tuple = (4.0, 2.0, 1.0)) -> DataFrame:
    before = F.coalesce(lag("Close"), F.avg("Close").over(whole()))
    out = df.withColumn("_b", before).withColumn("_lo", F.least("_b", "Low")).withColumn("_bp", _c("Close") - _c("_lo")).withColumn("_tr", F.greatest("_b", "High") - _c("_lo"))
    ratio = lambda n: div(rolling("_bp", n, "sum", False), rolling("_tr", n, "sum", False))
    out = out.withColumn("uo", (ratio(s) * w[0] + ratio(m) * w[1] + ratio(l) * w[2]) * 100.0 / sum(w)).drop("_b", "_lo", "_bp", "_tr")
    return out.withColumn("uo_diff", _c("uo") - lag("uo"))


def williams_r(df: DataFrame, n: int = 14, bounds: tuple = (-20, -80)) -> DataFrame:
    lo, hi = rolling("Low", n, "min", False), rolling("High", n, "max", False)
    out = df.withColumn("wr", div(hi - _c("Close"), hi - lo) * -100)
    return out.withColumn("wr_signal", boundary(_c("wr"), _c("wr"), bounds[0], bounds[1]))


def bollinger(df: DataFrame, n: int = 20, k: float = 2) -> DataFrame:
    out = df.withColumns({"mavg": rolling("Close", n), "mstd": rolling("Close", n, "pstd")})
    return out.withColumns({"bb_high": _c("mavg") + _c("mstd") * k, "bb_low": _c("mavg") - _c("mstd") * k})


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.withColumns({"dc_high": rolling("Close", n, "max", False), "dc_low": rolling("Close", n, "min", False)}).withColumn("dc_middle", (_c("dc_high") + _c("dc_low")) / 2)
    return out.withColumn("dc_signal", rule_value([("Close <= dc_low", "b"), ("Close >= dc_high", "s")], "n"))


def ulcer(df: DataFrame, n: int = 14) -> DataFrame:
    out = df.withColumn("_d", div(_c("Close") - rolling("Close", n, "max", False), rolling("Close", n, "max", False)) * 100)
    return out.withColumn("ulcer", F.sqrt(rolling(_c("_d") * _c("_d"), n))).drop("_d")


def mean_reversion(df: DataFrame, n: int = 100, k: float = 2) -> DataFrame:
    """One row a symbol: the two next rates that would lie k deviations from the mean of their window of n."""
    m = n - 1
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))
    tail = df.withColumn("rate", div(_c("Close"), lag("Close")) - 1).filter("rate IS NOT NULL").withColumn("_b", back).filter(_c("_b") <= m)
    out = tail.groupBy("symbol").agg(F.avg("rate").alias("mu"), (F.var_pop("rate") * F.count("rate")).alias("ss"), F.count("rate").alias("c")).filter(_c("c") == m)
    away = F.lit(float(k)) * F.sqrt(_c("ss") / m / (float(m) ** 2 / n**2 - float(k) ** 2 / n))
    return out.select("symbol", (_c("mu") + away).alias("up_rate"), (_c("mu") - away).alias("down_rate"))


def keltner_bands(df: DataFrame, n: int = 10) -> DataFrame:
    """The channel drawn from prices alone, without the true range."""
    mean = lambda h, low: rolling((_c("High") * h + _c("Low") * low + _c("Close")) / 3, n, full=False)
    return df.withColumns({"kc_middle": mean(1, 1), "kc_high": mean(4, -2), "kc_low": mean(-2, 4)})


def macd_signal(df: DataFrame) -> DataFrame:
    return crossover(df.withColumn("_zero", F.lit(0.0)), "macd_diff", "_zero", "macd_signal").drop("_zero")


def mass_signal(df: DataFrame, start: float = 27, done: float = 26.5) -> DataFrame:
    """Buy when the index rises through `start`, sell when it falls through `done`."""
    out = crossover(df.withColumns({"_start": F.lit(float(start)), "_done": F.lit(float(done))}), "mi", "_start", "_rose", neg="n")
    out = crossover(out, "mi", "_done", "_fell", pos="n")
    return out.withColumn("mi_signal", rule_value([("_rose = 'b'", "b"), ("_fell = 's'", "s")], "n")).drop("_start", "_done", "_rose", "_fell")


def srsi_signal(df: DataFrame, bounds: tuple = (20, 80)) -> DataFrame:
    """The bounds are meant for 0 to 100 but srsi lies in 0 to 1, so that every value is a buy: kept so."""
    return df.withColumn("srsi_signal", boundary(_c("srsi"), _c("srsi"), bounds[1], bounds[0], "s", "b"))


def tsi_signals(df: DataFrame) -> DataFrame:
    out = crossover(df.withColumn("_zero", F.lit(0.0)), "tsi", "tsi_sign", "tsi_fast_slow_signal")
    return crossover(out, "tsi", "_zero", "tsi_centerline_signal").drop("_zero")


def stc_signal(df: DataFrame, bounds: tuple = (25, 75)) -> DataFrame:
    """The bounds stand as they were given: a value under the upper one sells, only values over it buy."""
    return df.withColumn("stc_signal", boundary(_c("stc"), _c("stc"), bounds[0], bounds[1]))


def keltner_signal(df: DataFrame) -> DataFrame:
    return df.withColumn("kc_signal", rule_value([("Close < kc_low", "b"), ("Close > kc_high", "s")], "n"))


def candle_shape(df: DataFrame) -> DataFrame:
    """Colour, body, shadows and their shares of the range."""
    top, bottom = F.greatest("Open", "Close"), F.least("Open", "Close")
    out = df.withColumns({"color": F.when(_c("Close") > _c("Open"), 1).when(_c("Close") < _c("Open"), -1).otherwise(0), "shadow": _c("High") - _c("Low"), "body": F.abs(_c("Close") - _c("Open")), "body_top": top, "body_bottom": bottom})
    return out.withColumns({"shadow_upper_pct": div(_c("High") - _c("body_top"), _c("shadow")), "shadow_lower_pct": div(_c("body_bottom") - _c("Low"), _c("shadow")), "body_pct": div(_c("body"), _c("shadow"))})


#: Indicators of built-in expressions by name; one row in, one row out.
BUILT_IN = {f.__name__: f for f in (dpo, ichimoku, kst, vortex, adi, cmf, eom, nvi, obv, vpt, ao, mfi, stoch, uo, williams_r, bollinger, donchian, ulcer)}
