"""Features, labels, folds and evaluation of a ranking model on the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.panel import by_symbol, div, lag, rows, whole


def _log_return(n: int = 1) -> Column:
    ratio = div(F.col("Close"), lag("Close", n))
    return F.when(ratio > 0, F.log(ratio))


def return_features(df: DataFrame, windows: tuple = (5, 20, 60)) -> DataFrame:
    return df.withColumns({f"ret_{w}d": div(F.col("Close"), lag("Close", w)) - 1 for w in windows} | {f"logret_{w}d": _log_return(w) for w in windows})


def _at_least(x: str, w: int, least: int, value: Column) -> Column:
    return F.when((F.count("*").over(whole()) >= w) & (F.count(x).over(rows(w)) >= least), value)


def range_features(df: DataFrame, windows: tuple = (60, 252)) -> DataFrame:
    out = {}
    for w in windows:
        hi, lo = F.max("Close").over(rows(w)), F.min("Close").over(rows(w))
        out[f"pct_from_{w}d_high"] = _at_least("Close", w, w // 2, div(F.col("Close") - hi, hi))
        out[f"pct_from_{w}d_low"] = _at_least("Close", w, w // 2, div(F.col("Close") - lo, lo))
    return df.withColumns(out)


def realized_vol(df: DataFrame, windows: tuple = (5, 20, 60)) -> DataFrame:
    df = df.withColumn("_l", _log_return())
    return df.withColumns({f"vol_{w}d": _at_least("_l", w, max(2, w // 2), F.stddev_samp("_l").over(rows(w))) for w in windows}).drop("_l")


def volume_features(df: DataFrame, windows: tuple = (5, 20)) -> DataFrame:
    df = df.withColumn("_l", F.abs(_log_return()))
    out = {}
    for w in windows:
        mean, least = F.avg("Volume").over(rows(w)), max(2, w // 2)
        out[f"vol_ma_ratio_{w}d"] = _at_least("Volume", w, least, div(F.col("Volume"), mean))
        out[f"vol_zscore_{w}d"] = _at_least("Volume", w, least, div(F.col("Volume") - mean, F.stddev_samp("Volume").over(rows(w))))
    both = F.when(F.col("_l").isNotNull(), F.col("Volume"))
    out["vol_ret_corr_20d"] = F.when(F.count(both).over(rows(20)) >= 20, F.corr("Volume", "_l").over(rows(20)))
    return df.withColumns(out).drop("_l")


def relative_strength(df: DataFrame, benchmark: DataFrame, windows: tuple = (5, 20, 60), beta: int = 60) -> DataFrame:
    """Return minus the benchmark's on common dates, and the rolling beta. benchmark: Date, Close; one symbol's history, or it raises."""
    one = F.when(F.count("*") == 1, F.max("Close")).otherwise(F.raise_error(F.lit("the benchmark has several rows of a date")).cast("double"))
    # One row a date: a few thousand, however many symbols there are.
    own = df.join(F.broadcast(benchmark.groupBy("Date").agg(one.alias("_bench"))), "Date")
    rate = lambda c, n: div(F.col(c), lag(c, n)) - 1
    own = own.withColumns({f"rel_strength_{w}d": rate("Close", w) - rate("_bench", w) for w in windows} | {"_s": rate("Close", 1), "_b": rate("_bench", 1)})
    slope = div(F.covar_samp("_s", "_b").over(rows(beta)), F.var_samp("_b").over(rows(beta)))
    return own.withColumn(f"beta_{beta}d", F.when(F.count("_s").over(rows(beta)) >= beta, slope)).drop("_bench", "_s", "_b")


def calendar_features(df: DataFrame) -> DataFrame:
    end = F.last_day("Date") == F.col("Date")
    return df.withColumns({"dow": F.weekday("Date").cast("double"), "month": F.month("Date").cast("double"), "quarter": F.quarter("Date").cast("double"),
                           "is_month_end": end.cast("double"), "is_quarter_end": (end & (F.month("Date") % 3 == 0)).cast("double")})


def forward_label(df: DataFrame, horizon: int = 5, method: str = "3class", up: float = 0.02, down: float = -0.02, drop_neutral: bool = False) -> DataFrame:
    """Label of the log return of the next `horizon` rows: 2 up, 1 between, 0 down (3class), 1/0 (2class), or the return."""
    ratio = div(F.lead("Close", horizon).over(by_symbol()), F.col("Close"))
    out = df.withColumn("fwd_ret", F.when(ratio > 0, F.log(ratio)))
    f = F.col("fwd_ret")
    if method == "3class":
        label = F.when(f.isNull(), None).when(f > up, 2).when(f < down, 0).otherwise(1)
    elif method == "2class":
        label = F.when(f.isNull(), None).otherwise((f > 0).cast("int"))
    else:
        label = f
    out = out.withColumn("label", label)
    return out.filter("label != 1") if drop_neutral and method == "3class" else out


def walk_forward(dates: DataFrame, train: int = 250, test: int = 60, step: int | None = None) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) over the distinct dates, each fold moved by `step` dates.

    Dates are numbered in one task: they are the trading days of a calendar, a few thousand whatever the panel's size.
    """
    step = step or test
    numbered = dates.select("Date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("Date")) - 1)
    size = numbered.agg(F.max("_i").alias("_m"))
    folds = size.filter(F.col("_m") + 1 >= train + test).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") + 1 - train - test) / step).cast("int"))).alias("fold"))
    for name, at in (("train_start", 0), ("train_end", train - 1), ("test_start", train), ("test_end", train + test - 1)):
        folds = folds.join(F.broadcast(numbered.select(F.col("Date").alias(name), F.col("_i"))), F.col("fold") * step + at == F.col("_i")).drop("_i")
    return folds


def average_rank(c: str, part: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*part).orderBy(c)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*part, c)) - 1) / F.lit(2.0)


def ic_by_date(df: DataFrame, pred: str, true: str, method: str = "spearman", least: int = 5) -> DataFrame:
    """Correlation of score and return on every date with enough rows; null where either is constant."""
    kept = df.select("Date", F.col(pred).alias("_p"), F.col(true).alias("_t")).dropna()
    if method == "spearman":
        kept = kept.withColumns({"_rp": average_rank("_p", ["Date"]), "_rt": average_rank("_t", ["Date"])}).select("Date", F.col("_rp").alias("_p"), F.col("_rt").alias("_t"))
    out = kept.groupBy("Date").agg(F.count("*").alias("n"), F.corr("_p", "_t").alias("_ic"), F.min("_p").alias("_a"), F.max("_p").alias("_b"), F.min("_t").alias("_c"), F.max("_t").alias("_d")).filter(F.col("n") >= least)
    return out.select("Date", "n", F.when((F.col("_a") < F.col("_b")) & (F.col("_c") < F.col("_d")), F.round("_ic", 12)).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    return ics.agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"))


def _layers(df: DataFrame, pred: str, true: str, n: int) -> DataFrame:
    """Date, layer (from 0) and _t of the rows that have both, cut on every date by rank of first appearance (ties by symbol)."""
    kept = df.select("Date", "symbol", F.col(pred).alias("_p"), F.col(true).alias("_t")).dropna()
    kept = kept.withColumns({"_r": F.row_number().over(Window.partitionBy("Date").orderBy("_p", "symbol")), "_n": F.count("*").over(Window.partitionBy("Date"))}).filter("_n > 1")
    layer = F.greatest(F.expr(f"((_r - 1) * {n} + _n - 2) div (_n - 1)"), F.lit(1)) - 1
    return kept.select("Date", layer.cast("int").alias("layer"), "_t")


def layered_by_date(df: DataFrame, pred: str, true: str, n: int = 5) -> DataFrame:
    """Mean return of each of n score layers by date, and its mean over the dates."""
    daily = _layers(df, pred, true, n).groupBy("Date", "layer").agg(F.avg("_t").alias("_m"))
    return daily.groupBy("layer").agg(F.count("*").alias("n_dates"), F.avg("_m").alias("mean_ret"))


def layer_spread(df: DataFrame, pred: str, true: str, n: int = 5) -> DataFrame:
    """One row: mean return of the top and the bottom layer over all rows, and their difference; null for fewer than two layers."""
    means = _layers(df, pred, true, n).groupBy("layer").agg(F.avg("_t").alias("_m"))
    ends = means.agg(F.max_by("_m", "layer").alias("_top"), F.min_by("_m", "layer").alias("_bottom"), F.count("*").alias("_n"))
    several = F.col("_n") > 1
    return ends.select(F.when(several, F.col("_top")).alias("top"), F.when(several, F.col("_bottom")).alias("bottom"), F.when(several, F.col("_top") - F.col("_bottom")).alias("spread"))


def oos_tail(df: DataFrame, n: int = 20) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))
    return df.withColumn("_b", back).filter(F.col("_b") <= n).drop("_b")
