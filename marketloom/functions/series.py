"""Primitives over one symbol's series, as columns over the panel's windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.panel import by_symbol, div, lag, rows, whole

_AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "pstd": F.stddev_pop}


def rolling(c: str | Column, n: int, agg: str = "mean", full: bool = True) -> Column:
    """Rolling aggregate; with full only where the window holds n values."""
    x = F.col(c) if isinstance(c, str) else c
    value = _AGGREGATES[agg](x).over(rows(n))
    return F.when(F.count(x).over(rows(n)) >= n, value) if full else value


def wma(c: str, n: int) -> Column:
    """Linearly weighted mean, weights i * 2 / (n * (n + 1))."""
    out = F.lit(0.0)
    for k in range(n):
        out = out + (lag(c, k) if k else F.col(c)) * ((n - k) * 2.0 / (n * (n + 1)))
    return out


def going_on(df: DataFrame, x: Column, out: str) -> Column:
    """x in new rows. In a table that goes on from stored rows, which has _was_<out>, the last of them (_anchor) gives its own value of
    out in place of x and the others (_stored) give nothing."""
    if f"_was_{out}" not in df.columns:
        return x
    return F.when(F.col("_anchor"), F.col(f"_was_{out}")).when(~F.col("_stored"), x)


def streak(df: DataFrame, c: str, out: str, zero_as: float | None = None, one_restart: bool = False) -> DataFrame:
    """Signed running sum that starts again when the sign turns.

    zero_as None: a zero resets to zero; else a zero adds zero_as in the direction of the run. A null starts again, and a value
    of 1 or -1 too with one_restart. Goes on from stored rows, see going_on; only the last of these and new rows hold the sum then.
    """
    w = by_symbol()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.col("_stored") & ~F.col("_anchor") if f"_was_{out}" in df.columns else F.lit(False)
    df = df.withColumn("_x", going_on(df, F.col(c).cast("double"), out))
    x = F.col("_x")
    df = df.withColumn("_sign", F.signum(x))
    if zero_as is None:
        df = df.withColumn("_run", F.col("_sign"))
    else:
        df = df.withColumn("_era", F.sum(F.when(x.isNull() & ~gone, 1).otherwise(0)).over(running))
        held = F.last(F.when(F.col("_sign") != 0, F.col("_sign")), True).over(Window.partitionBy("symbol", "_era").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0))
        after_null = (F.col("_era") > 0)
        df = df.withColumn("_run", F.when(x.isNull(), None).when(x == 0, F.coalesce(held, F.when(after_null, None).otherwise(F.lit(0.0)))).otherwise(F.col("_sign"))).drop("_era")
    opened = ~F.col("_run").eqNullSafe(F.lag("_run").over(w)) | F.col("_run").isNull()
    if one_restart:
        opened = opened | F.coalesce(F.abs(x) == 1, F.lit(False))
    value = x if zero_as is None else F.when(x == 0, F.col("_run") * zero_as).otherwise(x)
    df = df.withColumn("_new", F.when(opened, 1).otherwise(0)).withColumn("_v", value).withColumn("_island", F.sum("_new").over(running))
    return df.withColumn(out, F.sum("_v").over(Window.partitionBy("symbol", "_island").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0))).drop("_x", "_sign", "_run", "_new", "_v", "_island")


def volume_streak(df: DataFrame) -> DataFrame:
    """volume_day: how many rows in a row Volume has risen, negative for rows without a rise; the first row has none."""
    rise = F.when(F.col("Volume") > lag("Volume"), 1).otherwise(-1)
    return streak(df.withColumn("_rise", rise), "_rise", "volume_day").drop("_rise")


def moving_slope(df: DataFrame, c: str, n: int) -> DataFrame:
    """Slope and intercept of the least squares line over each full window, x counted from 0 in the window."""
    df = df.withColumn("_i", F.row_number().over(by_symbol()).cast("double"))
    full = F.count(c).over(rows(n)) >= n
    slope, at = F.regr_slope(c, "_i").over(rows(n)), F.regr_intercept(c, "_i").over(rows(n))
    return df.withColumn(f"{c}_slope", F.when(full, slope)).withColumn(f"{c}_intercept", F.when(full, at + F.col(f"{c}_slope") * (F.col("_i") - (n - 1)))).drop("_i")


def linear_fit(df: DataFrame, c: str, n: int) -> DataFrame:
    """One row a symbol: slope and intercept of its last n values on x = 1..n, nulls as 0; zeros for n rows or fewer."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))
    tail = df.select("symbol", F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("_y"), back.alias("_b"), F.count("*").over(Window.partitionBy("symbol")).alias("_n")).filter(F.col("_b") <= n)
    x = (F.lit(n + 1) - F.col("_b")).cast("double")
    fit = tail.groupBy("symbol").agg(F.regr_slope("_y", x).alias("slope"), F.regr_intercept("_y", x).alias("intercept"), F.max("_n").alias("_n"))
    return fit.select("symbol", *[F.when(F.col("_n") <= n, 0.0).otherwise(F.col(k)).alias(k) for k in ("slope", "intercept")])


def normalize(c: str, minmax: bool = False, ffill: bool = False) -> Column:
    """To 0..1, or with minmax to -1..1, by the extremes of the whole series (it looks ahead)."""
    x = F.last(c, True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) if ffill else F.col(c)
    lo, hi = F.min(c).over(whole()), F.max(c).over(whole())
    unit = div(x - lo, hi - lo)
    return unit * 2 - 1 if minmax else unit


def crossover(df: DataFrame, fast: str, slow: str, out: str, pos: str = "b", neg: str = "s", none: str = "n") -> DataFrame:
    df = df.withColumn("_d", F.col(fast) - F.col(slow)).withColumn("_p", lag("_d"))
    up = ((F.col("_d") >= 0) & (F.col("_p") < 0)) | ((F.col("_d") > 0) & (F.col("_p") <= 0))
    down = ((F.col("_d") <= 0) & (F.col("_p") > 0)) | ((F.col("_d") < 0) & (F.col("_p") >= 0))
    return df.withColumn(out, F.when(down, neg).when(up, pos).otherwise(none)).drop("_d", "_p")


def boundary(up: Column, low: Column, hi: float, lo: float, pos: str = "b", neg: str = "s", none: str = "n") -> Column:
    return F.when(low < lo, neg).when(up > hi, pos).otherwise(none)


def rule_value(rules: list[tuple[str, object]], default: object = None) -> Column:
    """Named conditions in order; the last that holds gives the value."""
    out = F.lit(default)
    for condition, value in rules:
        out = F.when(F.expr(condition), F.lit(value)).otherwise(out)
    return out


def rule_score(rules: list[tuple[str, str, float]]) -> dict[str, Column]:
    """(name, condition, signed weight): up and down scores (2 digits) and the names that held, by sign."""
    held = [(name, F.coalesce(F.expr(cond), F.lit(False)), weight) for name, cond, weight in rules]
    out: dict[str, Column] = {}
    for side, sign in (("up", 1), ("down", -1)):
        own = [x for x in held if x[2] * sign > 0]
        score = F.lit(0.0)
        for _, cond, weight in own:
            score = score + F.when(cond, float(weight)).otherwise(0.0)
        out[f"{side}_score"] = F.bround(score, 2)
        names = F.array(*[F.when(cond, F.lit(name)) for name, cond, _ in own]) if own else F.array().cast("array<string>")
        out[f"{side}_names"] = F.array_join(F.filter(names, lambda x: x.isNotNull()), ", ")
    return out


def ffill(c: str) -> Column:
    return F.last(c, True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def bfill(c: str) -> Column:
    return F.first(c, True).over(by_symbol().rowsBetween(0, Window.unboundedFollowing))


def fill_value(c: str, value: float) -> Column:
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), value).otherwise(x)


def moving_averages(df: DataFrame, c: str, windows: list[int]) -> DataFrame:
    """<c>_ma_<n> for several windows in one pass; null before a window is full."""
    return df.withColumns({f"{c}_ma_{n}": rolling(c, n) for n in windows})


def drop_extreme(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null, a zero, a NaN or a value of e ** 709 or more in the columns."""
    keep = F.lit(True)
    for c in columns:
        x = F.col(c)
        keep = keep & x.isNotNull() & ~F.isnan(x) & (x != 0) & (x < F.exp(F.lit(709.0)))
    return df.filter(keep)


def minmax_pair(a: str, b: str, which: str = "max") -> Column:
    """The larger or smaller of two, null where either is."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.greatest if which == "max" else F.least)(a, b))
