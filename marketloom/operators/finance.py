"""Return and risk measures, one row a symbol (or a symbol and period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.panel import div, lag


def _ends(value: str) -> dict[str, Column]:
    return {"_first": F.min_by(value, "Date"), "_last": F.max_by(value, "Date"), "_days": F.datediff(F.max("Date"), F.min("Date"))}


def _measures() -> dict[str, Column]:
    hpr = div(F.col("_last"), F.col("_first")) - 1
    years = F.col("_days") / F.lit(365.0)
    ear = F.when(F.col("_days") > 0, F.pow(1 + hpr, div(F.lit(1.0), years)) - 1)
    return {"hpr": hpr, "ear": ear, "apr": div(hpr, years), "ccr": F.when(ear > -1, F.log(1 + ear))}


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("Date") >= F.to_date(F.lit(start)))
    return df if end is None else df.filter(F.col("Date") <= F.to_date(F.lit(end)))


def return_measures(df: DataFrame, start: str | None = None, end: str | None = None, value: str = "Close") -> DataFrame:
    """Holding period, effective annual, simple annual and continuously compounded rates."""
    ends = between(df, start, end).groupBy("symbol").agg(*[c.alias(k) for k, c in _ends(value).items()])
    return ends.select("symbol", *[c.alias(k) for k, c in _measures().items()])


def annual_volatility(df: DataFrame, rate: str = "rate", start: str | None = None, end: str | None = None) -> DataFrame:
    """The days are those of the rows from start to end, the variance is that of all rows. Null for a symbol without rows there."""
    day = F.col("Date")
    for bound, fits in ((start, day >= F.to_date(F.lit(start))), (end, F.col("Date") <= F.to_date(F.lit(end)))):
        day = day if bound is None else F.when(fits, day)
    out = df.groupBy("symbol").agg(F.var_samp(rate).alias("_v"), F.datediff(F.max(day), F.min(day)).alias("_days"))
    return out.select("symbol", F.when(F.col("_days") - 1 <= 0, 0.0).otherwise(F.sqrt(F.col("_v") * div(F.lit(365.0), F.col("_days") - 1))).alias("volatility"))


def sharpe(df: DataFrame, riskfree: float = 0.04, value: str = "Close", start: str | None = None, end: str | None = None) -> DataFrame:
    """df carries rate. (EAR - riskfree) / annual volatility."""
    joined = return_measures(df, start, end, value).join(annual_volatility(df, start=start, end=end), "symbol")
    return joined.select("symbol", div(F.col("ear") - riskfree, F.col("volatility")).alias("sharpe"))


def max_drawdown(df: DataFrame, value: str = "Close", start: str | None = None, end: str | None = None) -> DataFrame:
    """Least over time of a value / (highest value before it or its own) - 1.

    Each symbol's months are folded to (highest, lowest, worst drop), and these, in order, to the symbol's: what follows a month
    drops at worst from the highest value before to its lowest. Only the days of a month are ever sorted. Symbols are dealt once; both
    folds keep that partitioning.
    """
    def worse(a: Column, b: Column) -> Column:
        return F.least(a, b)  # a null counts for nothing

    def fold(parts: Column, hi: str, lo: str, worst: str | None) -> Column:
        none = F.lit(None).cast("double")
        start = F.struct(none.alias("hi"), none.alias("lo"), none.alias("worst"))

        def step(s: Column, x: Column) -> Column:
            # A value's own drop is 0, from itself; a month brings its own worst.
            within = x[worst] if worst else F.when(x[lo].isNotNull(), 0.0)
            return F.struct(F.greatest(s["hi"], x[hi]).alias("hi"), F.least(s["lo"], x[lo]).alias("lo"), worse(worse(s["worst"], within), div(x[lo], s["hi"]) - 1).alias("worst"))

        return F.aggregate(parts, start, step)

    rows = between(df, start, end).select("symbol", "Date", F.trunc("Date", "month").alias("_m"), F.col(value).cast("double").alias("v")).repartition("symbol")
    months = rows.groupBy("symbol", "_m").agg(F.array_sort(F.collect_list(F.struct("Date", "v"))).alias("days"))
    months = months.select("symbol", "_m", fold(F.col("days"), "v", "v", None).alias("s"))
    whole = months.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_m", "s.hi", "s.lo", "s.worst"))).alias("months"))
    return whole.select("symbol", fold(F.col("months"), "hi", "lo", "worst")["worst"].alias("max_drawdown"))


def period_rate_risk(df: DataFrame, by: str = "month", value: str = "Close") -> DataFrame:
    """Measures and daily rate mean and deviation by year, month or week; periods of one row go."""
    rated = df.withColumn("_rate", div(F.col(value), lag(value)) - 1).withColumn("period", F.trunc("Date", by))
    ends = rated.groupBy("symbol", "period").agg(*[c.alias(k) for k, c in _ends(value).items()], F.avg("_rate").alias("rate_mean"), F.stddev_samp("_rate").alias("rate_std"), F.count("*").alias("n")).filter("n > 1")
    return ends.select("symbol", "period", *[c.alias(k) for k, c in _measures().items()], "rate_mean", "rate_std")


def risk_premium(expected: str, risk_free: str | float) -> Column:
    """The expected rate less the rate without risk."""
    return F.col(expected) - (F.col(risk_free) if isinstance(risk_free, str) else F.lit(risk_free))


def excess_return(expected: str, real: str) -> Column:
    """The real rate less the expected one."""
    return F.col(real) - F.col(expected)
