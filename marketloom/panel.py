"""The panel of bars: (symbol, Date, Open, High, Low, Close, Volume), and what is done to bars before any indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("Date")


def rows(n: int) -> Window:
    """The last n rows of a symbol, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def whole() -> Window:
    return Window.partitionBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def div(a: Column, b: Column) -> Column:
    """Division that is null, never infinite, for a zero divisor."""
    return F.try_divide(a, b)


def bars_from_ticks(ticks: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Bars of ticks (symbol, Date, price, quantity): first and last price by `order`, extremes and volume, one combine."""
    at = F.struct(*order)
    return ticks.groupBy("symbol", "Date").agg(
        F.min_by("price", at).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max_by("price", at).alias("Close"), F.sum("quantity").alias("Volume"))


def trade_bars(spark: SparkSession, sf_dir: str, symbol: str = "p_type") -> DataFrame:
    """Daily bars of trades: symbol is p_type, p_brand (of the part) or l_suppkey."""
    trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0")
    if symbol.startswith("p_"):
        trades = trades.join(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), symbol), "l_partkey")
    ticks = trades.select(F.col(symbol).cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("Date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), *ORDER[:-1])
    return bars_from_ticks(ticks, ORDER)


def dedupe(df: DataFrame, by: list[Column], keep: str = "last") -> DataFrame:
    """One row for each (symbol, Date): the first or last in the order given."""
    order = by if keep == "first" else [F.desc(c) if isinstance(c, str) else c.desc() for c in by]
    w = Window.partitionBy("symbol", "Date").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def change_rate(df: DataFrame, periods: int = 1) -> DataFrame:
    return df.withColumn("rate", div(F.col("Close"), lag("Close", periods)) - 1).withColumn("volume_change", F.col("Volume") - lag("Volume"))


def heikin_ashi(df: DataFrame, dropna: bool = True, replace: bool = False) -> DataFrame:
    """H_Open, H_High, H_Low and H_Close; with replace they take the places of the prices."""
    out = df.withColumns({"H_Close": (F.col("Open") + F.col("High") + F.col("Low") + F.col("Close")) / 4, "H_Open": (lag("Open") + lag("Close")) / 2})
    out = out.withColumns({"H_High": F.greatest(lag("High"), "H_Open", "H_Close"), "H_Low": F.least(lag("Low"), "H_Open", "H_Close")})
    out = out.dropna(subset=["H_Open"]) if dropna else out
    if not replace:
        return out
    prices = ("Open", "High", "Low", "Close")
    return out.withColumns({c: F.col(f"H_{c}") for c in prices}).drop(*[f"H_{c}" for c in prices])


def adjust_ohlc(df: DataFrame) -> DataFrame:
    """Scale prices by AdjClose / Close."""
    rate = div(F.col("AdjClose"), F.col("Close"))
    return df.withColumn("_rate", rate).withColumns({c: F.col(c) * F.col("_rate") for c in ("Open", "High", "Low", "Close")}).drop("_rate")


def split_adjust(df: DataFrame, older_only: bool = False) -> DataFrame:
    """Scale AdjClose of rows up to a split that prices show: AdjClose of the row before is 1.95 times the row's or more, or 0.45
    times or less, on a day with Split other than 1 (or the day before one). The nearest later factor holds; factors do not
    compound."""
    jump = div(lag("AdjClose"), F.col("AdjClose"))
    nxt = F.lead("Split").over(by_symbol())
    factor = F.when((jump >= 1.95) | (jump <= 0.45), F.when(F.col("Split") != 1, div(F.lit(1.0), F.col("Split"))).when(nxt != 1, div(F.lit(1.0), nxt)))
    out = df.withColumn("_f", factor)
    later = by_symbol().rowsBetween(1 if older_only else 0, Window.unboundedFollowing)
    return out.withColumn("AdjClose", F.col("AdjClose") * F.coalesce(F.first("_f", True).over(later), F.lit(1.0))).drop("_f")


def clean_bars(df: DataFrame) -> DataFrame:
    """Missing Split and Dividend become 1 and 0, rows with nulls go; a symbol whose newest row, as it was given, holds a zero loses
    the last row that is left."""
    zero = F.lit(False)
    for c in ("Open", "High", "Low", "Close", "AdjClose", "Volume"):
        zero = zero | F.coalesce(F.col(c) == 0, F.lit(False))
    own = Window.partitionBy("symbol")
    marked = df.withColumn("_newest", F.max("Date").over(own)).withColumn("_zero", F.max((F.col("Date") == F.col("_newest")) & zero).over(own))
    kept = marked.withColumns({"Split": F.coalesce("Split", F.lit(1.0)), "Dividend": F.coalesce("Dividend", F.lit(0.0))}).dropna()
    return kept.withColumn("_last", F.max("Date").over(own)).filter(~(F.col("_zero") & (F.col("Date") == F.col("_last")))).drop("_newest", "_zero", "_last")


def resample(df: DataFrame, by: str = "week", literal: bool = False) -> DataFrame:
    """Weekly or monthly bars. A literal week starts whenever the weekday falls below the row before's, so long gaps can merge.

    Bars with AdjClose are scaled to it first and also give the sum of Dividend and the product of Split (0 and 1 without them)."""
    adjusted, actions = "AdjClose" in df.columns, {}
    if adjusted:
        actions = {"Dividend": F.sum("Dividend") if "Dividend" in df.columns else F.lit(0.0), "Split": F.product("Split") if "Split" in df.columns else F.lit(1.0)}
        df = adjust_ohlc(df)
    if by == "week" and literal:
        starts = F.when(F.weekday("Date") < F.weekday(lag("Date")), 1).otherwise(0)
        df = df.withColumn("_s", starts).withColumn("_p", F.sum("_s").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    else:
        df = df.withColumn("_p", F.trunc("Date", by))
    out = df.groupBy("symbol", "_p").agg(
        F.min("Date").alias("_d"), F.min_by("Open", "Date").alias("Open"), F.max("High").alias("High"), F.min("Low").alias("Low"),
        F.max_by("Close", "Date").alias("Close"), F.sum("Volume").alias("Volume"), *[x.alias(c) for c, x in actions.items()])
    if adjusted:
        out = out.withColumn("AdjClose", F.col("Close"))
    return out.withColumn("Date", F.col("_p") if by == "month" else F.col("_d")).drop("_p", "_d")


def latest_per_symbol(df: DataFrame) -> DataFrame:
    """The newest row of each symbol, by one aggregate without a sort."""
    cols = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*cols), "Date").alias("_r")).select("symbol", "_r.*")


def slice_dates(df: DataFrame, start: str | None = None, end: str | None = None, look_back: int = 0) -> DataFrame:
    """Rows from start less look_back days to end, both included. Plain comparisons, so that they reach the scan."""
    if start is not None:
        df = df.filter(F.col("Date") >= F.date_sub(F.lit(start).cast("date"), look_back))
    return df if end is None else df.filter(F.col("Date") <= F.lit(end).cast("date"))


def zone_time(epoch: str | Column, zone: str, unit: str = "ms") -> Column:
    """The wall clock at an exchange (a zone name) of an epoch time in seconds (s), milliseconds (ms) or microseconds (us), to the second."""
    x = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.from_utc_timestamp(F.timestamp_seconds(F.floor(x / {"s": 1, "ms": 1000, "us": 1000000}[unit])), zone)


def zone_date(epoch: str | Column, zone: str, unit: str = "s") -> Column:
    """The calendar date at an exchange of an epoch time, see zone_time."""
    return zone_time(epoch, zone, unit).cast("date")


def plus_days(day: str | Column, n: int | Column) -> Column:
    """A date n days later (earlier, if negative); texts like 2024-01-31 count as dates."""
    return F.date_add((F.col(day) if isinstance(day, str) else day).cast("date"), n)
