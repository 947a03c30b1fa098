"""A broker's screener export: clean its texts, tell companies from funds, keep and rank what is worth analysing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts of the export that stand for numbers, and words of names that mark funds.
MISSING, LOSS = "-", "亏损"
FUND_WORDS = ("指数", "基金", "做多", "做空", "ETN", "ETF")


def _number(c: str) -> Column:
    return F.when(F.col(c) == MISSING, 0.0).when(F.col(c) == LOSS, -1.0).otherwise(F.col(c).try_cast("double"))


def screener_clean(df: DataFrame, names: dict[str, str], numbers: list[str], percents: list[str]) -> DataFrame:
    """Columns of `names` (export name -> own name); numbers and percents (own names) as doubles; six-digit symbols get a suffix.

    A dash is 0, a loss -1; other texts that are no numbers are null. With stock_float and stock_total, float_rate is their ratio.
    """
    out = df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
    out = out.withColumns({c: _number(c) for c in numbers} | {c: F.when(F.col(c) == MISSING, 0.0).otherwise(F.regexp_replace(c, "%", "").try_cast("double") / 100) for c in percents})
    if {"stock_float", "stock_total"} <= set(out.columns):
        out = out.withColumn("float_rate", F.bround(F.try_divide(F.col("stock_float"), F.col("stock_total")), 2))
    s = F.col("symbol")
    tail = F.when(F.length(s) != 6, "").when(s.startswith("6"), ".SHG").when(s.startswith("0") | s.startswith("3"), ".SHE").otherwise("")
    return out.withColumn("symbol", F.concat(s, tail))


def screener_classify(df: DataFrame) -> DataFrame:
    """type: etf by a fund word in the name, else adr, else company with a category, else a dash."""
    name, fund = F.col("name"), F.lit(False)
    for word in FUND_WORDS:
        fund = fund | name.contains(word)
    return df.withColumn("type", F.when(fund, "etf").when(name.contains("ADR"), "adr").when(F.col("category") != MISSING, "company").otherwise(MISSING))


def screener_filter(df: DataFrame, market: str = "us", q: float = 0.7, price: tuple = (5, 1000), least_value: float = 5e8) -> DataFrame:
    """Rows worth analysing, the first of each name, with `place`: by hotness (us) or floating value (a), then symbol."""
    kept = df.filter(F.col("close").between(*price))
    if market == "us":
        kept, order = kept.filter((F.col("type") == "company") & (F.col("market_value") >= least_value) & ~F.col("symbol").contains(".")), "hotness"
    elif market == "a":
        limits = df.agg(F.percentile("volume", q).alias("_v"), F.percentile("volume_value", q).alias("_w"))
        kept = kept.crossJoin(F.broadcast(limits)).filter(f"volume >= _v OR volume_value >= _w OR market_value >= {least_value!r}").drop("_v", "_w")
        kept = kept.filter("PE_TTM > 0 AND PE >= 0 AND PB >= 0 AND rate_5d > 0 AND rate_10d > 0 AND substr(symbol, 1, 2) IN ('60', '00') AND NOT contains(name, '*') AND NOT contains(name, 'ST')")
        order = "market_value_circulation"
    else:
        raise ValueError(f"market {market!r} is not known")
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(order), "symbol"))
    return kept.withColumn("_n", first).filter("_n = 1").drop("_n").withColumn("rank_by", F.col(order))


def screener_top(df: DataFrame, num: int = 100) -> DataFrame:
    """The `num` first rows by rank_by as symbol and name(category): a top-k report."""
    top = df.orderBy(F.desc("rank_by"), "symbol").limit(num)
    return top.select("symbol", F.concat("name", F.lit("("), "category", F.lit(")")).alias("name"), "rank_by")
