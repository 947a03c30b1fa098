"""Ledgers and backtests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_ledger(orders: DataFrame, init_cash: float = 0.0, fee: float = 3.0) -> DataFrame:
    """Fold filled orders (account, symbol, side BUY/SELL, qty, price) into cash and position."""
    buy = F.col("side") == "BUY"
    value = F.col("price") * F.col("qty")
    return orders.groupBy("account", "symbol").agg(
        (F.lit(init_cash) + F.sum(F.when(buy, -(value + fee)).otherwise(value - fee))).alias("cash"),
        F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("position"))


def mark_positions(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Join the latest quote: rate against average cost, market value and, where quotes hold Open and Close, the day's move against
    average cost (rate_inday); 2 digits. Positions without a quote keep nulls."""
    day = ["Open", "Close"] if {"Open", "Close"} <= set(quotes.columns) else []
    kept = positions.drop(*day)
    out = kept.join(quotes.select("symbol", "latest_price", *day), "symbol", "left")
    new = {"rate": F.try_divide(F.col("latest_price"), F.col("average_cost")) - 1, "market_value": F.col("latest_price") * F.col("quantity")}
    if day:
        new["rate_inday"] = F.try_divide(F.col("Close") - F.col("Open"), F.col("average_cost"))
    return out.withColumns({c: F.bround(x, 2) for c, x in new.items()}).drop(*day)


def backtest(signals: DataFrame, cash: float = 10_000.0, stop_profit: float | None = None, stop_loss: float | None = None, fee: float = 3.0) -> DataFrame:
    """Per symbol: b buys what the cash less fee pays, s sells all less fee, a holding return at or beyond a stop sells too.

    The holding return counts from the last b, filled or not. A sale that brings no more than the fee is not made; the stock then
    counts as bought for nothing, so that any stop for profit sells it.

    signals: symbol, Date, Close, signal (b, s, n). Adds money, stock and value for every row. The recursion over one symbol's
    rows runs in one pass of plain numbers.
    """
    schema = "symbol string, Date date, Close double, signal string, money double, stock long, value double"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("Date")
        money, stock, paid, rows = cash, 0, 0.0, []
        for price, signal in zip(p["Close"], p["signal"]):
            if stock:
                held = (price - paid) / paid if paid else math.inf
                if (stop_profit is not None and held >= stop_profit) or (stop_loss is not None and held <= stop_loss):
                    signal = "s"
            if signal == "b":
                n, paid = max(math.floor((money - fee) / price), 0), price
                if n:
                    money, stock = money - n * price - fee, stock + n
            elif signal == "s":
                paid = 0.0
                if stock * price > fee:
                    money, stock = money + stock * price - fee, 0
            rows.append((signal, money, stock, money + stock * price))
        return p[["symbol", "Date", "Close"]].assign(**dict(zip(("signal", "money", "stock", "value"), map(list, zip(*rows)))))

    return signals.select("symbol", "Date", "Close", "signal").groupBy("symbol").applyInPandas(run, schema)
