"""Portfolios of backtested symbols and of broker accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.conditions import NUMBER, TEXT, compile_all
from marketloom.operators.finance import annual_volatility, max_drawdown, return_measures
from marketloom.operators.trading import backtest
from marketloom.panel import by_symbol, div, lag, whole


def benchmark_track(bars: DataFrame, symbol: str, cash: float = 10_000.0, fee: float = 3.0) -> DataFrame:
    """The benchmark bought on its first bar and sold on its last."""
    own = bars.filter(F.col("symbol") == symbol)
    first, last = F.min("Date").over(whole()), F.max("Date").over(whole())
    signal = F.when(F.col("Date") == last, "s").when(F.col("Date") == first, "b").otherwise("n")
    return backtest(own.withColumn("signal", signal), cash, fee=fee)


def portfolio_value(records: DataFrame, calendar: DataFrame) -> DataFrame:
    """(Date, value): on every calendar date the sum over symbols of the value at the symbol's next record, that date's included.

    A record counts from the day after the record before it, so the sum changes only right after record dates. The changes are
    summed by date first; what meets in one ordered window is one row a date, a few thousand however many symbols there are.
    """
    step = F.coalesce(F.lead("value").over(by_symbol()), F.lit(0.0)) - F.col("value")
    moved = records.select("symbol", "Date", "value", step.alias("_step"), F.row_number().over(by_symbol()).alias("_i"))
    by_date = moved.groupBy("Date").agg(F.sum("_step").alias("_step"), F.sum(F.when(F.col("_i") == 1, F.col("value"))).alias("_start"))
    dates = calendar.select("Date").distinct().withColumn("_shown", F.lit(True))
    events = by_date.join(dates, "Date", "full")
    whole_time = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_start").over(whole_time), F.lit(0.0)) + F.coalesce(F.sum("_step").over(before), F.lit(0.0))
    return events.withColumn("value", total).filter("_shown").select("Date", "value")


def backtest_report(records: DataFrame, riskfree: float = 0.04, portfolio: DataFrame | None = None, benchmark: str = "benchmark") -> DataFrame:
    """One row a symbol of backtest records (symbol, Date, value), the best EAR first by `place`, the benchmark's after them, then rows
    mean and total of all but the benchmark.

    The two last rows sum up money; with portfolio (Date, value), such as portfolio_value gives, they carry the rates of the whole.
    """
    out = _rated(records, riskfree)
    sums = out.filter(F.col("symbol") != benchmark).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("total", F.sum)) for c in ("start_money", "end_money")])
    extra = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("symbol"), F.col(f"{n}_start_money").alias("start_money"), F.col(f"{n}_end_money").alias("end_money")) for n in ("mean", "total")])).alias("r")).select("r.*")
    if portfolio is not None:
        rates = _rated(portfolio.select(F.lit("").alias("symbol"), "Date", "value"), riskfree).select("ear", "sharpe", "max_drawdown")
        extra = extra.join(F.broadcast(rates), how="left")  # one row
    out = out.unionByName(extra, allowMissingColumns=True).withColumn("profit", F.col("end_money") - F.col("start_money"))
    last = F.when(F.col("symbol") == benchmark, 1).when(F.col("symbol").isin("mean", "total"), 2).otherwise(0)
    return out.withColumns({"hpr": div(F.col("profit"), F.col("start_money")), "place": F.row_number().over(Window.orderBy(last, F.desc("ear"), "symbol"))})


def _rated(records: DataFrame, riskfree: float) -> DataFrame:
    """First and last date and value, EAR, Sharpe ratio and worst drawdown of each symbol's record."""
    rates = records.withColumn("rate", div(F.col("value"), lag("value")) - 1)
    ends = records.groupBy("symbol").agg(F.min("Date").alias("start_date"), F.max("Date").alias("end_date"), F.min_by("value", "Date").alias("start_money"), F.max_by("value", "Date").alias("end_money"))
    each = ends.join(return_measures(records, value="value").select("symbol", "ear"), "symbol").join(annual_volatility(rates), "symbol").join(max_drawdown(records, "value"), "symbol")
    return each.select("symbol", "start_date", "end_date", "start_money", "end_money", "ear", div(F.col("ear") - riskfree, F.col("volatility")).alias("sharpe"), "max_drawdown")


def coverage_plan(records: DataFrame, symbols: DataFrame, start: str, end: str, mode: str | None = None) -> DataFrame:
    """(symbol, plan): cut where records cover the range (or what `mode` asks: signal, trend), else trend."""
    spans = records.groupBy("symbol").agg(F.min("Date").alias("_lo"), F.max("Date").alias("_hi"))
    covered = (F.col("_lo") <= F.to_date(F.lit(start))) & (F.col("_hi") >= F.to_date(F.lit(end)))
    return symbols.select("symbol").distinct().join(spans, "symbol", "left").select("symbol", F.when(covered, mode or "cut").otherwise("trend").alias("plan"))


def reconcile(ledger: DataFrame, positions: DataFrame, pool: DataFrame, init_cash: float) -> DataFrame:
    """The ledger (symbol, cash, position) of the pool's symbols after a look at the broker's positions (symbol, quantity).

    Where they agree the ledger's row stays (a symbol without one starts with init_cash); else the broker's quantity holds with no
    cash, or init_cash with no position. conflict tells which rows were set anew.
    """
    own, real = F.coalesce("position", F.lit(0.0)), F.coalesce("quantity", F.lit(0.0))
    out = pool.select("symbol").distinct().join(ledger, "symbol", "left").join(positions.select("symbol", "quantity"), "symbol", "left")
    return out.select("symbol", F.when(own == real, F.coalesce("cash", F.lit(float(init_cash)))).when(real > 0, 0.0).otherwise(float(init_cash)).alias("cash"),
                      F.when(own == real, own).when(real > 0, real).otherwise(0.0).alias("position"), (own != real).alias("conflict"))


def stop_orders(positions: DataFrame, loss: float | None = None, profit: float | None = None, loss_inday: float | None = None, profit_inday: float | None = None, clear_all: bool = False) -> DataFrame:
    """Positions to sell: all, or those whose rate or rate_inday lies beyond a stop."""
    if clear_all:
        return positions
    beyond: Column = F.lit(False)
    for c, lo, hi in (("rate", loss, profit), ("rate_inday", loss_inday, profit_inday)):
        beyond = beyond | (F.col(c) < lo if lo is not None else F.lit(False)) | (F.col(c) > hi if hi is not None else F.lit(False))
    return positions.filter(F.coalesce(beyond, F.lit(False)))


#: Columns that the text of a condition may name, and their kinds; distinct texts that a table of rules may hold.
RULE_COLUMNS = {"symbol": TEXT, "price": NUMBER, "quantity": NUMBER, "rate": NUMBER}
MOST_TEXTS = 5000


def condition_orders(rules: DataFrame, columns: dict[str, str] = RULE_COLUMNS) -> DataFrame:
    """Rules whose own condition text, read from the table, holds for their own row.

    Each distinct text is compiled once (functions.conditions) and checked where it stands; a text that is no condition over the
    allowed columns never fires, see refused_conditions. The texts are what people wrote, so few: more than MOST_TEXTS raise.
    """
    compiled, _ = compile_all(_texts(rules), columns)
    fires: Column = F.lit(False)
    for text, holds in compiled.items():
        fires = F.when(F.col("condition") == text, holds).otherwise(fires)
    return rules.filter(F.coalesce(fires, F.lit(False)))


def refused_conditions(rules: DataFrame, columns: dict[str, str] = RULE_COLUMNS) -> DataFrame:
    """(condition, reason) of each distinct text that cannot fire."""
    _, refused = compile_all(_texts(rules), columns)
    return rules.sparkSession.createDataFrame(sorted(refused.items()), "condition string, reason string")


def _texts(rules: DataFrame) -> list[str]:
    found = [r[0] for r in rules.select("condition").filter("condition is not null").distinct().limit(MOST_TEXTS + 1).collect()]
    if len(found) > MOST_TEXTS:
        raise ValueError(f"more than {MOST_TEXTS} different conditions")
    return found


def account_totals(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """Market and net value of each (platform, account); an account without positions is worth its cash."""
    value = positions.groupBy("platform", "account").agg(F.sum("market_value").alias("market_value"), F.count("*").alias("n_positions"))
    out = cash.join(value, ["platform", "account"], "left").withColumns({"market_value": F.coalesce("market_value", F.lit(0.0)), "n_positions": F.coalesce("n_positions", F.lit(0).cast("long"))})
    return out.withColumn("net_value", F.col("market_value") + F.col("cash"))


def portfolio_levels(positions: DataFrame, results: DataFrame) -> DataFrame:
    """Attach close, supporter and resistanter of results by symbol (a market prefix like 'US.' is dropped); alert names a level reached."""
    plain = F.regexp_replace("symbol", r"^[A-Z]+\.", "")
    levels = results.select(F.col("symbol").alias("_s"), "supporter", "resistanter", F.col("Close").alias("_close"))
    out = positions.withColumn("_s", plain).join(levels, "_s", "left").withColumn("latest_price", F.coalesce("_close", "latest_price"))
    p = F.col("latest_price")
    return out.withColumn("alert", F.when(p <= F.col("supporter"), "support").when(p >= F.col("resistanter"), "resistant")).drop("_s", "_close")
