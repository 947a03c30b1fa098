"""Reports on the newest rows: codes, rankings, candidates, pool summaries, written results; model inputs of scores; order sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.panel import by_symbol


def signal_codes(c: str) -> Column:
    """b and s for the texts buy and sell, whatever their case; n for all else."""
    x = F.lower(F.trim(F.col(c)))
    return F.when(x.isin("buy", "b"), "b").when(x.isin("sell", "s"), "s").otherwise("n")


def score_features(df: DataFrame, scores: list[str], states: dict[str, dict[str, float]]) -> DataFrame:
    """ta_<score> as doubles and state_<column> by a map of codes; codes that the map lacks, and nulls, are 0."""
    def code(c: str, by: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for text, value in by.items():
            out = F.when(F.col(c) == text, float(value)).otherwise(out)
        return out

    return df.withColumns({f"ta_{c}": F.col(c).cast("double") for c in scores if c in df.columns} | {f"state_{c}": code(c, by) for c, by in states.items() if c in df.columns})


def postprocess(df: DataFrame, names: DataFrame, ti: str, order: list[Column], drop: list[str] = [], digits: int = 3) -> DataFrame:
    """Newest rows as a report: name by symbol (else the symbol), doubles rounded, ti, and `place` by `order`.

    names: symbol, name. The report holds one row a symbol, so places are numbered in one task.
    """
    out = df.drop("name").join(names.select("symbol", "name").dropDuplicates(["symbol"]), "symbol", "left").withColumn("name", F.coalesce("name", "symbol"))
    out = out.withColumn("place", F.row_number().over(Window.orderBy(*order, "symbol")))
    rounded = {c: F.bround(c, digits) for c, kind in out.dtypes if kind == "double"}
    return out.withColumns(rounded | {"ti": F.lit(ti)}).drop(*drop)


def select_candidates(results: DataFrame, direction: str, factors: list[str]) -> DataFrame:
    """Rows of all pools whose direction is above 0, with their place by the factors, ascending."""
    return results.filter(F.col(direction) > 0).withColumn("place", F.row_number().over(Window.orderBy(*factors, "symbol")))


def pool_summary(df: DataFrame, pools: DataFrame, score: str) -> DataFrame:
    """For each pool (pool, symbol): members, those whose newest score is above and below the one before, mean score and change."""
    df = df.select("symbol", "Date", F.col(score).alias("_s"), F.lag(score).over(by_symbol()).alias("_before"))
    newest = df.groupBy("symbol").agg(F.max_by(F.struct("_s", "_before"), "Date").alias("r")).select("symbol", "r.*")
    change = F.col("_s") - F.col("_before")
    return pools.join(newest, "symbol").groupBy("pool").agg(F.count("*").alias("total"), F.count_if(change > 0).alias("up"), F.count_if(change < 0).alias("down"), F.avg("_s").alias("score"), F.avg(change).alias("score_change"))


def review_rank(df: DataFrame, factors: list[Column], valid: str) -> DataFrame:
    """Signals by place, with how many of all have a positive `valid` return, as text 'n/total'."""
    everything = Window.partitionBy()
    share = F.concat_ws("/", F.count_if(F.col(valid) > 0).over(everything).cast("string"), F.count("*").over(everything).cast("string"))
    return df.withColumns({"place": F.row_number().over(Window.orderBy(*factors, "symbol")), "validated": share})


def write_report(df: DataFrame, path: str) -> None:
    """One folder for each ti; folders of a ti that comes again are replaced, others stay."""
    df.repartition("ti").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ti").parquet(path)


def size_orders(signals: DataFrame, positions: DataFrame, cash: DataFrame, per_sec: float, fee: float = 5.0, minimum: float | None = None) -> DataFrame:
    """Orders of each account: held symbols with an s are sold whole; symbols not held with a b are bought in order of `rank`.

    signals: account, symbol, rank, action, latest_price; positions: account, symbol, quantity; cash: account, cash. A buy spends
    per_sec, or what is left; buying ends once the cash is at or below `minimum` (default per_sec), and without a known cash never
    starts. The cash of an account runs through its own buys in one task, batch by batch.
    """
    least = per_sec if minimum is None else minimum
    held = signals.join(positions.groupBy("account", "symbol").agg(F.sum("quantity").alias("held")), ["account", "symbol"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    sells = held.filter("action = 's' AND held > 0").select("account", "symbol", F.lit("SELL").alias("side"), F.col("held").cast("double").alias("quantity"))
    buys = held.filter("action = 'b' AND held = 0 AND latest_price > 0 AND latest_price < double('inf')").join(cash.select("account", F.col("cash").cast("double")), "account")
    # The window, not a repartition, keeps an account in one task and in order: Spark may drop a repartition above a join by the same key.
    number = F.row_number().over(Window.partitionBy("account").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("symbol")))
    buys = buys.select("account", "symbol", F.col("latest_price").cast("double").alias("price"), "cash", number.alias("number"))

    def spend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The accounts of a batch buy at once, each its next symbol; what the last one has left goes on to the next batch."""
        left = np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            number, price, cash = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "price", "cash"))
            at = np.flatnonzero((number == 1) | (np.arange(len(number)) == 0))
            ends = np.append(at[1:], len(number))
            left = np.where(number[at] == 1, cash[at], left[-1:] if left.size else np.nan)
            bought, open_ = np.zeros(len(number)), np.flatnonzero(left > least)
            while open_.size:
                row, money = at[open_], left[open_]
                n = np.maximum(np.floor((np.minimum(per_sec, money) - fee) / price[row]), 0.0)
                bought[row] = n
                left[open_] = money - n * price[row]
                at[open_] += 1
                open_ = open_[(at[open_] < ends[open_]) & (left[open_] > least)]
            some = np.flatnonzero(bought)
            taken = batch.select(["account", "symbol"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bought[some])], names=["account", "symbol", "quantity"])

    kind = dict(signals.dtypes)["account"]
    spent = buys.mapInArrow(spend, f"account {kind}, symbol string, quantity double")
    return sells.unionByName(spent.select("account", "symbol", F.lit("BUY").alias("side"), "quantity"))
