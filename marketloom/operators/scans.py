"""Recursions over long series as blocked scans: a symbol's dates are cut into blocks that different tasks run.

One step of an exponential mean maps the pair (numerator, denominator) to decay * pair + (value, 1), an affine map; a block of
steps is again such a map. Each block is run from zero, what comes before it enters through the maps of the blocks before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affine_scan(x: np.ndarray, decay: float) -> np.ndarray:
    """y[i] = decay * y[i - 1] + x[i], from zero: maps over spans that double in length are composed, log2(n) vector steps."""
    y, reach = x.astype(float), 1
    while reach < len(y):
        y[reach:] += decay ** reach * y[:-reach].copy()
        reach *= 2
    return y


def ema_scan(df: DataFrame, value: str, out: str, span: float | None = None, com: float | None = None, least: int | None = None, block: str = "quarter") -> DataFrame:
    """Adjusted exponential means as recursive.ema gives them, for series of any length.

    block is the span of dates (a unit of date_trunc) that one task runs at a time; rows of one symbol spread over as many tasks as it
    has blocks. Blocks go through one exchange by symbol and block; a second one carries a row a block, and the join that brings the
    carried pairs back is by block. Nulls only decay; values are null before `least` values (default: the span, or com + 1).
    """
    if (span is None) == (com is None) or (span or 2) <= 1 or (com or 1) <= 0:
        raise ValueError("give either a span over 1 or a com over 0")
    alpha = 2 / (span + 1) if com is None else 1 / (com + 1)
    decay, least = 1 - alpha, least if least is not None else int(span if span is not None else com + 1)
    keep = [f for f in df.schema.fields if f.name != out]
    kept = df.select(*[f.name for f in keep]).withColumn("_block", F.date_trunc(block, F.col("Date").cast("timestamp")).cast("date"))
    local = ["_num", "_den", "_n", "_row"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("Date")
        x = p[value].to_numpy(dtype=float, na_value=np.nan)
        has = ~np.isnan(x)
        both = affine_scan(np.where(has, x, 0.0), decay), affine_scan(has.astype(float), decay)
        return p.assign(_num=both[0], _den=both[1], _n=np.cumsum(has), _row=np.arange(1, len(p) + 1))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["_block date", "_num double", "_den double", "_n long", "_row long"])
    runs = kept.groupBy("symbol", "_block").applyInPandas(run, schema)
    ends = runs.groupBy("symbol", "_block").agg(F.max_by(F.struct(*local), "_row").alias("e"))
    # A symbol's blocks in order, folded to what each takes over: a few numbers a block.
    blocks = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_block", "e._num", "e._den", "e._n", "e._row"))).alias("b"))
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(0).cast("long").alias("n"))
    kind = "array<struct<_block:date,num:double,den:double,n:bigint>>"

    def step(state, x):
        fade = F.pow(F.lit(decay), x["_row"])
        now = F.struct((state["now"]["num"] * fade + x["_num"]).alias("num"), (state["now"]["den"] * fade + x["_den"]).alias("den"), (state["now"]["n"] + x["_n"]).alias("n"))
        taken = F.struct(x["_block"].alias("_block"), state["now"]["num"].alias("num"), state["now"]["den"].alias("den"), state["now"]["n"].alias("n"))
        return F.struct(now.alias("now"), F.concat(state["done"], F.array(taken)).alias("done"))

    start = F.struct(zero.alias("now"), F.array().cast(kind).alias("done"))
    carried = blocks.select("symbol", F.explode(F.aggregate("b", start, step, lambda s: s["done"])).alias("c")).select("symbol", "c._block", *[F.col(f"c.{k}").alias(f"_c{k}") for k in ("num", "den", "n")])
    fade = F.pow(F.lit(decay), F.col("_row"))
    num, den = F.col("_num") + fade * F.col("_cnum"), F.col("_den") + fade * F.col("_cden")
    done = runs.join(carried, ["symbol", "_block"])
    return done.select(*[f.name for f in keep], F.when(F.col("_n") + F.col("_cn") >= least, F.try_divide(num, den)).alias(out))


def macd_scan(df: DataFrame, long: int = 26, short: int = 12, sign: int = 9, block: str = "quarter") -> DataFrame:
    """macd, macd_sign and macd_diff for series of any length."""
    out = ema_scan(ema_scan(df, "Close", "_short", short, block=block), "Close", "_long", long, block=block)
    out = out.withColumn("macd", F.col("_short") - F.col("_long")).drop("_short", "_long")
    out = ema_scan(out, "macd", "macd_sign", sign, block=block)
    return out.withColumn("macd_diff", F.col("macd") - F.col("macd_sign"))
