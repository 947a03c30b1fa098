"""Candles against the candle before: place, gap and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.series import ffill, rolling
from marketloom.operators.indicators import candle_shape
from marketloom.panel import div, lag, whole


def candle_place(df: DataFrame) -> DataFrame:
    """place of the body relative to the body before (up, mid_up, mid, out, mid_down, down, or empty) and its score."""
    df = candle_shape(df) if "body_top" not in df.columns else df
    df = df.withColumns({"_top": lag("body_top"), "_bottom": lag("body_bottom"), "_color": lag("color")})
    top, bottom, before_top, before_bottom = (F.col(c) for c in ("body_top", "body_bottom", "_top", "_bottom"))
    place = (F.when(top <= before_bottom, "down").when((bottom < before_bottom) & (top <= before_top), "mid_down").when((bottom < before_bottom) & (top > before_top), "out")
             .when((top <= before_top) & (bottom >= before_bottom), "mid").when(bottom < before_top, "mid_up").when(bottom >= before_top, "up").otherwise(""))
    df = df.withColumn("place", F.when(before_top.isNull(), "").otherwise(place))
    # Score by colour, place and, inside the body before, that body's colour.
    outer = {(1, "up"): 0.99, (1, "down"): -0.33, (1, "out"): 0.66, (-1, "down"): -0.99, (-1, "up"): 0.33, (-1, "out"): -0.66}
    inner = {(1, 1, "mid_down"): -0.33, (1, 1, "mid_up"): 0.33, (-1, 1, "mid_down"): 0.33, (-1, 1, "mid"): 0.33, (-1, 1, "mid_up"): 0.66,
             (-1, -1, "mid_up"): 0.33, (-1, -1, "mid_down"): -0.33, (1, -1, "mid_up"): -0.33, (1, -1, "mid"): -0.33, (1, -1, "mid_down"): -0.66}
    score = F.lit(0.0)
    for (color, where), v in outer.items():
        score = F.when((F.col("color") == color) & (F.col("place") == where), v).otherwise(score)
    for (before, color, where), v in inner.items():
        score = F.when((F.col("_color") == before) & (F.col("color") == color) & (F.col("place") == where), v).otherwise(score)
    return df.withColumn("place_score", score).drop("_top", "_bottom", "_color")


def candle_gap(df: DataFrame, rare: float = 0.05) -> DataFrame:
    """gap: 1 or -1 where the range leaves the range before, 2 or -2 where the gap is at least the symbol's mean gap of that side
    and such gaps are rarer than `rare`. Colour, top and bottom of the last strict gap are carried on."""
    df = df.withColumns({"_high": lag("High"), "_low": lag("Low")}).withColumns({"_up": F.col("Low") - F.col("_high"), "_down": F.col("_low") - F.col("High")})
    strict = {}
    for side in ("_up", "_down"):
        wide = (F.col(side) > 0) & (F.col(side) >= F.avg(F.when(F.col(side) > 0, F.col(side))).over(whole()))
        df = df.withColumn(f"{side}_wide", F.coalesce(wide, F.lit(False)))
        strict[side] = F.col(f"{side}_wide") & (F.avg(F.col(f"{side}_wide").cast("double")).over(whole()) < rare)
    gap = F.when(strict["_up"], 2.0).when(strict["_down"], -2.0).when(F.col("_up") > 0, 1.0).when(F.col("_down") > 0, -1.0).otherwise(0.0)
    df = df.withColumn("gap", gap)
    g = F.col("gap")
    df = df.withColumns({"gap_color": F.when(F.abs(g) == 2, F.signum(g)), "gap_top": F.when(g == 2, F.col("Low")).when(g == -2, F.col("_low")), "gap_bottom": F.when(g == 2, F.col("_high")).when(g == -2, F.col("High"))})
    df = df.withColumns({"gap_top": ffill("gap_top"), "gap_bottom": ffill("gap_bottom"), "gap_color": F.coalesce(ffill("gap_color"), F.lit(0.0))})
    return df.withColumn("gap_distance", (F.col("gap_top") - F.col("gap_bottom")) * F.col("gap_color")).drop("_high", "_low", "_up", "_down", "_up_wide", "_down_wide")


def body_size_class(df: DataFrame, n: int = 30, upper: float = 1.0, lower: float = -0.5) -> DataFrame:
    """shadow_trend and entity_trend: u long, d short, n between, against the mean of the last n candles."""
    df = candle_shape(df) if "body" not in df.columns else df
    rel = {c: div(F.col(c) - rolling(c, n), rolling(c, n)) for c in ("body", "shadow")}
    df = df.withColumns({f"{c}_diff": x for c, x in rel.items()})
    df = df.withColumn("shadow_trend", F.when(F.col("shadow_diff") <= lower, "d").when(F.col("shadow_diff") >= upper, "u").otherwise("n"))
    long_body = (F.col("body_diff") >= 1.5 * upper) | ((F.col("body_diff") >= upper) & (F.col("shadow_trend") == "u") & (F.col("body_pct") >= 0.8))
    return df.withColumn("entity_trend", F.when(F.col("body_diff") <= lower, "d").when(long_body, "u").otherwise("n"))


def long_shadow(df: DataFrame) -> DataFrame:
    """long_shadow of body_size_class rows: d a long upper shadow, u a long lower one (which wins), n neither."""
    wide = F.col("shadow_diff") > 0.25
    return df.withColumn("long_shadow", F.when(wide & (F.col("shadow_lower_pct") > 0.5), "u").when(wide & (F.col("shadow_upper_pct") > 0.5), "d").otherwise("n"))
