"""The nightly analysis: bars, indicators, trends, levels, scores, signals; each stage is one exchange by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.operators import candles, indicators, levels, patterns, recursive, scores, trends
from marketloom.sources.files import shared_path

LINES = ["kama_fast", "kama_slow", "tankan", "kijun", "gap_top", "gap_bottom"]


def indicator_set(bars: DataFrame, config: dict[str, list[str]]) -> DataFrame:
    """Every indicator that config names under any group, each once, in order of name; the recursive ones in one pass by symbol.

    A name that is no indicator raises. An indicator's own columns replace columns of bars with their names.
    """
    names = sorted({n for group in config.values() for n in group})
    unknown = [n for n in names if n not in recursive.INDICATORS and n not in indicators.BUILT_IN]
    if unknown:
        raise ValueError(f"no such indicators: {unknown}")
    for n in names:
        bars = indicators.BUILT_IN[n](bars) if n in indicators.BUILT_IN else bars
    chosen = [n for n in names if n in recursive.INDICATORS]
    return recursive.recursive_block(bars, chosen) if chosen else bars


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir) and read back.

    The steps of the analysis are too many for one plan; a written table also spares the steps before it when executors are lost.
    """
    path = shared_path(df.sparkSession, f"analysis/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def feature_pipeline(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All columns from bars to actions, of the rows from start to end; earlier rows of bars serve as the past, later ones are left out."""
    df = panel.slice_dates(bars, None, end)
    df = recursive.recursive_block(df, ["kama_lines", "adx", "rsi"])
    df = staged(panel.change_rate(patterns.candle_context(indicators.ichimoku(df))), "indicators")
    df = trends.line_trend(trends.line_trend(df, "kama", "kama_fast", "kama_slow"), "ichimoku", "tankan", "kijun")
    df = staged(patterns.position_score(trends.adx_trend(df)), "trends")
    df = levels.pattern_days(candles.long_shadow(patterns.multi_candle(patterns.single_candle(df))))
    df = staged(df, "patterns")
    df = levels.nearest_levels(levels.level_scores(levels.support_resistance(levels.break_levels(df, LINES), LINES), LINES), LINES)
    df = staged(scores.potential(scores.trend_state(scores.trigger_score(df))), "levels")
    df = scores.actions(scores.signal(scores.label(scores.pattern_score(df))))
    return panel.slice_dates(df, start)


def as_of_replay(bars: DataFrame, start: str, end: str, look_back: int) -> DataFrame:
    """What feature_pipeline says of the last bar on every date from start to end, seen with the look_back days before alone.

    Each bar is copied to every date that sees it, so rows grow by the window's length: for short ranges. Adds as_of.
    """
    seen = F.sequence(F.greatest(F.col("Date"), F.lit(start).cast("date")), F.least(F.date_add("Date", look_back), F.lit(end).cast("date")))
    held = bars.filter(F.col("Date").between(F.date_sub(F.lit(start).cast("date"), look_back), F.lit(end).cast("date"))).withColumn("as_of", F.explode(seen))
    # A window a symbol and date, as a symbol of its own.
    own = held.withColumn("_symbol", F.col("symbol")).withColumn("symbol", F.concat_ws("\x01", "symbol", F.col("as_of").cast("string")))
    newest = F.max("Date").over(Window.partitionBy("symbol"))
    out = feature_pipeline(own).withColumn("_newest", newest).filter(F.col("Date") == F.col("_newest"))
    return out.withColumn("symbol", F.col("_symbol")).drop("_symbol", "_newest")
