"""Trends of pairs of lines and of indicators, over one symbol's series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.series import crossover, ffill, going_on, normalize, rule_value, streak
from marketloom.operators.patterns import line_place
from marketloom.panel import by_symbol, div, lag, whole


def _sign(condition: Column) -> Column:
    """1 where it holds, else -1; what cannot be told counts as not."""
    return F.when(condition, 1).otherwise(-1)


def close_crossing(df: DataFrame, line: str) -> DataFrame:
    """<line>_day: days since Close crossed the line, positive above it."""
    return streak(crossover(df, "Close", line, "_cross", 1, -1, 0), "_cross", f"{line}_day", zero_as=1).drop("_cross")


def line_trend(df: DataFrame, name: str, fast: str, slow: str) -> DataFrame:
    """A pair of lines: how both move, since when Close and the fast line are on which side, how far apart the lines are and where
    the candle's body lies. Needs candle_shape.

    Adds <line>_rate and <line>_day of both, <name>_rate (their sum), <name>_distance (against slow), <name>_distance_change,
    <name>_distance_day, <name>_direction_day (days that the distance has grown or shrunk), <name>_place, and the edges of the cloud
    between the lines, <name>_cloud_top and <name>_cloud_bottom.
    """
    for line in (fast, slow):
        df = close_crossing(df.withColumn(f"{line}_rate", div(F.col(line), lag(line)) - 1), line)
    df = line_place(df, fast, slow, name)
    distance = F.col(f"{name}_distance")
    known = distance.isNotNull()
    df = df.withColumns({f"{name}_cloud_top": F.when(known, F.greatest(fast, slow)), f"{name}_cloud_bottom": F.when(known, F.least(fast, slow))})
    df = df.withColumns({f"{name}_rate": F.col(f"{fast}_rate") + F.col(f"{slow}_rate"), f"{name}_distance_change": distance - lag(f"{name}_distance")})
    df = df.withColumns({"_side": F.when(distance == 0, 0).otherwise(_sign(distance > 0)), "_way": _sign(F.col(f"{name}_distance_change") > 0)})
    df = streak(df, "_side", f"{name}_distance_day", zero_as=0)
    return streak(df, "_way", f"{name}_direction_day", zero_as=0).drop("_side", "_way")


#: The strength from which a trend is strong, the band in which the value only waves, and the marks around them.
STRONG, WAVE = 25, 10


def adx_trend(df: DataFrame) -> DataFrame:
    """The trend that adx_value and adx_strength show: 1, -1 or 0 (adx_trend), and since when (adx_day). Needs the adx indicator.

    adx_direction and adx_power are the running moves of value and strength, <..>_day since when they go that way, <..>_start
    what value and strength were before. adx_distance is the value less its prediction, by the largest distance of the symbol's
    whole series (it looks ahead). The first day of a turn against a longer move of the strength is no trend.
    """
    value, strength = F.col("adx_value"), F.col("adx_strength")
    df = df.withColumns({"adx_value_change": value - lag("adx_value"), "adx_strength_change": strength - lag("adx_strength"), "adx_value_pred_change": F.col("adx_value_prediction") - lag("adx_value_prediction")})
    for move, base in (("adx_direction", "adx_value"), ("adx_power", "adx_strength")):
        df = streak(df, f"{base}_change", move, zero_as=0).withColumn("_way", F.coalesce(F.signum(move), F.lit(0.0)))
        df = streak(df, "_way", f"{move}_day", zero_as=1).drop("_way")
        turn = F.abs(f"{move}_day") == 1
        df = df.withColumn("_start", F.when(turn, lag(base)))
        out = f"{move}_start"
        df = df.withColumn("_start", going_on(df, F.col("_start"), out)).withColumn(out, ffill("_start")).drop("_start")
    turn = F.abs("adx_power_day") == 1
    df = df.withColumns({c: going_on(df, F.when(turn, x), out) for c, x, out in (("_v", value, "adx_power_start_value"), ("_d", F.col("adx_direction"), "adx_power_start_direction"))})
    df = df.withColumns({"adx_power_start_value": ffill("_v"), "adx_power_start_direction": ffill("_d")}).drop("_v", "_d")
    distance = value - F.col("adx_value_prediction")
    df = df.withColumns({"_strong": F.when(strength >= STRONG, 1).when(strength < STRONG, -1).otherwise(0), "_wave": F.when(value.between(-WAVE, WAVE), 1).otherwise(0),
                         "_status": _sign(distance > 0), "_away": F.abs(distance)})
    df = streak(streak(streak(df, "_strong", "adx_strong_day", zero_as=1), "_wave", "adx_wave_day"), "_status", "adx_distance_day")
    df = df.withColumn("adx_distance", normalize("_away") * F.col("_status"))
    df = df.withColumns({"adx_distance_change": F.col("adx_distance") - lag("adx_distance"), "adx_rate": F.col("adx_value_change") + F.col("adx_value_pred_change")})
    # What counts as up and down below and above zero, near it and far from it.
    rising, falling = F.col("adx_value_change") > 0, F.col("adx_value_change") < 0
    firmer, softer = F.col("adx_strength_change") > 0, F.col("adx_strength_change") < 0
    near = value <= WAVE
    up = F.when(value < 0, rising & softer).when(near, rising & softer & (F.col("adx_direction_start") < -5)).otherwise(rising & firmer)
    down = F.when(value < 0, falling).when(near, F.col("adx_value_change") < -0.5).otherwise(falling & softer)
    inside, longer = (value > -WAVE) & (value < WAVE), F.abs("adx_power_day") > F.abs("adx_direction_day")
    start, start_value = F.col("adx_power_start"), F.col("adx_power_start_value")
    false_up = (F.col("adx_direction_day") == 1) & (F.col("adx_power_day") < 0) & (start > WAVE) & (start_value > WAVE)
    false_down = (F.col("adx_direction_day") == -1) & (F.col("adx_power_day") > 0) & (start < -WAVE) & (start_value < -WAVE)
    trend = F.when(inside & longer & (false_up | false_down), 0.0).when(value.isNull(), 0.0).when(up, 1.0).when(down, -1.0).otherwise(0.0)
    return streak(df.withColumn("adx_trend", trend), "adx_trend", "adx_day").drop("_strong", "_wave", "_status", "_away")


#: Letters of indicators, as (condition for u, condition for d, else). A null condition does not hold.
LETTERS = {
    "kst": ("kst_diff > 0", "kst_diff <= 0", None), "cci": ("cci_ma > 0", "cci_ma <= 0", None), "eom": ("eom_diff > 0", "eom_diff <= 0", None), "fi": ("fi_ema > 0", "fi_ema <= 0", None),
    "psar": ("psar_up > 0", "psar_down > 0", ""), "stoch": ("stoch_diff > 1 OR stoch_k > 80", "stoch_diff < -1 OR stoch_k < 20", "n"), "bb": ("Close < bb_low", "Close > bb_high", ""),
    "trix": ("trix > _before", "trix < _before", "n"), "ao": ("ao > _before", "ao < _before", "n"),
}


def aroon_trend(df: DataFrame) -> DataFrame:
    """aroon_trend: u, d, n or empty, from the heights of aroon_up and aroon_down (1 digit) and where they go."""
    df = df.withColumns({"_up": F.round("aroon_up", 1), "_down": F.round("aroon_down", 1), "_gap": F.round(F.col("aroon_up") - F.col("aroon_down"), 1)})
    df = df.withColumns({f"{c}_change": F.col(c) - lag(c) for c in ("_up", "_down", "_gap")})
    # Heights that tell alone, and the band in which both may wave.
    tell = "CASE WHEN _down >= 96 OR (_down >= 88 AND _up <= 12) THEN 'd' WHEN _up >= 96 OR (_up >= 88 AND _down <= 12) THEN 'u' END"
    move = "CASE WHEN _down_change < 0 AND (_up_change >= 0 OR _down > _up) THEN 'u' WHEN _up_change < 0 AND (_down_change >= 0 OR _up > _down) THEN 'd' ELSE '' END"
    waves = "_gap BETWEEN -32 AND 32 AND ((_gap_change = 0 AND _up_change = _down_change AND _down_change < 0) OR (_up_change < 0 AND _down <= 4) OR (_down_change < 0 AND _up <= 4))"
    return df.withColumn("aroon_trend", F.expr(f"CASE WHEN {waves} THEN 'n' ELSE coalesce({tell}, {move}) END")).drop("_up", "_down", "_gap", "_up_change", "_down_change", "_gap_change")


def simple_trends(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """<name>_trend of each named indicator whose columns df holds: u, d or what stands for neither."""
    for name in names:
        if name == "aroon":
            df = aroon_trend(df)
            continue
        up, down, neither = LETTERS[name]
        if "_before" in up:
            df = df.withColumn("_before", lag(name))
        df = df.withColumn(f"{name}_trend", rule_value([(up, "u"), (down, "d")], neither)).drop("_before")
    return df


def trend_channel(df: DataFrame, max_period: int = 60, min_period: int = 5, skip: int = 3, margin: float = 0.3, least: float = 0.001) -> DataFrame:
    """linear_fit_high and linear_fit_low: lines through the newest highs and lows, drawn over all rows from the first one fitted.

    The fit runs between extremes of the last max_period rows and half of them, the newest skip - 1 left out; one of the four is the
    least High. A slope under `least` of the middle price gives a flat line at the extreme. Rows are counted from 0 in the fit and
    from 1 where the lines are drawn. Only the rows looked at leave the first exchange; symbols under `skip` rows have nulls.
    """
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("Date")))
    tail = df.select("symbol", "Date", "High", "Low", back.alias("_back"), (F.count("*").over(Window.partitionBy("symbol")) - back).alias("_x")).filter(F.col("_back") < max_period + skip)
    day_no = F.unix_date("Date")

    def extreme(c: str, n: int, sign: int) -> Column:
        """The first date with the greatest (or least) value of n rows."""
        return F.max_by("Date", F.when(F.col("_back").between(skip, skip + n - 1), F.struct(F.col(c) * sign, -day_no)))

    at = lambda n: F.max(F.when(F.col("_back") == n, F.col("Date")))
    half = max_period // 2
    ends = tail.groupBy("symbol").agg(
        F.array(extreme("High", half, 1), extreme("Low", half, -1), extreme("High", max_period, 1), extreme("High", max_period, -1)).alias("_at"),
        F.min(F.when(F.col("_back") <= max_period, F.col("Date"))).alias("_earliest"), at(skip).alias("_latest"), at(skip + min_period - 1).alias("_mid"))
    ends = ends.withColumn("_end", F.coalesce(F.array_max(F.filter("_at", lambda x: x > F.col("_mid"))), "_latest"))
    ends = ends.withColumn("_start", F.coalesce(F.array_max(F.filter("_at", lambda x: (x < F.col("_mid")) & (F.datediff("_end", x) > min_period))), "_earliest"))
    fitted, known = F.col("Date").between(F.col("_start"), F.col("_end")), F.col("Date").between(F.col("_start"), F.col("_latest"))
    aggregates = [F.min(F.when(fitted, F.col("_x"))).alias("_first"), F.count_if(fitted).alias("_n")]
    for c, pick in (("High", F.max), ("Low", F.min)):
        y = F.when(fitted, F.col(c))
        aggregates += [F.regr_slope(y, F.col("_x").cast("double")).alias(f"_s{c}"), F.regr_intercept(y, F.col("_x").cast("double")).alias(f"_i{c}"),
                       F.round((F.max(y) + F.min(y)) / 2, 3).alias(f"_m{c}"), F.stddev_samp(y).alias(f"_d{c}"), pick(F.when(known, F.col(c))).alias(f"_e{c}")]
    fits = tail.join(ends.select("symbol", "_start", "_end", "_latest"), "symbol").groupBy("symbol").agg(*aggregates)
    out = df.join(fits, "symbol", "left").withColumn("_row", F.row_number().over(by_symbol()))
    for c, side in (("High", 1), ("Low", -1)):
        flat = (F.col("_n") < 2) | (F.round(div(F.abs(f"_s{c}"), F.col(f"_m{c}")), 5) < least)
        line = F.when(flat, F.col(f"_e{c}")).otherwise(F.col(f"_s{c}") * F.col("_row") + F.col(f"_i{c}"))
        out = out.withColumn(f"linear_fit_{c.lower()}", F.when(F.col("_row") >= F.col("_first"), line + F.col(f"_d{c}") * (side * margin)))
    return out.drop("_row", *[c for c in fits.columns if c != "symbol"])


def renko_place(df: DataFrame) -> DataFrame:
    """After the renko block and candle_shape: the newest bricks held until the next, their dates, rows since, and where the body lies."""
    own = {"renko_real": F.when(F.col("renko_distance") > 0, "green").when(F.col("renko_distance") < 0, "red"), "renko_start": F.when(F.col("renko_o").isNotNull(), F.col("Date"))}
    out = df.withColumns(own).withColumn("_next", F.min("renko_start").over(by_symbol().rowsBetween(1, Window.unboundedFollowing)))
    out = out.withColumn("renko_end", F.when(F.col("renko_start").isNotNull(), F.coalesce("_next", F.max("Date").over(whole()))))
    out = out.withColumns({"renko_h": F.greatest("renko_o", "renko_c"), "renko_l": F.least("renko_o", "renko_c"), "renko_color": F.col("renko_real")})
    out = out.withColumns({c: ffill(c) for c in ("renko_o", "renko_h", "renko_l", "renko_c", "renko_color", "renko_distance", "renko_brick_number", "renko_start", "renko_end")})
    way = F.when(F.col("renko_real").isNotNull(), 0).when(F.col("renko_color") == "green", 1).when(F.col("renko_color") == "red", -1)
    out = streak(out.withColumn("_way", way), "_way", "renko_day")
    top, bottom = "body_top {} renko_{}", "body_bottom {} renko_{}"
    rules = [(" AND ".join(["renko_real IS NULL", *parts]), value) for parts, value in (
        ((top.format(">", "h"), "body_bottom >= renko_l AND body_bottom < renko_h"), "mid_up"), ((top.format("<=", "h"), bottom.format(">=", "l")), "mid"),
        ((top.format(">", "h"), bottom.format("<", "l")), "out"), ((bottom.format("<", "l"), "body_top > renko_l AND body_top <= renko_h"), "mid_down"))]
    rules = [("body_bottom >= renko_h OR renko_real = 'green'", "up"), *rules, ("body_top <= renko_l OR renko_real = 'red'", "down")]
    return out.withColumn("renko_position", rule_value(rules, "")).drop("_next", "_way")
