"""Where candles stand against lines, and the patterns of one and of several candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.series import rolling, rule_value
from marketloom.operators.candles import body_size_class, candle_gap, candle_place
from marketloom.panel import div, lag


def line_place(df: DataFrame, fast: str, slow: str, name: str) -> DataFrame:
    """<name>_distance (fast - slow, against slow) and <name>_place of the body against the band between two lines; needs candle_shape."""
    df = df.withColumns({f"{name}_distance": div(F.col(fast) - F.col(slow), F.col(slow)), "_hi": F.greatest(fast, slow), "_lo": F.least(fast, slow)})
    place = rule_value([("body_bottom >= _hi", "up"), ("body_top > _hi AND body_bottom < _hi AND body_bottom >= _lo", "mid_up"), ("body_top <= _hi AND body_bottom >= _lo", "mid"),
                        ("body_bottom < _lo AND body_top <= _hi AND body_top > _lo", "mid_down"), ("body_top <= _lo", "down"), ("body_top > _hi AND body_bottom < _lo", "out")], "")
    both = F.col(fast).isNotNull() & F.col(slow).isNotNull()
    return df.withColumn(f"{name}_place", F.when(both, place).otherwise("")).drop("_hi", "_lo")


def position_score(df: DataFrame, first: str = "kama", second: str = "ichimoku") -> DataFrame:
    """ki_distance (signs of both distances: r below, n at, g above 0), a score for each line, their sum and the position.

    Needs <line>_distance and <line>_place of both lines, and color. Without a place the score is null and the position empty.
    """
    letter = lambda c: F.when(F.col(c) < 0, "r").when(F.col(c) == 0, "n").when(F.col(c) > 0, "g")
    df = df.withColumn("ki_distance", F.coalesce(F.concat(letter(f"{first}_distance"), letter(f"{second}_distance")), F.lit("n")))
    for line in (first, second):
        p = F.col(f"{line}_place")
        by_place = F.when(p == "up", 1.0).when(p == "down", -1.0).when(p == "mid_up", 0.5).when(p == "mid_down", -0.5).when(p == "mid", 0.0).when((p == "out") & (F.col("color") != 0), F.col("color").cast("double"))
        df = df.withColumn(f"{line}_position_score", F.when(F.col(f"{line}_distance").isNotNull(), by_place))
    s = F.col("position_score")
    df = df.withColumn("position_score", F.col(f"{first}_position_score") + F.col(f"{second}_position_score"))
    return df.withColumn("position", F.when(s == 2, "up").when(s == -2, "down").when((s > 0) & (s < 2), "mid_up").when((s < 0) & (s > -2), "mid_down").when(s == 0, "mid").otherwise(""))


def candle_context(df: DataFrame) -> DataFrame:
    """Shape, size class, place and gap of each candle: what the patterns read beside the position."""
    return candle_gap(candle_place(body_size_class(df)))


#: Fixed values of the candle patterns: shares of the day's range that bodies and shadows have, how far ranges and bodies differ from
#: their means, how near two extremes are (of Close), how good a place is, and rows of an extreme.
LINE_BODY, DOJI_BODY, SMALL_BODY, SOLID_BODY, FULL_BODY = 0.05, 0.15, 0.3, 0.5, 0.75
NO_SHADOW, SOME_SHADOW, LONG_SHADOW, LIKE_SHADOWS = 0.05, 0.15, 0.6, 0.05
STILL, CALM, BUSY, WILD = -1, -0.5, 1, 1.5
FLAT, NEARLY_FLAT, GOOD_PLACE, EXTREME_ROWS = 0.002, 0.004, 0.33, 10

_TOP, _BOTTOM = "position = 'up'", "position = 'down'"
_PEAK, _TROUGH = f"{_TOP} AND extreme = 'u'", f"{_BOTTOM} AND extreme = 'd'"
_SPIKE = f"_wide AND entity_trend <> 'u' AND body_pct BETWEEN {LINE_BODY} AND {SMALL_BODY}"
_BELT = f"entity_trend <> 'd' AND body_pct > {SOLID_BODY}"
_PAIR = "_1_entity_trend <> 'd' AND entity_trend <> 'd'"
_RISES, _FALLS = "_1_color = -1 AND color = 1", "_1_color = 1 AND color = -1"

#: Patterns of one candle in stages (a stage reads the columns of those before), and of several: letter by condition, the last that holds.
ONE_CANDLE = [
    {"extreme": {f"{_TOP} AND High = _max": "u", f"{_BOTTOM} AND Low = _min": "d"},
     "window": {"gap > 1": "u", "gap < -1": "d"},
     "cross": {f"body_pct < {DOJI_BODY} AND (shadow_diff < {CALM} OR (shadow_diff < 0 AND body_diff < {CALM}))": "d", f"body_pct < {DOJI_BODY} AND shadow_diff > {WILD}": "u",
               f"body_pct < {LINE_BODY} OR (shadow_diff < {STILL} AND body_diff < {STILL})": "d"}},
    {"_shape": {f"{_SPIKE} AND shadow_upper_pct < {NO_SHADOW} AND shadow_lower_pct >= {LONG_SHADOW}": "u", f"{_SPIKE} AND shadow_lower_pct < {NO_SHADOW} AND shadow_upper_pct >= {LONG_SHADOW}": "d"}},
    {"meteor": {f"{_PEAK} AND _shape = 'd'": "d", f"{_TROUGH} AND _shape = 'd'": "u"},
     "hammer": {f"{_PEAK} AND _shape = 'u'": "d", f"{_TROUGH} AND _shape = 'u'": "u"},
     "belt": {f"{_BELT} AND {_BOTTOM} AND shadow_lower_pct <= {NO_SHADOW} AND shadow_upper_pct >= {SOME_SHADOW} AND color = 1": "u",
              f"{_BELT} AND {_TOP} AND shadow_upper_pct <= {NO_SHADOW} AND shadow_lower_pct >= {SOME_SHADOW} AND color = -1": "d"}},
]
SEVERAL_CANDLES = {
    "flat": {f"`cross` = 'n' AND {_TOP} AND (_high_diff <= {FLAT} OR (_high_diff <= {NEARLY_FLAT} AND rate <= 0 AND _upper_diff BETWEEN -{LIKE_SHADOWS} AND {LIKE_SHADOWS}))": "d",
             f"`cross` = 'n' AND {_BOTTOM} AND _low_diff <= {FLAT} AND (place_score > {GOOD_PLACE} OR color = 1)": "u"},
    "engulfing": {f"place = 'out' AND {_BOTTOM} AND {_PAIR} AND body_pct > {FULL_BODY} AND {_RISES}": "u", f"place = 'out' AND {_TOP} AND {_PAIR} AND body_pct > {FULL_BODY} AND {_FALLS}": "d"},
    "harami": {f"place = 'mid' AND {_BOTTOM} AND {_PAIR} AND _1_body_pct > {SOLID_BODY} AND body_pct > {FULL_BODY} AND {_RISES}": "u",
               f"place = 'mid' AND {_TOP} AND {_PAIR} AND _1_body_pct > {SOLID_BODY} AND body_pct > {FULL_BODY} AND {_FALLS}": "d"},
    "piercing": {f"place = 'mid_down' AND _1_position = 'down' AND {_RISES} AND entity_trend = 'u' AND _1_entity_trend <> 'd' AND _1__middle < body_top": "u",
                 f"place = 'mid_up' AND _1_position = 'up' AND {_FALLS} AND entity_trend = 'u' AND _1_entity_trend <> 'd' AND _1__middle > body_bottom": "d"},
    "star": {f"_1_place = 'down' AND place = 'up' AND {_BOTTOM} AND (ki_distance = 'rr' OR _1_extreme = 'd') AND _1_position = 'down' AND color = 1 AND entity_trend <> 'd'"
             " AND (entity_trend = 'u' OR _middle > _2_body_top) AND _1_entity_trend <> 'u' AND _1_body_top < _2_body_bottom AND _1_body_top < body_bottom": "u",
             f"_1_place = 'up' AND place = 'down' AND {_TOP} AND (ki_distance = 'gg' OR _1_extreme = 'u') AND _1_position = 'up' AND _2_color = 1 AND color = -1"
             " AND (entity_trend = 'u' OR _middle < _2__middle) AND _1_entity_trend <> 'u'": "d"},
}


def _letters(rules: dict[str, dict[str, str]]) -> dict[str, Column]:
    return {name: rule_value(list(conditions.items()), "n") for name, conditions in rules.items()}


def single_candle(df: DataFrame, young: bool = False) -> DataFrame:
    """extreme, window, cross, meteor, hammer and belt, each u, d or n. Needs candle_context and position.

    A meteor or hammer has a wide range against its mean; rows before that mean is full have none, or with young count as wide."""
    df = df.withColumns({"_max": rolling("High", EXTREME_ROWS, "max"), "_min": rolling("Low", EXTREME_ROWS, "min"), "_wide": F.coalesce(F.col("shadow_diff") > BUSY, F.lit(young))})
    for stage in ONE_CANDLE:
        df = df.withColumns(_letters(stage))
    return df.drop("_max", "_min", "_wide", "_shape")


def multi_candle(df: DataFrame) -> DataFrame:
    """flat, engulfing, harami, piercing and star, each u, d or n. Needs single_candle, ki_distance and rate."""
    df = df.withColumn("_middle", (F.col("body_top") + F.col("body_bottom")) * 0.5)
    df = df.withColumns({f"_1_{c}": lag(c) for c in ("color", "body_top", "body_bottom", "_middle", "body_pct", "position", "entity_trend", "place", "extreme", "shadow_upper_pct", "High", "Low")}
                        | {f"_2_{c}": lag(c, 2) for c in ("color", "body_top", "body_bottom", "_middle")})
    df = df.withColumns({"_high_diff": F.abs(div(F.col("High") - F.col("_1_High"), F.col("Close"))), "_low_diff": F.abs(div(F.col("Low") - F.col("_1_Low"), F.col("Close"))), "_upper_diff": F.col("shadow_upper_pct") - F.col("_1_shadow_upper_pct")})
    df = df.withColumns(_letters(SEVERAL_CANDLES))
    return df.drop("_middle", "_high_diff", "_low_diff", "_upper_diff", *[c for c in df.columns if c.startswith(("_1_", "_2_"))])
