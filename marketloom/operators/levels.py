"""Level lines: breaks, support and resistance, and the nearest of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.series import streak
from marketloom.operators.trends import close_crossing

_c = F.col
#: How near (against the base line) the day's extreme comes to a line that holds it, and the shadow that shows it.
NEAR, CLOSE_BY, SHADOW = 0.02, 0.01, 0.2
#: Weights of breaks; gap lines count nothing, other lines half.
KEY_LINES, GAP_LINES, OTHER_WEIGHT = ("tankan", "kijun", "kama_fast", "kama_slow"), ("gap_top", "gap_bottom"), 0.5


def _held(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _weight(line: str) -> float:
    return 1.0 if line in KEY_LINES else 0.0 if line in GAP_LINES else OTHER_WEIGHT


def _names(lines: list[str], suffix: str) -> Column:
    """The lines whose column is not 0, in order of name."""
    each = F.array(*[F.when(_c(f"{x}_{suffix}") != 0, F.lit(x)) for x in sorted(lines)])
    return F.filter(each, lambda x: x.isNotNull())


def break_levels(df: DataFrame, lines: list[str]) -> DataFrame:
    """<line>_break_up and <line>_break_down: the line's weight where Close crosses it, or a body of that colour spans it.

    A doji (cross other than n) has to lie beyond the line with its whole body. Gap lines take no break on the day of a strict gap
    of that side. Needs candle_shape, cross and gap; <line>_day where it is missing is added. Lines are rounded to 3 digits.
    """
    df = df.withColumns({x: F.round(x, 3) for x in lines})
    for x in lines:
        df = df if f"{x}_day" in df.columns else close_crossing(df, x)
    new = {}
    for x in lines:
        line, spanned = _c(x), (_c("body_top") > _c(x)) & (_c("body_bottom") < _c(x))
        for side, sign, beyond in (("up", 1, _c("body_bottom") > line), ("down", -1, _c("body_top") < line)):
            hit = ((_c(f"{x}_day") == sign) | ((_c("color") == sign) & spanned)) & ((_c("cross") == "n") | beyond)
            if x in GAP_LINES:
                hit = hit & (_c("gap") != 2 * sign)
            new[f"{x}_break_{side}"] = F.when(hit, sign * _weight(x)).otherwise(0.0)
    return df.withColumns(new)


def support_resistance(df: DataFrame, lines: list[str], base: str = "kama_slow") -> DataFrame:
    """<line>_support (1 or 0) and <line>_resistant (-1 or 0). Needs break_levels.

    A line supports when the body stays above it without a break and the day's Low comes near: with a lower shadow, or on a rising
    day very near. It also supports when the day dips to it, or starts below and ends above it. Resistance mirrors this, and a
    doji whose range holds the line meets resistance wherever its shadows lie.
    """
    middle = (_c("High") + _c("Low")) / 2
    lower, upper = _c("shadow_lower_pct"), _c("shadow_upper_pct")
    near = lambda extreme, line, limit: F.abs(_c(extreme) - line) / F.when(_c(base) != 0, _c(base)) < limit
    new = {}
    for x in lines:
        line, day = _c(x), _c(f"{x}_day")
        kept = (_c("body_bottom") > line) & (_c(f"{x}_break_up") == 0)
        shadow = (((_c("color") == 1) & (middle > line)) | ((_c("color") == -1) & (_c("Close") > line))) & ((lower > SHADOW) | (lower > upper)) & ((_c("cross") == "n") | (_c("Low") > line)) & near("Low", line, NEAR)
        rising = (_c("color") == 1) & (day != 1) & near("Low", line, CLOSE_BY)
        dips = ((_c("Open") > line) & (_c("Low") <= line) & (_c("Close") >= line)) | ((day != 1) & (_c("Open") < line) & (_c("Close") > line))
        touched = dips & (_c("body_bottom") >= line) & (_c(f"{x}_break_up") == 0)
        new[f"{x}_support"] = F.when(_held(kept & (shadow | rising)) | _held(touched), 1.0).otherwise(0.0)
        kept = (_c("body_top") < line) & (_c(f"{x}_break_down") == 0)
        shadow = (((_c("color") == -1) & (middle < line)) | ((_c("color") == 1) & (_c("Close") < line))) & ((upper > SHADOW) | (upper > lower)) & near("High", line, NEAR)
        doji = (_c("cross") != "n") & (_c("High") > line) & (line > _c("Low"))
        falling = (_c("color") == -1) & (day != -1) & near("High", line, CLOSE_BY)
        rises = ((_c("Open") < line) & (_c("High") >= line) & (_c("Close") <= line)) | ((day != -1) & (_c("Open") > line) & (_c("Close") < line))
        touched = rises & (_c("body_top") <= line) & (_c(f"{x}_break_down") == 0)
        new[f"{x}_resistant"] = F.when(_held(kept & (shadow | doji | falling)) | _held(touched), -1.0).otherwise(0.0)
    return df.withColumns(new)


def level_scores(df: DataFrame, lines: list[str]) -> DataFrame:
    """Sums over the lines: support, resistant, break_up and break_down scores with the names of their lines, boundary_score (the
    first two) and break_score."""
    total = lambda suffix: reduce(lambda a, b: a + b, [_c(f"{x}_{suffix}") for x in lines])
    kinds = ("support", "resistant", "break_up", "break_down")
    df = df.withColumns({f"{k}_score": total(k) for k in kinds} | {f"{k}_description": F.array_join(_names(lines, k), ", ") for k in kinds})
    return df.withColumns({"boundary_score": _c("support_score") + _c("resistant_score"), "break_score": _c("break_up_score") + _c("break_down_score")})


def nearest_levels(df: DataFrame, lines: list[str]) -> DataFrame:
    """On each symbol's newest row: the lowest line that resists (resistanter, resistant) and the highest that supports (supporter,
    support). Equal lines go by name; other rows hold nulls and empty names."""
    newest = _c("Date") == F.max("Date").over(Window.partitionBy("symbol"))
    for kind, pick in (("resistant", F.array_min), ("support", F.array_max)):
        each = F.array(*[F.when(_c(f"{x}_{kind}") != 0, F.struct(_c(x).alias("at"), F.lit(x).alias("line"))) for x in lines])
        best = pick(F.filter(each, lambda x: x.isNotNull()))
        df = df.withColumn("_best", F.when(newest, best))
        df = df.withColumns({kind: _c("_best.at"), f"{kind}er" if kind == "support" else "resistanter": F.coalesce("_best.line", F.lit(""))}).drop("_best")
    return df


#: Weights of candle patterns on their first day; a doji counts as down only, and weighs nothing.
PATTERN_WEIGHTS = {"window": 1, "cross": 0, "meteor": 1, "hammer": 1, "belt": 1, "flat": 1, "engulfing": 1, "harami": 1, "piercing": 1, "star": 2, "long_shadow": 1}


def pattern_days(df: DataFrame, weights: dict[str, float] = PATTERN_WEIGHTS) -> DataFrame:
    """<pattern>_day: days since each candle pattern (letters u, d, n) came up, and the scores and names of those that came up today."""
    sides: dict[str, list] = {"up": [], "down": []}
    for name, weight in weights.items():
        way = F.when(_c(name) == "u", 1).when(_c(name) == "d", -1).otherwise(0)
        df = streak(df.withColumn("_way", way), "_way", f"{name}_day", zero_as=1, one_restart=True).drop("_way")
        day = _c(f"{name}_day")
        if name == "cross":
            sides["down"].append((name, F.abs(day) == 1, -weight))
        else:
            sides["up"].append((name, day == 1, weight))
            sides["down"].append((name, day == -1, -weight))
    for side, rules in sides.items():
        score = reduce(lambda a, b: a + b, [F.when(hit, float(w)).otherwise(0.0) for _, hit, w in rules])
        names = F.filter(F.array(*[F.when(hit, F.lit(n)) for n, hit, _ in rules]), lambda x: x.isNotNull())
        df = df.withColumns({f"candle_pattern_{side}_score": score, f"candle_pattern_{side}_description": F.array_join(names, ", ")})
    return df.withColumn("candle_pattern_score", _c("candle_pattern_up_score") + _c("candle_pattern_down_score"))
