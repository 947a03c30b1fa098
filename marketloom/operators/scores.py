"""From trends, levels and patterns to scores, labels, signals and actions.

Rules are tables of SQL conditions over the panel's columns. Their thresholds and weights are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.series import rule_value, streak
from marketloom.panel import lag

_c = F.col


def _holds(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def _joined(pairs: list[tuple[Column, str]], by: str) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(hit, F.lit(name)) for hit, name in pairs]), lambda x: x.isNotNull()), by)


def trigger_score(df: DataFrame) -> DataFrame:
    """trigger_up_score (breaks and half of support), trigger_down_score, their sum with 2 digits, texts, and trigger_day. Needs level_scores."""
    shown = lambda name, sign: F.when(_c(f"{name}_score") != 0, F.concat(F.lit(f"{sign}{name}("), _c(f"{name}_score").cast("string"), F.lit(")")))
    text = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", ")
    df = df.withColumns({"trigger_up_score": _c("break_up_score") + _c("support_score") * 0.5, "trigger_down_score": _c("break_down_score") + _c("resistant_score") * 0.5,
                         "trigger_up_description": text(shown("support", "+"), shown("break_up", "+")), "trigger_down_description": text(shown("resistant", "-"), shown("break_down", "-"))})
    df = df.withColumn("trigger_score", F.bround(_c("trigger_up_score") + _c("trigger_down_score"), 2))
    df = df.withColumn("trigger_score_symbol", F.coalesce(F.signum("trigger_score"), F.lit(0.0)))
    return streak(df, "trigger_score_symbol", "trigger_day", zero_as=1)


def trend_state(df: DataFrame) -> DataFrame:
    """trend_score (how value and strength of adx move together), its change and direction, trend (up, down, wave) and trend_day."""
    side = F.when(_c("adx_value") > 0, 1).otherwise(-1)
    df = df.withColumn("trend_score", F.bround(_c("adx_value_change") + _c("adx_strength_change") * side, 2))
    df = df.withColumn("trend_score_change", F.bround(_c("trend_score") - lag("trend_score"), 2)).withColumn("_way", F.when(_c("trend_score_change") > 0, 1).otherwise(-1))
    df = streak(df, "_way", "s_direction_day", zero_as=0).drop("_way")
    df = df.withColumn("trend", rule_value([("adx_trend = 1", "up"), ("adx_trend = -1", "down"), ("adx_trend = 0", "wave")], ""))
    return streak(df, "adx_trend", "trend_day", zero_as=1)


#: Conditions in order, the last that holds gives the state; then the two that take a false alarm back, and the scores.
POTENTIALS = [
    ("trend_day < 0 AND trend = 'wave'", "down_up"), ("trend_day > 0 AND trend = 'wave'", "up_down"), ("trend_day = 1", "up_1"), ("trend_day = -1", "down_1"),
    ("trend_day > 1 AND trend <> 'wave'", "up"), ("trend_day < -1 AND trend <> 'wave'", "down"),
]
FALSE_ALARMS = [
    ("potential = 'down_up' AND abs(adx_power_day) >= abs(adx_direction_day) AND adx_power_day <> 0 AND trigger_score <= 0", "down"),
    ("potential = 'up_down' AND trigger_score >= 0 AND ((abs(adx_direction_day) >= abs(adx_power_day) AND adx_direction_start < -10)"
     " OR (abs(adx_power_day) >= abs(adx_direction_day) AND adx_value > 10 AND adx_strength > 25))", "up"),
]
POTENTIAL_SCORES = {"down_up": 3, "up_1": 2, "up": 1, "down": -1, "down_1": -2, "up_down": -3, "": 0}


def potential(df: DataFrame) -> DataFrame:
    """What the trend's state promises, and its score from 3 to -3. Needs trend_state and trigger_score."""
    df = df.withColumn("potential", rule_value(POTENTIALS, ""))
    for condition, value in FALSE_ALARMS:
        df = df.withColumn("potential", F.when(_holds(condition), value).otherwise(_c("potential")))
    scores = F.create_map(*[F.lit(x) for pair in POTENTIAL_SCORES.items() for x in pair])
    return df.withColumn("potential_score", F.element_at(scores, _c("potential")))


def _any(lines: str, suffix: str, test: str) -> str:
    return "(" + " OR ".join(f"{x}_{suffix} {test}" for x in lines.split()) + ")"


_EDGES = "kama_slow kijun gap_top gap_bottom"
#: (name, weight, condition for up, its text, condition for down, its text).
PATTERNS = [
    ("overdone", 0.25, "rsi < 25", "oversold", "rsi > 75", "overbought"),
    ("key_break", 1.0, "ki_distance = 'rr' AND position IN ('down', 'mid_down') AND ichimoku_place IN ('down', 'mid_down') AND kama_place IN ('down', 'mid_down') AND (tankan_day = 1 OR kama_fast_day = 1)", "up from below",
     "ki_distance = 'gg' AND position IN ('up', 'mid_up') AND ichimoku_place IN ('up', 'mid_up') AND kama_place IN ('up', 'mid_up') AND (tankan_day = -1 OR kama_fast_day = -1)", "down from above"),
    ("long_edge", 1.0,
     "(ki_distance IN ('gr', 'gn', 'gg') OR position IN ('up', 'mid_up', 'mid_down', 'mid')) AND `cross` = 'n' AND shadow_upper_pct < shadow_lower_pct"
     " AND (color = 1 OR shadow_lower_pct > 0.25 OR (tankan > High AND kijun < Low AND kijun_support > 0) OR (kama_fast > High AND kama_slow < Low AND kama_slow_support > 0))"
     f" AND ({_any('kama_slow kijun', 'support', '> 0')} OR ({_any('gap_top gap_bottom', 'support', '> 0')} AND body_top < gap_top AND body_bottom > gap_bottom)"
     f" OR (color = 1 AND long_shadow = 'u' AND {_any('kama_slow kijun gap_top', 'break_down', '< 0')}) OR ((place_score > 0 OR color = 1) AND {_any(_EDGES, 'break_up', '> 0')}))", "long support",
     "(ki_distance IN ('rg', 'rn', 'rr') OR position IN ('down', 'mid_up', 'mid_down', 'mid'))"
     f" AND ({_any(_EDGES, 'resistant', '< 0')} OR ((color = -1 OR long_shadow = 'd' OR resistant_score < 0) AND {_any(_EDGES, 'break_up', '> 0')})"
     f" OR ((place_score < 0 OR color = -1) AND {_any(_EDGES, 'break_down', '< 0')}))", "long resistance"),
    ("turn", 1.0, "(trend_day = 1 AND _trend_day < -5) OR (adx_direction > 1 AND (trend_day = 1 OR (trend = 'up' AND _trend <> 'up')))", "trend turns up",
     "(trend_day = -1 AND _trend_day > 5) OR (adx_direction < -1 AND (trend_day = -1 OR (trend = 'down' AND _trend <> 'down')))", "trend turns down"),
    ("start", 1.0, "position IN ('down', 'mid_down') AND trend_day = 1", "up from below", "position IN ('up', 'mid_up') AND trend_day = -1", "down from above"),
    ("waves", 0.25, "false", "waves",
     "adx_strong_day < 0 AND ((adx_value > -20 AND adx_value < 20 AND ((adx_direction_start > -10 AND adx_direction_start < 15) OR (adx_strength_change < 1 AND adx_value_change > -1 AND adx_value_change < 1)))"
     " OR (adx_wave_day >= 3 AND adx_direction_start > -15 AND adx_direction_start < 15))", "waves"),
    ("touch", 0.75, "position = 'down' AND color = 1 AND flat_day = 1", "bottom", "position = 'up' AND color = -1 AND flat_day = -1", "top"),
    ("short_turn", 1.0, "trend = 'up' AND trend_score_change > 0", "adx falls less", "trend = 'down' AND trend_score_change < 0", "adx rises less"),
    ("middle_turn", 1.0, "ichimoku_distance <= 0 AND ichimoku_distance_change > 0 AND tankan_rate >= 0", "ich falls less", "ichimoku_distance >= 0 AND ichimoku_distance_change < 0 AND tankan_rate <= 0", "ich rises less"),
]


def pattern_score(df: DataFrame, rules: list[tuple] = PATTERNS) -> DataFrame:
    """A column for each rule (its signed weight), up and down sums, their total, change and text ('+[..] | -[..]').

    A text of the down side alone keeps the blank before it. Needs potential, pattern_days and the levels.
    """
    df = df.withColumns({"_trend_day": lag("trend_day"), "_trend": F.coalesce(lag("trend"), F.lit(""))})
    held = [(name, weight, _holds(up), up_text, _holds(down), down_text) for name, weight, up, up_text, down, down_text in rules]
    plus, minus = (lambda hit, w: F.when(hit, w).otherwise(0.0)), (lambda hit, w: F.when(hit, -w).otherwise(0.0))
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    df = df.withColumns({name: plus(up, w) + minus(down, w) for name, w, up, _, down, _ in held}
                        | {"pattern_up_score": total([plus(up, w) for _, w, up, *_ in held]), "pattern_down_score": total([minus(down, w) for _, w, _, _, down, _ in held]),
                           "_up": _joined([(up, t) for _, _, up, t, _, _ in held], ", "), "_down": _joined([(down, t) for *_, down, t in held], ", ")})
    df = df.withColumn("pattern_score", F.bround(_c("pattern_up_score") + _c("pattern_down_score"), 2)).withColumn("pattern_score_change", _c("pattern_score") - lag("pattern_score"))
    up, down = F.concat(F.lit("+["), "_up", F.lit("]")), F.concat(F.lit("-["), "_down", F.lit("]"))
    text = F.when((_c("_up") != "") & (_c("_down") != ""), F.concat(up, F.lit(" | "), down)).when(_c("_up") != "", up).when(_c("_down") != "", F.concat(F.lit(" "), down)).otherwise("")
    return df.withColumn("pattern_description", text).drop("_trend_day", "_trend", "_up", "_down")


_UNHELD = "long_edge <= 0 AND kama_slow_support = 0 AND kama_slow_break_up = 0"
#: The first that holds counts: (condition, label).
LABELS = [
    (f"ichimoku_distance < 0 AND ichimoku_distance_change < 0 AND trend_score < 0 AND trend_score_change < 0 AND {_UNHELD}", "2 down"),
    (f"ichimoku_distance > 0 AND ichimoku_distance_change < 0 AND trend_score < 0 AND trend_score_change < 0 AND {_UNHELD} AND ki_distance IN ('gg', 'gr')", "1.5 down"),
    (f"ichimoku_distance_change <= 0 AND trend = 'wave' AND (trend_day >= 0 OR trend_score < 0 OR trend_score_change <= 0 OR place_score < 0) AND {_UNHELD}", "wave down"),
    (f"ichimoku_distance <= 0 AND ichimoku_distance_change <= 0 AND (trend_score_change < 0 OR (trend_score < 0 AND place_score < 0)) AND (place_score <= 0.33 OR `cross` <> 'n') AND {_UNHELD}", "stall down"),
    ("(long_edge < 0 OR kama_slow_resistant < 0 OR kama_slow_break_down < 0) AND trigger_score <= 0", "long resistance"),
]


def label(df: DataFrame, rules: list[tuple[str, str]] = LABELS) -> DataFrame:
    """label and label_score: -1, -2, .. by the first rule that holds; empty and 0 where none does."""
    score, name = F.lit(0), F.lit("")
    for i, (condition, text) in reversed(list(enumerate(rules, 1))):
        score, name = F.when(_holds(condition), -i).otherwise(score), F.when(_holds(condition), text).otherwise(name)
    return df.withColumns({"label_score": score, "label": name})


#: (name, condition, signal): of the first table the last that holds counts; the second is applied in turn to what came before.
SIGNALS = [
    ("fall turns up", "potential = 'down_up' AND (break_score > 0 OR candle_pattern_score > 0)", "buy"),
    ("rise turns down", "potential = 'up_down' AND (break_score < 0 OR candle_pattern_score < 0 OR (position = 'up' AND `cross` <> 'n'))", "sell"),
    ("rise starts", "potential = 'up_1' AND trend_score_change > 0", "buy"),
    ("fall starts", "potential = 'down_1' AND (position NOT IN ('up', 'mid_up') OR break_down_score < 0)", "sell"),
    ("top", "position = 'up' AND (`cross` <> 'n' OR long_shadow = 'd') AND (flat = 'd' OR overdone < 0 OR resistant_score < 0)", "sell"),
]
OVERRIDES = [
    ("back to the rise", "signal = '' AND _potential = 'up_down' AND potential = 'up' AND place_score > 0.33 AND (position = 'up' OR trigger_score > 0)", "buy"),
    ("low, not confirmed", "signal = 'buy' AND position IN ('down', 'mid_down') AND break_up_score = 0 AND (candle_pattern_score <= 0 OR place_score <= 0)", ""),
    ("high, beware", "signal = 'buy' AND position IN ('up', 'mid_up') AND place_score < 0", ""),
    ("waves in the middle", "signal = 'buy' AND position IN ('mid', 'mid_up', 'mid_down') AND adx_strong_day < 0 AND (break_down_score <= 0 OR resistant_score < 0 OR place_score < 0)", ""),
    ("doji high up", "signal = 'buy' AND position = 'up' AND `cross` <> 'n' AND (resistant_score < 0 OR candle_pattern_score < 0 OR pattern_score < 0)", ""),
    ("rising", "signal = '' AND potential IN ('down_up', 'up_1', 'up') AND trend = 'up' AND (place IN ('up', 'mid_up', 'out') OR gap > 0)", "to_buy"),
    ("falling", "signal = '' AND potential IN ('up_down', 'down_1', 'down') AND (place IN ('down', 'mid_down', 'out') OR gap < 0)", "to_sell"),
]


def signal(df: DataFrame, rules: list[tuple] = SIGNALS, overrides: list[tuple] = OVERRIDES) -> DataFrame:
    """signal (buy, sell, to_buy, to_sell or empty), the names of the rules that held, and signal_day since the last buy or sell.

    Each override is a stage of its own, since it reads the signal that the one before left.
    """
    df = df.withColumns({"_potential": lag("potential"), "signal": rule_value([(c, v) for _, c, v in rules], ""), "_names": F.filter(F.array(*[F.when(_holds(c), F.lit(n)) for n, c, _ in rules]), lambda x: x.isNotNull())})
    for name, condition, value in overrides:
        df = df.withColumn("_hit", _holds(condition))
        df = df.withColumns({"signal": F.when(_c("_hit"), value).otherwise(_c("signal")), "_names": F.when(_c("_hit"), F.array_append("_names", F.lit(name))).otherwise(_c("_names"))})
    df = df.withColumn("signal_description", F.array_join("_names", ", ")).withColumn("_way", F.when(_c("signal") == "buy", 1).when(_c("signal") == "sell", -1).otherwise(0))
    return streak(df, "_way", "signal_day", zero_as=1).drop("_potential", "_names", "_hit", "_way")


_UPWARD, _DOWNWARD = "potential IN ('up', 'up_1', 'down_up')", "potential IN ('down', 'down_1', 'up_down')"
#: Flags by name.
ACTIONS = {
    "hold_up": "ichimoku_distance > 0 AND (ichimoku_rate > 0 OR ichimoku_distance_change > 0) AND position = 'up' AND trend = 'up' AND trend_score > 0",
    "watch_turn_up": f"middle_turn = 1 AND (short_turn = 1 OR {_UPWARD})",
    "trigger_buy": f"{_UPWARD} AND trend = 'up' AND trend_score > 0 AND trigger_score > 0 AND NOT coalesce(position = 'up' AND ichimoku_direction_day < 0, false)",
    "stay_out": "ichimoku_distance < 0 AND (ichimoku_rate < 0 OR ichimoku_distance_change < 0) AND position = 'down' AND trend = 'down' AND trend_score < 0",
    "watch_turn_down": f"middle_turn = -1 AND (short_turn = -1 OR {_DOWNWARD})",
    "trigger_sell": "potential IN ('down', 'down_1') AND trend_score < 0 AND (trigger_score < 0 OR place_score < 0 OR pattern_score < 0)"
                    " AND NOT coalesce(position = 'up' AND place_score > 0 AND break_down_score = 0 AND resistant_score = 0, false)",
}


def actions(df: DataFrame, rules: dict[str, str] = ACTIONS) -> DataFrame:
    """1 or 0 for each action; the two triggers are muted where waves high up speak against them."""
    return df.withColumns({name: F.when(_holds(condition), 1).otherwise(0) for name, condition in rules.items()})
