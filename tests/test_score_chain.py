"""The chain of scores on real bars against a plain version, row by row: trend's state, potential, patterns, label, signal, actions."""

import math

import pytest
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.plans import analysis

SF = "/root/testdata/sf0.001"
LINES = ["kama_fast", "kama_slow", "tankan", "kijun", "gap_top", "gap_bottom"]


class Row:
    """A row whose missing values compare as false."""

    def __init__(self, values):
        self.values = {k: None if v is None or (isinstance(v, float) and math.isnan(v)) else v for k, v in values.items()}

    def __getitem__(self, name):
        return self.values[name]

    def gt(self, name, x):
        return self[name] is not None and self[name] > x

    def lt(self, name, x):
        return self[name] is not None and self[name] < x

    def ge(self, name, x):
        return self[name] is not None and self[name] >= x

    def le(self, name, x):
        return self[name] is not None and self[name] <= x

    def between(self, name, low, high):
        return self.gt(name, low) and self.lt(name, high)

    def any(self, lines, suffix, sign):
        return any((self.gt if sign > 0 else self.lt)(f"{x}_{suffix}", 0) for x in lines)


@pytest.fixture(scope="module")
def chains(spark):
    bars = panel.trade_bars(spark, SF, "p_brand").filter(F.col("symbol").isin("Brand#11", "Brand#23", "Brand#45"))
    out = analysis.feature_pipeline(bars).toPandas().sort_values(["symbol", "Date"])
    return [[Row(r) for r in p.to_dict("records")] for _, p in out.groupby("symbol")]


def pairs(chains):
    for rows in chains:
        yield from zip([None, *rows], rows)


def runs(values, at_zero=1):
    out, last = [], 0
    for v in values:
        last = last + at_zero * ((last > 0) - (last < 0)) if v == 0 else last + v if v * last > 0 else v
        out.append(last)
    return out


def test_trend_state(chains):
    for rows in chains:
        assert [r["trend"] for r in rows] == [{1: "up", -1: "down", 0: "wave"}[r["adx_trend"]] for r in rows]
        assert [r["trend_day"] for r in rows] == runs([r["adx_trend"] for r in rows])
        assert [r["s_direction_day"] for r in rows] == runs([1 if r.gt("trend_score_change", 0) else -1 for r in rows], 0)
        for before, r in zip([None, *rows], rows):
            if r["trend_score"] is not None:
                want = r["adx_value_change"] + (r["adx_strength_change"] if r.gt("adx_value", 0) else -r["adx_strength_change"])
                assert abs(r["trend_score"] - want) <= 0.0051
                if before and before["trend_score"] is not None:
                    assert abs(r["trend_score_change"] - (r["trend_score"] - before["trend_score"])) < 1e-9
    assert {r["trend"] for rows in chains for r in rows} == {"up", "down", "wave"}


def plain_potential(r):
    day, trend = r["trend_day"], r["trend"]
    if trend == "wave":
        name = "down_up" if day < 0 else "up_down" if day > 0 else ""
    else:
        name = ""
    if day in (1, -1):
        name = "up_1" if day == 1 else "down_1"
    if trend != "wave" and abs(day) > 1:
        name = "up" if day > 1 else "down"
    power, direction = r["adx_power_day"], r["adx_direction_day"]
    known = power is not None and direction is not None
    if name == "down_up" and known and abs(power) >= abs(direction) and power != 0 and r.le("trigger_score", 0):
        name = "down"
    early = known and abs(direction) >= abs(power) and r.lt("adx_direction_start", -10)
    firm = known and abs(power) >= abs(direction) and r.gt("adx_value", 10) and r.gt("adx_strength", 25)
    if name == "up_down" and r.ge("trigger_score", 0) and (early or firm):
        name = "up"
    return name


def test_potential(chains):
    scores, seen = {"down_up": 3, "up_1": 2, "up": 1, "down": -1, "down_1": -2, "up_down": -3, "": 0}, set()
    for rows in chains:
        for r in rows:
            assert r["potential"] == plain_potential(r), (r["symbol"], r["Date"])
            assert r["potential_score"] == scores[r["potential"]]
            seen.add(r["potential"])
    assert len(seen) >= 6


def plain_patterns(before, r):
    """name -> (weight, up and its text, down and its text)."""
    low, high = ("down", "mid_down"), ("up", "mid_up")
    edges = ("kama_slow", "kijun", "gap_top", "gap_bottom")
    ki, color, upper, lower = r["ki_distance"], r["color"], r["shadow_upper_pct"], r["shadow_lower_pct"]
    first = lambda side: r["tankan_day"] == side or r["kama_fast_day"] == side
    inside = lambda top, bottom: r[top] is not None and r[bottom] is not None and r.lt("High", r[top]) and r.gt("Low", r[bottom])
    held = (inside("tankan", "kijun") and r.gt("kijun_support", 0)) or (inside("kama_fast", "kama_slow") and r.gt("kama_slow_support", 0))
    in_gap = r["gap_top"] is not None and r["gap_bottom"] is not None and r["body_top"] < r["gap_top"] and r["body_bottom"] > r["gap_bottom"]
    longer = upper is not None and lower is not None and upper < lower
    up_edge = ((ki in ("gr", "gn", "gg") or r["position"] in ("up", "mid_up", "mid_down", "mid")) and r["cross"] == "n" and longer
               and (color == 1 or lower > 0.25 or held)
               and (r.any(("kama_slow", "kijun"), "support", 1) or (r.any(("gap_top", "gap_bottom"), "support", 1) and in_gap)
                    or (color == 1 and r["long_shadow"] == "u" and r.any(("kama_slow", "kijun", "gap_top"), "break_down", -1))
                    or ((r.gt("place_score", 0) or color == 1) and r.any(edges, "break_up", 1))))
    down_edge = ((ki in ("rg", "rn", "rr") or r["position"] in ("down", "mid_up", "mid_down", "mid"))
                 and (r.any(edges, "resistant", -1) or ((color == -1 or r["long_shadow"] == "d" or r.lt("resistant_score", 0)) and r.any(edges, "break_up", 1))
                      or ((r.lt("place_score", 0) or color == -1) and r.any(edges, "break_down", -1))))
    day, trend, was_day, was = r["trend_day"], r["trend"], before and before["trend_day"], before["trend"] if before else ""
    turn = lambda side, name: (day == side and was_day is not None and was_day * side < -5) or (
        (r.gt("adx_direction", 1) if side > 0 else r.lt("adx_direction", -1)) and (day == side or (trend == name and was != name)))
    wave = r.lt("adx_strong_day", 0) and ((r.between("adx_value", -20, 20) and (r.between("adx_direction_start", -10, 15) or (r.lt("adx_strength_change", 1) and r.between("adx_value_change", -1, 1))))
                                          or (r.ge("adx_wave_day", 3) and r.between("adx_direction_start", -15, 15)))
    return {
        "overdone": (0.25, r.lt("rsi", 25), "oversold", r.gt("rsi", 75), "overbought"),
        "key_break": (1.0, ki == "rr" and r["position"] in low and r["ichimoku_place"] in low and r["kama_place"] in low and first(1), "up from below",
                      ki == "gg" and r["position"] in high and r["ichimoku_place"] in high and r["kama_place"] in high and first(-1), "down from above"),
        "long_edge": (1.0, up_edge, "long support", down_edge, "long resistance"),
        "turn": (1.0, turn(1, "up"), "trend turns up", turn(-1, "down"), "trend turns down"),
        "start": (1.0, r["position"] in low and day == 1, "up from below", r["position"] in high and day == -1, "down from above"),
        "waves": (0.25, False, "waves", wave, "waves"),
        "touch": (0.75, r["position"] == "down" and color == 1 and r["flat_day"] == 1, "bottom", r["position"] == "up" and color == -1 and r["flat_day"] == -1, "top"),
        "short_turn": (1.0, trend == "up" and r.gt("trend_score_change", 0), "adx falls less", trend == "down" and r.lt("trend_score_change", 0), "adx rises less"),
        "middle_turn": (1.0, r.le("ichimoku_distance", 0) and r.gt("ichimoku_distance_change", 0) and r.ge("tankan_rate", 0), "ich falls less",
                        r.ge("ichimoku_distance", 0) and r.lt("ichimoku_distance_change", 0) and r.le("tankan_rate", 0), "ich rises less"),
    }


def test_pattern_score(chains):
    seen = set()
    for rows in chains:
        for before, r in zip([None, *rows], rows):
            want = plain_patterns(before, r)
            for name, (weight, up, _, down, _) in want.items():
                assert r[name] == weight * (bool(up) - bool(down)), (name, r["symbol"], r["Date"])
                seen |= {(name, 1)} if up else set()
                seen |= {(name, -1)} if down else set()
            ups, downs = ([(w, t) for w, t, hit in side if hit] for side in zip(*(((w, ut, u), (w, dt, dn)) for w, u, ut, dn, dt in want.values())))
            assert r["pattern_up_score"] == sum(w for w, _ in ups) and r["pattern_down_score"] == -sum(w for w, _ in downs)
            plus, minus = f"+[{', '.join(t for _, t in ups)}]", f"-[{', '.join(t for _, t in downs)}]"
            assert r["pattern_description"] == (f"{plus} | {minus}" if ups and downs else plus if ups else f" {minus}" if downs else "")
            assert abs(r["pattern_score"] - (r["pattern_up_score"] + r["pattern_down_score"])) < 1e-9
            if before:
                assert abs(r["pattern_score_change"] - (r["pattern_score"] - before["pattern_score"])) < 1e-9
    assert len(seen) >= 11


def plain_label(r):
    unheld = r.le("long_edge", 0) and r["kama_slow_support"] == 0 and r["kama_slow_break_up"] == 0
    falls = r.lt("ichimoku_distance_change", 0) and r.lt("trend_score", 0) and r.lt("trend_score_change", 0) and unheld
    if r.lt("ichimoku_distance", 0) and falls:
        return -1, "2 down"
    if r.gt("ichimoku_distance", 0) and falls and r["ki_distance"] in ("gg", "gr"):
        return -2, "1.5 down"
    weak = r.ge("trend_day", 0) or r.lt("trend_score", 0) or r.le("trend_score_change", 0) or r.lt("place_score", 0)
    if r.le("ichimoku_distance_change", 0) and r["trend"] == "wave" and weak and unheld:
        return -3, "wave down"
    stalls = r.lt("trend_score_change", 0) or (r.lt("trend_score", 0) and r.lt("place_score", 0))
    if r.le("ichimoku_distance", 0) and r.le("ichimoku_distance_change", 0) and stalls and (r.le("place_score", 0.33) or r["cross"] != "n") and unheld:
        return -4, "stall down"
    if (r.lt("long_edge", 0) or r.lt("kama_slow_resistant", 0) or r.lt("kama_slow_break_down", 0)) and r.le("trigger_score", 0):
        return -5, "long resistance"
    return 0, ""


def test_label(chains):
    seen = set()
    for _, r in pairs(chains):
        assert (r["label_score"], r["label"]) == plain_label(r), (r["symbol"], r["Date"])
        seen.add(r["label"])
    assert len(seen) >= 4


def plain_signal(before, r):
    p, was, pos, doji = r["potential"], before and before["potential"], r["position"], r["cross"] != "n"
    out = ""
    if p == "down_up" and (r.gt("break_score", 0) or r.gt("candle_pattern_score", 0)):
        out = "buy"
    if p == "up_down" and (r.lt("break_score", 0) or r.lt("candle_pattern_score", 0) or (pos == "up" and doji)):
        out = "sell"
    if p == "up_1" and r.gt("trend_score_change", 0):
        out = "buy"
    if p == "down_1" and (pos not in ("up", "mid_up") or r.lt("break_down_score", 0)):
        out = "sell"
    if pos == "up" and (doji or r["long_shadow"] == "d") and (r["flat"] == "d" or r.lt("overdone", 0) or r.lt("resistant_score", 0)):
        out = "sell"
    if out == "" and was == "up_down" and p == "up" and r.gt("place_score", 0.33) and (pos == "up" or r.gt("trigger_score", 0)):
        out = "buy"
    if out == "buy" and pos in ("down", "mid_down") and r["break_up_score"] == 0 and (r.le("candle_pattern_score", 0) or r.le("place_score", 0)):
        out = ""
    if out == "buy" and pos in ("up", "mid_up") and r.lt("place_score", 0):
        out = ""
    if out == "buy" and pos in ("mid", "mid_up", "mid_down") and r.lt("adx_strong_day", 0) and (r.le("break_down_score", 0) or r.lt("resistant_score", 0) or r.lt("place_score", 0)):
        out = ""
    if out == "buy" and pos == "up" and doji and (r.lt("resistant_score", 0) or r.lt("candle_pattern_score", 0) or r.lt("pattern_score", 0)):
        out = ""
    if out == "" and p in ("down_up", "up_1", "up") and r["trend"] == "up" and (r["place"] in ("up", "mid_up", "out") or r.gt("gap", 0)):
        out = "to_buy"
    if out == "" and p in ("up_down", "down_1", "down") and (r["place"] in ("down", "mid_down", "out") or r.lt("gap", 0)):
        out = "to_sell"
    return out


def test_signal(chains):
    seen = set()
    for rows in chains:
        for before, r in zip([None, *rows], rows):
            assert r["signal"] == plain_signal(before, r), (r["symbol"], r["Date"])
            seen.add(r["signal"])
        assert [r["signal_day"] for r in rows] == runs([{"buy": 1, "sell": -1}.get(r["signal"], 0) for r in rows])
    assert seen == {"buy", "sell", "to_buy", "to_sell", ""}


def plain_actions(r):
    d, change, pos, trend, p = (r["ichimoku_distance"], r["ichimoku_distance_change"], r["position"], r["trend"], r["potential"])
    rate = r["ichimoku_rate"]
    ups, downs = ("up", "up_1", "down_up"), ("down", "down_1", "up_down")
    gains = (rate is not None and rate > 0) or (change is not None and change > 0)
    loses = (rate is not None and rate < 0) or (change is not None and change < 0)
    return {
        "hold_up": d is not None and d > 0 and gains and pos == "up" and trend == "up" and r.gt("trend_score", 0),
        "watch_turn_up": r["middle_turn"] == 1 and (r["short_turn"] == 1 or p in ups),
        "trigger_buy": p in ups and trend == "up" and r.gt("trend_score", 0) and r.gt("trigger_score", 0) and not (pos == "up" and r.lt("ichimoku_direction_day", 0)),
        "stay_out": d is not None and d < 0 and loses and pos == "down" and trend == "down" and r.lt("trend_score", 0),
        "watch_turn_down": r["middle_turn"] == -1 and (r["short_turn"] == -1 or p in downs),
        "trigger_sell": p in ("down", "down_1") and r.lt("trend_score", 0) and (r.lt("trigger_score", 0) or r.lt("place_score", 0) or r.lt("pattern_score", 0))
        and not (pos == "up" and r.gt("place_score", 0) and r["break_down_score"] == 0 and r["resistant_score"] == 0),
    }


def test_actions(chains):
    seen = set()
    for _, r in pairs(chains):
        want = {k: int(v) for k, v in plain_actions(r).items()}
        assert {k: r[k] for k in want} == want, (r["symbol"], r["Date"])
        seen |= {k for k, v in want.items() if v}
    assert len(seen) >= 4


def plain_triggers(r):
    total = {k: sum(r[f"{x}_{k}"] for x in LINES) for k in ("support", "resistant", "break_up", "break_down")}
    return total["break_up"] + total["support"] / 2, total["break_down"] + total["resistant"] / 2


def test_trigger_score(chains):
    for rows in chains:
        for r in rows:
            up, down = plain_triggers(r)
            assert (r["trigger_up_score"], r["trigger_down_score"]) == (up, down) and abs(r["trigger_score"] - up - down) < 1e-9
        assert [r["trigger_day"] for r in rows] == runs([(r["trigger_score"] > 0) - (r["trigger_score"] < 0) for r in rows])


def test_pattern_days(chains):
    weights = {"window": 1, "cross": 0, "meteor": 1, "hammer": 1, "belt": 1, "flat": 1, "engulfing": 1, "harami": 1, "piercing": 1, "star": 2, "long_shadow": 1}
    for rows in chains:
        for name in weights:
            last, want = 0, []
            for r in rows:
                way = {"u": 1, "d": -1}.get(r[name], 0)
                last = way if way else last + ((last > 0) - (last < 0))
                want.append(last)
            assert [r[f"{name}_day"] for r in rows] == want, name
        for r in rows:
            up, down = (sum(w for n, w in weights.items() if r[n] == letter and n != "cross") for letter in "ud")
            assert (r["candle_pattern_up_score"], r["candle_pattern_down_score"], r["candle_pattern_score"]) == (up, -down, up - down)
