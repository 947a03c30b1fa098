"""Queries of trends, levels, scores and the whole analysis. The twins say each rule again, from its definition, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.functions import series
from marketloom.operators import finance, indicators, levels, recursive, scores, trends
from marketloom.plans import analysis
from marketloom.plans import registry as R
from marketloom.plans.registry import W, d, lag, on_bars, roll

O, H, L, C, V = '"Open"', '"High"', '"Low"', '"Close"', '"Volume"'
ALL = "(PARTITION BY symbol)"


def s(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "s")


def run_sql(source: str, x: str, out: str, zero: float | None, restart: bool = False) -> str:
    """A recursive CTE <out>_r (symbol, i, out): the signed running sum of x, one row at a time."""
    at_zero = "0.0" if zero is None else f"CASE WHEN r.{out} > 0 THEN r.{out} + {zero} WHEN r.{out} < 0 THEN r.{out} - {zero} ELSE 0.0 END"
    again = "WHEN abs(c.x) = 1 THEN c.x" if restart else ""
    return f"""{out}_x AS (SELECT symbol, i, CAST({x} AS DOUBLE) AS x FROM {source}),
      {out}_r(symbol, i, {out}) AS (SELECT symbol, i, x FROM {out}_x WHERE i = 1 UNION ALL
        SELECT c.symbol, c.i, CASE WHEN c.x IS NULL THEN NULL WHEN c.x = 0 THEN coalesce({at_zero}, 0.0) {again} WHEN sign(c.x) = sign(r.{out}) THEN r.{out} + c.x ELSE c.x END
        FROM {out}_r r JOIN {out}_x c ON c.symbol = r.symbol AND c.i = r.i + 1)"""


def cross_sql(line: str) -> str:
    now, before = f"({C} - {line})", f"lag({C} - {line}) OVER {W}"
    return f"CASE WHEN ({now} <= 0 AND {before} > 0) OR ({now} < 0 AND {before} >= 0) THEN -1 WHEN ({now} >= 0 AND {before} < 0) OR ({now} > 0 AND {before} <= 0) THEN 1 ELSE 0 END"


# --- trends ---
# The expected rate is the mean of the ten rates before.
on_bars("h4_premium_excess", lambda b: panel.change_rate(b).withColumn("expected", F.avg("rate").over(panel.by_symbol().rowsBetween(-10, -1))).withColumns({
    "premium": finance.risk_premium("expected", 0.04), "excess": finance.excess_return("expected", "rate")}), d("premium", "excess"),
        f'''SELECT *, e - 0.04 AS premium, r - e AS excess FROM (SELECT *, avg(r) OVER (PARTITION BY symbol ORDER BY "Date" ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS e
            FROM (SELECT *, {C} / nullif({lag(C)}, 0) - 1 AS r FROM bars))''')

_MID = lambda n: f"(max({H}) OVER {R.R(n)} + min({L}) OVER {R.R(n)}) / 2"
on_bars("b14_line_trend", lambda b: trends.line_trend(indicators.candle_shape(indicators.ichimoku(b)), "ichimoku", "tankan", "kijun"),
        d("tankan_day", "kijun_day", "ichimoku_distance", "ichimoku_distance_change", "ichimoku_rate", "ichimoku_distance_day", "ichimoku_direction_day") | s("ichimoku_place"),
        f'''WITH RECURSIVE l AS (SELECT *, {_MID(9)} AS t, {_MID(26)} AS k, greatest({O}, {C}) AS bt, least({O}, {C}) AS bb FROM bars), m AS (SELECT *, (t - k) / k AS dist FROM l),
            x AS (SELECT *, {cross_sql("t")} AS tx, {cross_sql("k")} AS kx, dist - {lag("dist")} AS ch, t / {lag("t")} - 1 + (k / {lag("k")} - 1) AS rt FROM m),
            y AS (SELECT *, CASE WHEN dist = 0 THEN 0 WHEN dist > 0 THEN 1 ELSE -1 END AS side, CASE WHEN ch > 0 THEN 1 ELSE -1 END AS way FROM x),
            {run_sql("y", "tx", "tankan_day", 1)}, {run_sql("y", "kx", "kijun_day", 1)}, {run_sql("y", "side", "ichimoku_distance_day", 0)}, {run_sql("y", "way", "ichimoku_direction_day", 0)}
            SELECT *, dist AS ichimoku_distance, ch AS ichimoku_distance_change, rt AS ichimoku_rate,
              CASE WHEN bt > greatest(t, k) AND bb < least(t, k) THEN 'out' WHEN bt <= least(t, k) THEN 'down' WHEN bb < least(t, k) THEN 'mid_down' WHEN bt <= greatest(t, k) THEN 'mid' WHEN bb < greatest(t, k) THEN 'mid_up' ELSE 'up' END AS ichimoku_place
            FROM y JOIN tankan_day_r USING (symbol, i) JOIN kijun_day_r USING (symbol, i) JOIN ichimoku_distance_day_r USING (symbol, i) JOIN ichimoku_direction_day_r USING (symbol, i)''')

_VALUE = lambda b: b.withColumns({"_m": series.rolling("Close", 5, full=False), "_n": series.rolling("Volume", 3, full=False)}).withColumn("adx_value", (F.col("Close") / F.col("_m") - 1) * 60).withColumns({
    "adx_strength": F.abs("adx_value") + F.col("Volume") / F.col("_n") * 10, "adx_value_prediction": series.rolling("adx_value", 3, full=False)})
_ADX = f'''a0 AS (SELECT *, ({C} / avg({C}) OVER {R.R(5)} - 1) * 60 AS adx_value, {V} / avg({V}) OVER {R.R(3)} * 10 AS e FROM bars), a1 AS (SELECT *, abs(adx_value) + e AS adx_strength, avg(adx_value) OVER {R.R(3)} AS pred FROM a0),
    a AS (SELECT *, adx_value - {lag("adx_value")} AS dv, adx_strength - {lag("adx_strength")} AS ds, adx_value - pred AS away FROM a1),
    {run_sql("a", "dv", "adx_direction", 0)}, {run_sql("a", "ds", "adx_power", 0)},
    {run_sql("adx_direction_r", "coalesce(sign(adx_direction), 0)", "adx_direction_day", 1)}, {run_sql("adx_power_r", "coalesce(sign(adx_power), 0)", "adx_power_day", 1)},
    {run_sql("a", "CASE WHEN adx_strength >= 25 THEN 1 ELSE -1 END", "adx_strong_day", 1)}, {run_sql("a", "CASE WHEN adx_value BETWEEN -10 AND 10 THEN 1 ELSE 0 END", "adx_wave_day", None)},
    j AS (SELECT * FROM a JOIN adx_direction_r USING (symbol, i) JOIN adx_power_r USING (symbol, i) JOIN adx_direction_day_r USING (symbol, i) JOIN adx_power_day_r USING (symbol, i) JOIN adx_strong_day_r USING (symbol, i) JOIN adx_wave_day_r USING (symbol, i)),
    g AS (SELECT *, last_value(CASE WHEN adx_direction_day IN (1, -1) THEN before_v END IGNORE NULLS) OVER {R.RUN} AS adx_direction_start, last_value(CASE WHEN adx_power_day IN (1, -1) THEN before_s END IGNORE NULLS) OVER {R.RUN} AS adx_power_start,
          last_value(CASE WHEN adx_power_day IN (1, -1) THEN adx_value END IGNORE NULLS) OVER {R.RUN} AS power_value, CASE WHEN away > 0 THEN 1 ELSE -1 END * (abs(away) - min(abs(away)) OVER {ALL}) / (max(abs(away)) OVER {ALL} - min(abs(away)) OVER {ALL}) AS adx_distance
          FROM (SELECT *, {lag("adx_value")} AS before_v, {lag("adx_strength")} AS before_s FROM j)),
    t AS (SELECT *, CASE WHEN adx_value > -10 AND adx_value < 10 AND abs(adx_power_day) > abs(adx_direction_day) AND adx_direction_day = 1 AND adx_power_day < 0 AND adx_power_start > 10 AND power_value > 10 THEN 0
          WHEN adx_value > -10 AND adx_value < 10 AND abs(adx_power_day) > abs(adx_direction_day) AND adx_direction_day = -1 AND adx_power_day > 0 AND adx_power_start < -10 AND power_value < -10 THEN 0
          WHEN adx_value >= 0 AND dv < 0 AND ((adx_value <= 10 AND dv < -0.5) OR (adx_value > 10 AND ds < 0)) THEN -1 WHEN adx_value >= 0 AND dv > 0 AND ((adx_value <= 10 AND ds < 0 AND adx_direction_start < -5) OR (adx_value > 10 AND ds > 0)) THEN 1
          WHEN adx_value < 0 AND dv < 0 THEN -1 WHEN adx_value < 0 AND dv > 0 AND ds < 0 THEN 1 ELSE 0 END AS adx_trend FROM g), {run_sql("t", "adx_trend", "adx_day", None)}'''
on_bars("b15_adx_trend", lambda b: trends.adx_trend(_VALUE(b)), d("adx_direction", "adx_power", "adx_direction_day", "adx_power_day", "adx_direction_start", "adx_power_start", "adx_strong_day", "adx_wave_day", "adx_distance", "adx_trend", "adx_day"),
        f"WITH RECURSIVE {_ADX} SELECT * FROM t JOIN adx_day_r USING (symbol, i)")

_K = f"100 * ({C} - min({L}) OVER {R.R(14)}) / nullif(max({H}) OVER {R.R(14)} - min({L}) OVER {R.R(14)}, 0)"
on_bars("b16_simple_trends", lambda b: trends.simple_trends(indicators.ao(indicators.bollinger(indicators.stoch(b))), ["stoch", "bb", "ao"]), s("stoch_trend", "bb_trend", "ao_trend"),
        f'''SELECT *, CASE WHEN sk - sd < -1 OR sk < 20 THEN 'd' WHEN sk - sd > 1 OR sk > 80 THEN 'u' ELSE 'n' END AS stoch_trend, CASE WHEN {C} > bm + 2 * bs THEN 'd' WHEN {C} < bm - 2 * bs THEN 'u' ELSE '' END AS bb_trend,
            CASE WHEN w < {lag("w")} THEN 'd' WHEN w > {lag("w")} THEN 'u' ELSE 'n' END AS ao_trend
            FROM (SELECT *, avg(sk) OVER {R.R(3)} AS sd, avg(m) OVER {R.R(5)} - avg(m) OVER {R.R(34)} AS w FROM (SELECT *, {_K} AS sk, ({H} + {L}) / 2 AS m, {roll("avg", C, 20)} AS bm, {roll("stddev_pop", C, 20)} AS bs FROM bars))''')
on_bars("b39_indicator_set", lambda b: analysis.indicator_set(b, {"trend": ["stoch", "ao"], "other": ["ao", "bollinger", "kama"]}), d("stoch_k", "ao", "mavg", "kama"),
        f'''WITH RECURSIVE x0 AS (SELECT *, {_K} AS stoch_k, avg(m) OVER {R.R(5)} - avg(m) OVER {R.R(34)} AS ao, {roll("avg", C, 20)} AS mavg, abs({C} - {lag(C, 10)}) / nullif({roll("sum", "st", 10)}, 0) AS e FROM (SELECT *, ({H} + {L}) / 2 AS m, abs({C} - {lag(C)}) AS st FROM bars)),
            x AS (SELECT *, last_value(e IGNORE NULLS) OVER {R.RUN} AS er FROM x0),
            rec(symbol, i, kama) AS (SELECT symbol, i, {C} FROM x WHERE i = 10 UNION ALL SELECT x.symbol, x.i, rec.kama + pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (x.{C} - rec.kama) FROM rec JOIN x ON x.symbol = rec.symbol AND x.i = rec.i + 1)
            SELECT * FROM x LEFT JOIN rec USING (symbol, i)''')

# --- levels: moving averages in the place of the lines ---
_AS_LINES = {"kama_slow": 18, "kijun": 9, "gap_top": 6, "m3": 3}
_NAMES = list(_AS_LINES)


def _leveled(b: DataFrame) -> DataFrame:
    b = indicators.candle_shape(b.withColumns({x: series.rolling("Close", n) for x, n in _AS_LINES.items()}))
    b = b.withColumns({"cross": F.when(F.col("body_pct") < 0.15, "d").otherwise("n"), "gap": F.when(F.col("Low") > panel.lag("High"), 2).when(F.col("High") < panel.lag("Low"), -2).otherwise(0)})
    return levels.nearest_levels(levels.level_scores(levels.support_resistance(levels.break_levels(b, _NAMES), _NAMES), _NAMES), _NAMES)


def _line_sql(x: str) -> str:
    weight = {"kama_slow": 1.0, "kijun": 1.0, "gap_top": 0.0, "m3": 0.5}[x]
    up, down = ("AND gap <> 2", "AND gap <> -2") if x == "gap_top" else ("", "")
    b = f"CASE WHEN ({x}_day = 1 OR (k = 1 AND bt > {x} AND bb < {x})) AND (doji = 'n' OR bb > {x}) {up} THEN {weight} ELSE 0.0 END AS {x}_bu, CASE WHEN ({x}_day = -1 OR (k = -1 AND bt > {x} AND bb < {x})) AND (doji = 'n' OR bt < {x}) {down} THEN -{weight} ELSE 0.0 END AS {x}_bd"
    return b


def _holding_sql(x: str) -> str:
    base = "abs({e} - {x}) / nullif(kama_slow, 0)"
    lo, hi = base.format(e=L, x=x), base.format(e=H, x=x)
    return f"""CASE WHEN (bb > {x} AND {x}_bu = 0 AND (((k = 1 AND ({H} + {L}) / 2 > {x}) OR (k = -1 AND {C} > {x})) AND (ls > 0.2 OR ls > us) AND (doji = 'n' OR {L} > {x}) AND {lo} < 0.02 OR (k = 1 AND {x}_day <> 1 AND {lo} < 0.01)))
        OR (bb >= {x} AND {x}_bu = 0 AND (({O} > {x} AND {L} <= {x} AND {C} >= {x}) OR ({x}_day <> 1 AND {O} < {x} AND {C} > {x}))) THEN 1.0 ELSE 0.0 END AS {x}_s,
      CASE WHEN (bt < {x} AND {x}_bd = 0 AND (((k = -1 AND ({H} + {L}) / 2 < {x}) OR (k = 1 AND {C} < {x})) AND (us > 0.2 OR us > ls) AND {hi} < 0.02 OR (doji <> 'n' AND {H} > {x} AND {x} > {L}) OR (k = -1 AND {x}_day <> -1 AND {hi} < 0.01)))
        OR (bt <= {x} AND {x}_bd = 0 AND (({O} < {x} AND {H} >= {x} AND {C} <= {x}) OR ({x}_day <> -1 AND {O} > {x} AND {C} < {x}))) THEN -1.0 ELSE 0.0 END AS {x}_r"""


def _listed(suffix: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x}_{suffix} <> 0 THEN '{x}' END" for x in sorted(_NAMES)) + "], lambda v: v IS NOT NULL), ', ')"


def _best(suffix: str, order: str) -> str:
    return f"(SELECT {{f}} FROM (VALUES " + ", ".join(f"({x}, '{x}', {x}_{suffix})" for x in _NAMES) + f") AS c(height, line, held) WHERE held <> 0 ORDER BY height {order}, line {order} LIMIT 1)"


_LEVELS = f'''p0 AS (SELECT *, {", ".join(f'round({roll("avg", C, n)}, 3) AS {x}' for x, n in _AS_LINES.items())}, greatest({O}, {C}) AS bt, least({O}, {C}) AS bb, CAST(sign({C} - {O}) AS INTEGER) AS k,
      CASE WHEN {L} > {lag(H)} THEN 2 WHEN {H} < {lag(L)} THEN -2 ELSE 0 END AS gap, abs({C} - {O}) / nullif({H} - {L}, 0) AS pct FROM bars),
    p AS (SELECT *, ({H} - bt) / nullif({H} - {L}, 0) AS us, (bb - {L}) / nullif({H} - {L}, 0) AS ls, CASE WHEN pct < 0.15 THEN 'd' ELSE 'n' END AS doji, {", ".join(f"{cross_sql(x)} AS {x}_c" for x in _NAMES)} FROM p0),
    {", ".join(run_sql("p", f"{x}_c", f"{x}_day", 1) for x in _NAMES)},
    q AS (SELECT * FROM p {" ".join(f"JOIN {x}_day_r USING (symbol, i)" for x in _NAMES)}), u AS (SELECT *, {", ".join(map(_line_sql, _NAMES))} FROM q), v AS (SELECT *, {", ".join(map(_holding_sql, _NAMES))} FROM u),
    lv AS (SELECT *, {" + ".join(f"{x}_s" for x in _NAMES)} AS support_score, {" + ".join(f"{x}_r" for x in _NAMES)} AS resistant_score, {" + ".join(f"{x}_bu" for x in _NAMES)} AS break_up_score, {" + ".join(f"{x}_bd" for x in _NAMES)} AS break_down_score,
      {_listed("s")} AS support_description, {_listed("r")} AS resistant_description, {_listed("bu")} AS break_up_description, {_listed("bd")} AS break_down_description FROM v)'''
_SCORES = ("support_score", "resistant_score", "break_up_score", "break_down_score")
on_bars("d9_levels", _leveled, d(*_SCORES, "boundary_score", "break_score") | s(*(x.replace("score", "description") for x in _SCORES)),
        f"WITH RECURSIVE {_LEVELS} SELECT *, support_score + resistant_score AS boundary_score, break_up_score + break_down_score AS break_score FROM lv")
on_bars("d10_nearest_levels", lambda b: panel.latest_per_symbol(_leveled(b)), d("support", "resistant") | s("supporter", "resistanter"),
        f'''WITH RECURSIVE {_LEVELS} SELECT *, {_best("s", "DESC").format(f="height")} AS support, coalesce({_best("s", "DESC").format(f="line")}, '') AS supporter, {_best("r", "ASC").format(f="height")} AS resistant, coalesce({_best("r", "ASC").format(f="line")}, '') AS resistanter FROM lv WHERE i = n_rows''', symbol="p_brand")
on_bars("g1_trigger_score", lambda b: scores.trigger_score(_leveled(b)), d("trigger_score", "trigger_day", "trigger_score_symbol") | s("trigger_up_description", "trigger_down_description"),
        f'''WITH RECURSIVE {_LEVELS}, tr AS (SELECT *, break_up_score + break_down_score + (support_score + resistant_score) / 2 AS trigger_score FROM lv), {run_sql("tr", "sign(trigger_score)", "trigger_day", 1)}
            SELECT *, sign(trigger_score) AS trigger_score_symbol, concat_ws(', ', CASE WHEN support_score <> 0 THEN '+support(' || support_score::DOUBLE || ')' END, CASE WHEN break_up_score <> 0 THEN '+break_up(' || break_up_score::DOUBLE || ')' END) AS trigger_up_description,
              concat_ws(', ', CASE WHEN resistant_score <> 0 THEN '-resistant(' || resistant_score::DOUBLE || ')' END, CASE WHEN break_down_score <> 0 THEN '-break_down(' || break_down_score::DOUBLE || ')' END) AS trigger_down_description FROM tr JOIN trigger_day_r USING (symbol, i)''')

# --- scores: each input takes its values in turn, each with a length of its own, so that the rules meet in many ways ---
_I = "(i + 1000 * length(symbol))"


def turn(step: int, *values) -> str:
    """SQL for Spark and the twin alike: the values in turn."""
    return f"CASE {_I} * {step} % {len(values)} " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in enumerate(values)) + " END"


def spread(step: int, size: int, offset: float, scale: float = 1.0) -> str:
    return f"(CAST({_I} * {step} % {size} AS DOUBLE) - {offset}) * {scale}"


def fed(inputs: dict[str, str]):
    def build(b: DataFrame) -> DataFrame:
        numbered = b.withColumn("i", F.row_number().over(panel.by_symbol()))
        return numbered.withColumns({c: F.expr(x) for c, x in inputs.items()})

    return build


def fed_sql(inputs: dict[str, str]) -> str:
    return "f AS (SELECT *, " + ", ".join(f'{x} AS "{c}"' for c, x in inputs.items()) + " FROM bars)"


_PLACES = ("up", "mid_up", "mid", "out", "mid_down", "down", "")
_STATE = {"adx_value": spread(7, 61, 30), "adx_strength": spread(5, 47, 0), "adx_value_change": spread(11, 23, 11, 0.5), "adx_strength_change": spread(3, 19, 9, 0.5), "adx_trend": turn(1, *([1.0] * 5 + [0.0] * 3 + [-1.0] * 4 + [0.0] * 2)),
          "adx_direction_day": spread(1, 17, 8), "adx_power_day": spread(1, 13, 6), "adx_direction_start": spread(9, 53, 26), "trigger_score": spread(1, 5, 2)}
_DAYS = f'''ts AS (SELECT *, round_even(adx_value_change + adx_strength_change * CASE WHEN adx_value > 0 THEN 1 ELSE -1 END, 2) AS trend_score FROM f), tc AS (SELECT *, round_even(trend_score - {lag("trend_score")}, 2) AS trend_score_change FROM ts),
    {run_sql("tc", "CASE WHEN trend_score_change > 0 THEN 1 ELSE -1 END", "s_direction_day", 0)}, {run_sql("tc", "adx_trend", "trend_day", 1)},
    st AS (SELECT *, CASE adx_trend WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'wave' END AS trend FROM tc JOIN s_direction_day_r USING (symbol, i) JOIN trend_day_r USING (symbol, i)),
    po AS (SELECT *, CASE WHEN trend_day < -1 AND trend <> 'wave' THEN 'down' WHEN trend_day > 1 AND trend <> 'wave' THEN 'up' WHEN trend_day = -1 THEN 'down_1' WHEN trend_day = 1 THEN 'up_1' WHEN trend_day > 0 THEN 'up_down' WHEN trend_day < 0 THEN 'down_up' ELSE '' END AS p0 FROM st),
    pt AS (SELECT *, CASE WHEN p0 = 'down_up' AND abs(adx_power_day) >= abs(adx_direction_day) AND (adx_power_day < 0 OR adx_power_day > 0) AND trigger_score <= 0 THEN 'down'
      WHEN p0 = 'up_down' AND abs(adx_direction_day) >= abs(adx_power_day) AND adx_direction_start < -10 AND trigger_score >= 0 THEN 'up' WHEN p0 = 'up_down' AND abs(adx_power_day) >= abs(adx_direction_day) AND adx_value > 10 AND adx_strength > 25 AND trigger_score >= 0 THEN 'up' ELSE p0 END AS potential FROM po)'''
on_bars("g3_potential", lambda b: scores.potential(scores.trend_state(fed(_STATE)(b))), d("trend_score", "trend_score_change", "s_direction_day", "trend_day") | s("trend", "potential", "potential_score"),
        f"WITH RECURSIVE {fed_sql(_STATE)}, {_DAYS} SELECT *, CASE potential WHEN 'down_up' THEN 3 WHEN 'up_1' THEN 2 WHEN 'up' THEN 1 WHEN 'down' THEN -1 WHEN 'down_1' THEN -2 WHEN 'up_down' THEN -3 ELSE 0 END AS potential_score FROM pt")

_LETTER = {"window": turn(1, *"nnunndnnnnn"), "cross": turn(1, *"nunnnnd"), "star": turn(1, *"nnnnunnnnnnnd")}
on_bars("d7_pattern_days", lambda b: levels.pattern_days(fed(_LETTER)(b), {"window": 1, "cross": 0, "star": 2}), d("window_day", "cross_day", "star_day", "candle_pattern_score") | s("candle_pattern_up_description", "candle_pattern_down_description"),
        f'''WITH RECURSIVE {fed_sql(_LETTER)}, {", ".join(run_sql("f", f"CASE {c} WHEN 'u' THEN 1 WHEN 'd' THEN -1 ELSE 0 END".replace(c, f'"{c}"', 1), f"{c}_day", 1, True) for c in _LETTER)}
            SELECT *, CASE window_day WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END + CASE star_day WHEN 1 THEN 2 WHEN -1 THEN -2 ELSE 0 END AS candle_pattern_score,
              concat_ws(', ', CASE WHEN window_day = 1 THEN 'window' END, CASE WHEN star_day = 1 THEN 'star' END) AS candle_pattern_up_description,
              concat_ws(', ', CASE WHEN window_day = -1 THEN 'window' END, CASE WHEN cross_day IN (1, -1) THEN 'cross' END, CASE WHEN star_day = -1 THEN 'star' END) AS candle_pattern_down_description
            FROM f JOIN window_day_r USING (symbol, i) JOIN cross_day_r USING (symbol, i) JOIN star_day_r USING (symbol, i)''')

_POTENTIALS = ("up", "up_down", "down", "down_1", "up_1", "down_up", "")
_DEED = {"potential": turn(3, *_POTENTIALS), "trend": turn(1, "up", "down", "wave"), "position": turn(1, *_PLACES[:3], *_PLACES[4:], "up", "down"), "cross": turn(1, "n", "n", "u", "n", "n"), "long_shadow": turn(1, "n", "d", "u"), "flat": turn(1, "n", "d"), "place": turn(5, *_PLACES),
         "overdone": turn(1, 0.0, 0.0, -0.25), "gap": turn(1, 0.0, 1.0, 0.0, -1.0), "resistant_score": turn(1, 0.0, -1.0, 0.0), "break_up_score": turn(7, 0.0, 1.0, 0.0, 0.0, 0.0), "break_down_score": turn(5, 0.0, 0.0, -1.0, 0.0), "break_score": turn(1, 0.0, 1.0, -1.0),
         "candle_pattern_score": spread(1, 3, 1), "pattern_score": spread(1, 5, 2), "place_score": turn(1, -0.66, -0.33, 0.0, 0.33, 0.66, 0.99, 0.0), "trigger_score": spread(2, 5, 2), "trend_score": spread(1, 9, 4), "trend_score_change": spread(1, 7, 3), "trend_day": spread(1, 19, 9), "adx_strong_day": turn(1, 1.0, -1.0, 2.0),
         "ichimoku_distance": spread(1, 11, 5), "ichimoku_distance_change": spread(1, 13, 6), "ichimoku_rate": spread(1, 3, 1), "ichimoku_direction_day": turn(1, 1.0, -1.0), "middle_turn": turn(1, 0.0, 1.0, -1.0, 0.0), "short_turn": turn(1, -1.0, 0.0, 1.0), "long_edge": turn(1, 0.0, 0.0, -1.0, 1.0, 0.0),
         "kama_slow_support": turn(1, 0.0, 0.0, 0.0, 1.0), "kama_slow_break_up": turn(1, 0.0, 0.0, 0.0, 0.0, 1.0), "kama_slow_break_down": turn(1, 0.0, 0.0, -1.0), "kama_slow_resistant": turn(2, 0.0, 0.0, 0.0, -1.0, 0.0), "ki_distance": turn(1, "gg", "gr", "rg", "rr", "n")}
_FREE = "long_edge <= 0 AND kama_slow_support = 0 AND kama_slow_break_up = 0"
on_bars("g5_label", lambda b: scores.label(fed(_DEED)(b)), s("label_score", "label"),
        f'''SELECT *, ['2 down', '1.5 down', 'wave down', 'stall down', 'long resistance', ''][CASE label_score WHEN 0 THEN 6 ELSE -label_score END] AS label FROM (
              SELECT *, CASE WHEN trend_score < 0 AND trend_score_change < 0 AND ichimoku_distance_change < 0 AND ichimoku_distance < 0 AND {_FREE} THEN -1 WHEN trend_score < 0 AND trend_score_change < 0 AND ichimoku_distance_change < 0 AND ichimoku_distance > 0 AND ki_distance IN ('gg', 'gr') AND {_FREE} THEN -2
                WHEN trend = 'wave' AND ichimoku_distance_change <= 0 AND (place_score < 0 OR trend_score < 0 OR trend_day >= 0 OR trend_score_change <= 0) AND {_FREE} THEN -3
                WHEN ichimoku_distance <= 0 AND ichimoku_distance_change <= 0 AND (("cross" <> 'n') OR place_score <= 0.33) AND (trend_score_change < 0 OR (place_score < 0 AND trend_score < 0)) AND {_FREE} THEN -4
                WHEN trigger_score <= 0 AND (long_edge < 0 OR kama_slow_resistant < 0 OR kama_slow_break_down < 0) THEN -5 ELSE 0 END AS label_score FROM (WITH {fed_sql(_DEED)} SELECT * FROM f))''')
_STEPS = [("back to the rise", "g = '' AND before = 'up_down' AND potential = 'up' AND place_score > 0.33 AND (trigger_score > 0 OR position = 'up')", "buy"), ("low, not confirmed", "g = 'buy' AND (position = 'down' OR position = 'mid_down') AND break_up_score = 0 AND (place_score <= 0 OR candle_pattern_score <= 0)", ""),
          ("high, beware", "g = 'buy' AND (position = 'up' OR position = 'mid_up') AND place_score < 0", ""), ("waves in the middle", "g = 'buy' AND position LIKE 'mid%' AND adx_strong_day < 0 AND (resistant_score < 0 OR place_score < 0 OR break_down_score <= 0)", ""),
          ("doji high up", "g = 'buy' AND position = 'up' AND \"cross\" <> 'n' AND least(resistant_score, candle_pattern_score, pattern_score) < 0", ""), ("rising", "g = '' AND trend = 'up' AND (potential = 'down_up' OR potential LIKE 'up%' AND potential <> 'up_down') AND (gap > 0 OR place IN ('out', 'up', 'mid_up'))", "to_buy"),
          ("falling", "g = '' AND (potential = 'up_down' OR potential LIKE 'down%' AND potential <> 'down_up') AND (gap < 0 OR place IN ('out', 'down', 'mid_down'))", "to_sell")]
_BASE = [("fall turns up", "potential = 'down_up' AND greatest(break_score, candle_pattern_score) > 0", "buy"), ("rise turns down", "potential = 'up_down' AND (least(break_score, candle_pattern_score) < 0 OR (\"cross\" <> 'n' AND position = 'up'))", "sell"), ("rise starts", "potential = 'up_1' AND trend_score_change > 0", "buy"),
         ("fall starts", "potential = 'down_1' AND (break_down_score < 0 OR (position <> 'up' AND position <> 'mid_up'))", "sell"), ("top", "position = 'up' AND (long_shadow = 'd' OR \"cross\" <> 'n') AND (resistant_score < 0 OR overdone < 0 OR flat = 'd')", "sell")]
_FOLD = "f0 AS (SELECT *, " + lag("potential") + " AS before FROM f), s0 AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN '{v}'" for _, c, v in reversed(_BASE)) + " ELSE '' END AS g, concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _BASE) + ") AS said FROM f0)"
for _k, (_n, _w, _v) in enumerate(_STEPS, 1):
    _FOLD += f", s{_k} AS (SELECT * REPLACE (CASE WHEN {_w} THEN '{_v}' ELSE g END AS g, CASE WHEN {_w} THEN said || CASE WHEN said = '' THEN '' ELSE ', ' END || '{_n}' ELSE said END AS said) FROM s{_k - 1})"
on_bars("g6_signal", lambda b: scores.signal(fed(_DEED)(b)), s("signal", "signal_description") | d("signal_day"),
        f'''WITH RECURSIVE {fed_sql(_DEED)}, {_FOLD}, {run_sql(f"s{len(_STEPS)}", "CASE g WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END", "signal_day", 1)} SELECT *, g AS signal, said AS signal_description FROM s{len(_STEPS)} JOIN signal_day_r USING (symbol, i)''')
_RISES, _FALLS = "potential IN ('down_up', 'up_1', 'up')", "potential IN ('up_down', 'down_1', 'down')"
on_bars("g7_actions", lambda b: scores.actions(fed(_DEED)(b)), s(*scores.ACTIONS),
        f'''WITH {fed_sql(_DEED)} SELECT *, (trend = 'up' AND position = 'up' AND trend_score > 0 AND ichimoku_distance > 0 AND greatest(ichimoku_rate, ichimoku_distance_change) > 0)::INTEGER AS hold_up,
              (trend = 'down' AND position = 'down' AND trend_score < 0 AND ichimoku_distance < 0 AND least(ichimoku_rate, ichimoku_distance_change) < 0)::INTEGER AS stay_out,
              (middle_turn = 1 AND ({_RISES} OR short_turn = 1))::INTEGER AS watch_turn_up, (middle_turn = -1 AND ({_FALLS} OR short_turn = -1))::INTEGER AS watch_turn_down,
              CASE WHEN position = 'up' AND ichimoku_direction_day < 0 THEN 0 ELSE ({_RISES} AND trend = 'up' AND least(trend_score, trigger_score) > 0)::INTEGER END AS trigger_buy,
              CASE WHEN position = 'up' AND place_score > 0 AND break_down_score = 0 AND resistant_score = 0 THEN 0 ELSE ({_FALLS} AND potential <> 'up_down' AND trend_score < 0 AND least(trigger_score, place_score, pattern_score) < 0)::INTEGER END AS trigger_sell FROM f''')

# --- the whole analysis ---
on_bars("g8_feature_pipeline", lambda b: analysis.feature_pipeline(b, "1997-01-01"), d("trend_score", "trigger_score", "pattern_score", "signal_day") | s("trend", "potential", "label", "signal", "pattern_description", *scores.ACTIONS), sql=False)
on_bars("g16_as_of_replay", lambda b: analysis.as_of_replay(b, "1998-03-02", "1998-03-06", 120), {"as_of": "s"} | s("trend", "potential", "signal"), sql=False)

_FIT = "f.\"Date\" BETWEEN s AND e"
on_bars("d12_trend_channel", trends.trend_channel, d("linear_fit_high", "linear_fit_low"),
        f'''WITH t AS (SELECT *, n_rows - i + 1 AS back FROM bars), c AS (SELECT symbol, max("Date") FILTER (WHERE back = 3) AS d3, max("Date") FILTER (WHERE back = 7) AS d7, min("Date") FILTER (WHERE back <= 60) AS d60,
              [first("Date" ORDER BY "High" DESC, "Date") FILTER (WHERE back BETWEEN 3 AND 32), first("Date" ORDER BY "Low", "Date") FILTER (WHERE back BETWEEN 3 AND 32),
               first("Date" ORDER BY "High" DESC, "Date") FILTER (WHERE back BETWEEN 3 AND 62), first("Date" ORDER BY "High", "Date") FILTER (WHERE back BETWEEN 3 AND 62)] AS four FROM t GROUP BY symbol),
            u AS (SELECT symbol, d3, d7, d60, unnest(four) AS x FROM c), v AS (SELECT symbol, coalesce(max(x) FILTER (WHERE x > d7), max(d3)) AS e FROM u GROUP BY symbol),
            w AS (SELECT symbol, max(e) AS e, max(d3) AS d3, coalesce(max(x) FILTER (WHERE x < d7 AND x < e - INTERVAL 5 DAY), max(d60)) AS s FROM u JOIN v USING (symbol) GROUP BY symbol),
            g AS (SELECT f.symbol, min(f.i - 1) FILTER (WHERE {_FIT}) AS x0, count(*) FILTER (WHERE {_FIT}) AS n, {", ".join(f"""regr_slope("{c}", f.i - 1) FILTER (WHERE {_FIT}) AS {k}s, regr_intercept("{c}", f.i - 1) FILTER (WHERE {_FIT}) AS {k}i,
                round((max("{c}") FILTER (WHERE {_FIT}) + min("{c}") FILTER (WHERE {_FIT})) / 2, 3) AS {k}m, stddev_samp("{c}") FILTER (WHERE {_FIT}) AS {k}d, {m}("{c}") FILTER (WHERE f."Date" BETWEEN s AND d3) AS {k}e""" for c, k, m in (("High", "h", "max"), ("Low", "l", "min")))}
              FROM t f JOIN w USING (symbol) GROUP BY f.symbol)
            SELECT symbol, "Date", {", ".join(f"CASE WHEN i >= x0 THEN CASE WHEN n < 2 OR round(abs({k}s) / {k}m, 5) < 0.001 THEN {k}e ELSE {k}s * i + {k}i END {way} 0.3 * {k}d END AS linear_fit_{c}" for c, k, way in (("high", "h", "+"), ("low", "l", "-")))} FROM bars JOIN g USING (symbol)''')


def _renko_sql(sizes: str) -> str:
    """Bricks one row at a time from sizes (all of bars with bsz), then held and placed."""
    held = lambda c: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i) AS {c}"
    return f'''WITH RECURSIVE {sizes}, z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS j FROM sized WHERE bsz > 0),
      b(symbol, i, j, side, level, size, prev, o, n) AS (SELECT symbol, i, j, 1::BIGINT, floor({C} / bsz) * bsz, bsz, bsz, floor({C} / bsz) * bsz - bsz, 1::BIGINT FROM z WHERE j = 1 UNION ALL
        SELECT symbol, i, j, CASE WHEN k <= -2 THEN -side ELSE side END, CASE WHEN k >= 1 THEN level + side * k * size WHEN k <= -2 THEN level - side * prev + side * (k + 1) * size ELSE level END,
          CASE WHEN k BETWEEN -1 AND 0 THEN size ELSE bsz END, CASE WHEN k BETWEEN -1 AND 0 THEN prev ELSE size END, CASE WHEN k >= 1 THEN level WHEN k <= -2 THEN level - side * prev END, CASE WHEN k >= 1 THEN k WHEN k <= -2 THEN -k - 1 END
        FROM (SELECT z.symbol, z.i, z.j, z.bsz, b.side, b.level, b.size, b.prev, b.side * CAST(trunc((z.{C} - b.level) / b.size) AS BIGINT) AS k FROM b JOIN z ON z.symbol = b.symbol AND z.j = b.j + 1)),
      y AS (SELECT a.symbol, a."Date", a.i, greatest(a.{O}, a.{C}) AS bt, least(a.{O}, a.{C}) AS bb, b.o AS renko_o, CASE WHEN b.n > 0 THEN b.level END AS renko_c, CASE WHEN b.n > 0 THEN CASE WHEN b.side > 0 THEN 'green' ELSE 'red' END END AS renko_color,
              abs(b.level - b.o) * b.side AS renko_distance, b.n AS renko_brick_number, CASE WHEN b.n > 0 THEN a."Date" END AS st, b.n > 0 AS own, max(a."Date") OVER (PARTITION BY a.symbol) AS newest FROM bars a LEFT JOIN b USING (symbol, i)),
      e AS (SELECT *, CASE WHEN own THEN coalesce(min(st) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), newest) END AS en, last_value(CASE WHEN own THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i) AS brick FROM y),
      h AS (SELECT symbol, "Date", i, bt, bb, own, brick, {", ".join(held(c) for c in ("renko_o", "renko_c", "renko_color", "renko_distance", "renko_brick_number", "st", "en"))} FROM e)
      SELECT *, CAST(st AS VARCHAR) AS renko_start, CAST(en AS VARCHAR) AS renko_end, (i - brick) * CASE WHEN renko_color = 'green' THEN 1 ELSE -1 END AS renko_day,
        CASE WHEN bt <= least(renko_o, renko_c) OR (own AND renko_color = 'red') THEN 'down' WHEN own THEN 'up' WHEN bb < least(renko_o, renko_c) AND bt <= greatest(renko_o, renko_c) THEN 'mid_down' WHEN bb < least(renko_o, renko_c) THEN 'out'
          WHEN bt <= greatest(renko_o, renko_c) THEN 'mid' WHEN bb < greatest(renko_o, renko_c) THEN 'mid_up' WHEN bb >= greatest(renko_o, renko_c) THEN 'up' ELSE '' END AS renko_position FROM h'''


_RENKO = d("renko_o", "renko_c", "renko_distance", "renko_brick_number", "renko_day") | s("renko_color", "renko_start", "renko_end", "renko_position")
for _name, _block, _sizes in (
        ("b13_renko", "renko", f'''q AS (SELECT *, avg(tr) OVER {R.R(14)} AS w FROM (SELECT *, greatest({H} - {L}, abs({H} - {lag(C)}), abs({L} - {lag(C)})) AS tr FROM bars)),
            rec(symbol, i, r) AS (SELECT symbol, i, w FROM q WHERE i <= 14 UNION ALL SELECT q.symbol, q.i, (rec.r * 13 + q.tr) / 14 FROM rec JOIN q ON q.symbol = rec.symbol AND q.i = rec.i + 1 WHERE rec.i >= 14), sized AS (SELECT *, round_even(r, 3) AS bsz FROM q JOIN rec USING (symbol, i))'''),
        ("b13_renko_fixed", "renko_fixed", f"sized AS (SELECT *, round_even(first_value({C}) OVER (PARTITION BY symbol ORDER BY i) * 0.077::DOUBLE, 3) AS bsz FROM bars)")):
    on_bars(_name, lambda b, block=_block: trends.renko_place(indicators.candle_shape(recursive.recursive_block(b, [block]))), _RENKO, _renko_sql(_sizes))
