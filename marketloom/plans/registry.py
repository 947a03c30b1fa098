"""The library's queries on the driver tables, each with an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.functions import series
from marketloom.operators import finance, indicators, ranking, recursive, scans, trading

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_BODY: dict[str, str] = {}

#: Bars of FIXTURES B as SQL: symbol, Date, Open, High, Low, Close, Volume.
_BARS = """
t AS (SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS "Date", l_extendedprice / l_quantity AS price, l_quantity AS q, l_orderkey, l_linenumber, l_partkey, l_suppkey
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol, "Date" ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS a,
      row_number() OVER (PARTITION BY symbol, "Date" ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, price DESC) AS z FROM t),
bars AS (SELECT symbol, "Date", max(CASE WHEN a = 1 THEN price END) AS "Open", max(price) AS "High", min(price) AS "Low", max(CASE WHEN z = 1 THEN price END) AS "Close", sum(q) AS "Volume",
         row_number() OVER (PARTITION BY symbol ORDER BY "Date") AS i, count(*) OVER (PARTITION BY symbol) AS n_rows FROM o GROUP BY symbol, "Date")
"""
W = '(PARTITION BY symbol ORDER BY "Date")'
ALL = "(PARTITION BY symbol)"
RUN = '(PARTITION BY symbol ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'


def R(n: int) -> str:
    return f'(PARTITION BY symbol ORDER BY "Date" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'


def roll(agg: str, x: str, n: int, full: bool = True) -> str:
    return f"CASE WHEN count({x}) OVER {R(n)} >= {n} THEN {agg}({x}) OVER {R(n)} END" if full else f"{agg}({x}) OVER {R(n)}"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def ema_sql(source: str, x: str, alpha: float, least: int, out: str) -> str:
    """A CTE with column `out`: adjusted exponential means as plain weighted sums; weights below 1e-18 are left out."""
    import math

    reach = math.ceil(42 / -math.log1p(-alpha))
    return f"""{out}_e AS (SELECT a.symbol, a.i, CASE WHEN (SELECT count(b0.{x}) FROM {source} b0 WHERE b0.symbol = a.symbol AND b0.i <= a.i) >= {least}
      THEN sum(b.{x} * pow({1 - alpha!r}, a.i - b.i)) / nullif(sum(CASE WHEN b.{x} IS NOT NULL THEN pow({1 - alpha!r}, a.i - b.i) END), 0) END AS {out}
      FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {reach} AND a.i GROUP BY a.symbol, a.i)"""


def _shift(digits: int) -> float:
    """Prices are cents over small quantities, so many lie exactly between two rounded values, where engines differ. A shift of a
    part of the last digit, the same in both, moves them off the edge."""
    return round(0.12371 * 10**-digits, digits + 5)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Dates as text, doubles rounded, no negative zero: what both engines print alike."""
    def shown(name: str, kind: str):
        if kind in ("date", "timestamp"):
            return F.col(name).cast("date").cast("string").alias(name)
        return (F.round(F.col(name) + F.lit(_shift(digits)), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


def _register(name: str, build: Query, sql: str | None) -> None:
    _QUERIES[name] = build
    if sql:
        _SQL[name] = sql


def on_bars(name: str, f: Callable[[DataFrame], DataFrame], columns: dict[str, str], body: str = "SELECT * FROM bars", keys: str = "symbol, Date", symbol: str = "p_type", sql: bool = True, digits: int = 4) -> None:
    """A query of f over daily bars. columns: name -> kind (d double, s other); body: SQL over bars that yields them."""
    key_cols = [k for k in keys.split(", ") if k]
    _BODY[name] = body

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(panel.trade_bars(spark, sf_dir, symbol)).select(*key_cols, *columns), digits)

    shown = [f'CAST("{k}" AS VARCHAR) AS "{k}"' if k in ("Date", "period") else k for k in key_cols]
    shown += [f"round({c} + {_shift(digits)!r}::DOUBLE, {digits}) + 0.0 AS {c}" if kind == "d" else c for c, kind in columns.items()]
    _register(name, build, f"WITH RECURSIVE {_BARS.format(symbol=symbol)}, body AS ({body}) SELECT {', '.join(shown)} FROM body" if sql else None)


def d(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "d")


# --- bars ---
on_bars("p0_bars", lambda b: b, d("Open", "High", "Low", "Close", "Volume"))
on_bars("p0_bars_by_brand", lambda b: b, d("Open", "High", "Low", "Close", "Volume"), symbol="p_brand")
on_bars("p5_change_rate", lambda b: series.volume_streak(panel.change_rate(b)), d("rate", "volume_change", "volume_day"),
        f'''SELECT *, v * row_number() OVER (PARTITION BY symbol, v, i - k ORDER BY i) AS volume_day FROM (SELECT *, row_number() OVER (PARTITION BY symbol, v ORDER BY i) AS k FROM (
            SELECT *, "Close" / nullif({lag('"Close"')}, 0) - 1 AS rate, "Volume" - {lag('"Volume"')} AS volume_change, CASE WHEN "Volume" > {lag('"Volume"')} THEN 1 ELSE -1 END AS v FROM bars))''')
for _by, _literal in (("week", False), ("month", False)):
    on_bars(f"p6_resample_{_by}", lambda b, by=_by: panel.resample(b, by), d("Open", "High", "Low", "Close", "Volume"),
            f'''SELECT symbol, {'min("Date")' if _by == 'week' else "CAST(date_trunc('month', " + 'min("Date")) AS DATE)'} AS "Date", arg_min("Open", "Date") AS "Open", max("High") AS "High", min("Low") AS "Low", arg_max("Close", "Date") AS "Close", sum("Volume") AS "Volume"
                FROM bars GROUP BY symbol, date_trunc('{_by}', "Date")''')
on_bars("p6_resample_week_literal", lambda b: panel.resample(b, "week", True), d("Open", "High", "Low", "Close", "Volume"),
        f'''SELECT symbol, min("Date") AS "Date", arg_min("Open", "Date") AS "Open", max("High") AS "High", min("Low") AS "Low", arg_max("Close", "Date") AS "Close", sum("Volume") AS "Volume" FROM (
            SELECT *, sum(s) OVER {RUN} AS g FROM (SELECT *, CASE WHEN isodow("Date") < isodow(lag("Date") OVER {W}) THEN 1 ELSE 0 END AS s FROM bars)) GROUP BY symbol, g''')


def _action_fixture(b: DataFrame) -> DataFrame:
    """Closes are halved before 1996; the first, second and tenth of a month have actions."""
    day = F.dayofmonth("Date")
    return b.withColumns({"AdjClose": F.col("Close") * F.when(F.col("Date") < F.to_date(F.lit("1996-01-01")), 0.5).otherwise(1.0), "Dividend": F.when(day == 1, 0.25).otherwise(0.0),
                          "Split": F.when(day == 2, 2.0).when(day == 10, 0.5).otherwise(1.0)})


for _by in ("week", "month"):
    on_bars(f"p7_resample_{_by}_actions", lambda b, by=_by: panel.resample(_action_fixture(b), by), d("Open", "High", "Low", "Close", "AdjClose", "Volume", "Dividend", "Split"),
            f'''SELECT symbol, {'min("Date")' if _by == 'week' else "CAST(date_trunc('month', " + 'min("Date")) AS DATE)'} AS "Date", arg_min(f * "Open", "Date") AS "Open", max(f * "High") AS "High", min(f * "Low") AS "Low",
                arg_max(f * "Close", "Date") AS "Close", arg_max(f * "Close", "Date") AS AdjClose, sum("Volume") AS "Volume", sum(CASE WHEN day("Date") = 1 THEN 0.25 ELSE 0.0 END::DOUBLE) AS Dividend,
                product(CASE day("Date") WHEN 2 THEN 2.0 WHEN 10 THEN 0.5 ELSE 1.0 END) AS Split FROM (SELECT *, CASE WHEN year("Date") < 1996 THEN 0.5::DOUBLE ELSE 1.0 END AS f FROM bars) GROUP BY symbol, date_trunc('{_by}', "Date")''')
on_bars("p8_heikin_ashi", panel.heikin_ashi, d("H_Open", "H_High", "H_Low", "H_Close"),
        f'''SELECT symbol, "Date", ho AS H_Open, hc AS H_Close, greatest(ph, ho, hc) AS H_High, least(pl, ho, hc) AS H_Low FROM (SELECT *, ("Open" + "High" + "Low" + "Close") / 4 AS hc,
            (lag("Open") OVER {W} + lag("Close") OVER {W}) / 2 AS ho, lag("High") OVER {W} AS ph, lag("Low") OVER {W} AS pl FROM bars) WHERE ho IS NOT NULL''')
on_bars("g10_latest_per_symbol", panel.latest_per_symbol, d("Close", "Volume"), 'SELECT * FROM bars WHERE i = n_rows')


def _split_fixture(b: DataFrame) -> DataFrame:
    """Prices halve from 1998-06-01 on; the split is written on that day's or the next bar."""
    after = F.col("Date") >= F.to_date(F.lit("1998-06-01"))
    b = b.withColumns({c: F.when(after, F.col(c) / 2).otherwise(F.col(c)) for c in ("Open", "High", "Low", "Close")}).withColumn("AdjClose", F.col("Close"))
    first = F.min(F.when(after, F.col("Date"))).over(panel.whole())
    return b.withColumn("Split", F.when(F.col("Date") == first, 2.0).otherwise(1.0))


on_bars("p2_split_adjust", lambda b: panel.split_adjust(_split_fixture(b)), d("AdjClose"),
        f'''SELECT symbol, "Date", c * coalesce(first_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY "Date" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS AdjClose FROM (
            SELECT *, CASE WHEN lag(c) OVER {W} / c >= 1.95 OR lag(c) OVER {W} / c <= 0.45 THEN CASE WHEN sp <> 1 THEN 1 / sp WHEN lead(sp) OVER {W} <> 1 THEN 1 / lead(sp) OVER {W} END END AS f FROM (
            SELECT symbol, "Date", CASE WHEN "Date" >= DATE '1998-06-01' THEN "Close" / 2 ELSE "Close" END AS c, CASE WHEN "Date" = min(CASE WHEN "Date" >= DATE '1998-06-01' THEN "Date" END) OVER {ALL} THEN 2.0 ELSE 1.0 END AS sp FROM bars))''')

# --- series ---
on_bars("c1_rolling", lambda b: b.withColumns({"m": series.rolling("Close", 10), "s": series.rolling("Close", 10, "std"), "lo": series.rolling("Close", 10, "min", False), "total": series.rolling("Volume", 10, "sum", False)}), d("m", "s", "lo", "total"),
        f'SELECT *, {roll("avg", chr(34) + "Close" + chr(34), 10)} AS m, {roll("stddev_samp", chr(34) + "Close" + chr(34), 10)} AS s, min("Close") OVER {R(10)} AS lo, sum("Volume") OVER {R(10)} AS total FROM bars')
on_bars("c3_wma", lambda b: b.withColumn("wma", series.wma("Close", 9)), d("wma"),
        f'''SELECT *, ({" + ".join(f'lag("Close", {k}) OVER {W} * {9 - k}' for k in range(9))}) / 45.0 AS wma FROM bars''')
_MOVE = 'sign("Close" - lag("Close") OVER {W})'.format(W=W)


def _moves(b: DataFrame) -> DataFrame:
    return b.withColumn("x", F.signum(F.floor((F.col("Close") - panel.lag("Close")) / 500)))


_X = f'''x0 AS (SELECT *, CAST(sign(floor(("Close" - lag("Close") OVER {W}) / 500)) AS DOUBLE) AS x FROM bars)'''
for _name, _zero, _restart in (("c4_streak", None, False), ("c4_streak_zero_as_1", 1.0, False), ("c4_streak_restart", 1.0, True)):
    # The plain recursion of the definition, one row at a time.
    _z = "c.x" if _zero is None else "CASE WHEN s.r IS NULL THEN NULL WHEN s.r = 0 THEN 0.0 WHEN s.r > 0 THEN s.r + 1 ELSE s.r - 1 END"
    on_bars(_name, lambda b, z=_zero, r=_restart: series.streak(_moves(b), "x", "run", z, r), d("run"),
            f'''WITH RECURSIVE {_X}, rec(symbol, i, r) AS (SELECT symbol, i, x FROM x0 WHERE i = 1 UNION ALL SELECT c.symbol, c.i, CASE WHEN c.x IS NULL THEN NULL WHEN c.x = 0 THEN {_z}
                WHEN {'c.x IN (1, -1)' if _restart else 'FALSE'} THEN c.x WHEN s.r IS NULL OR sign(c.x) <> sign(s.r) THEN c.x ELSE s.r + c.x END FROM rec s JOIN x0 c ON c.symbol = s.symbol AND c.i = s.i + 1)
                SELECT x0.symbol, x0."Date", rec.r AS run FROM x0 JOIN rec USING (symbol, i)''')
on_bars("c5_moving_slope", lambda b: series.moving_slope(b, "Close", 10), d("Close_slope", "Close_intercept"),
        f'''SELECT *, CASE WHEN i >= 10 THEN k END AS Close_slope, CASE WHEN i >= 10 THEN a + k * (i - 9) END AS Close_intercept FROM (SELECT *, regr_slope("Close", i) OVER {R(10)} AS k, regr_intercept("Close", i) OVER {R(10)} AS a FROM bars)''')
on_bars("c6_linear_fit", lambda b: series.linear_fit(b, "Close", 60), d("slope", "intercept"),
        'SELECT symbol, CASE WHEN max(n_rows) <= 60 THEN 0.0 ELSE regr_slope("Close", i - n_rows + 60) END AS slope, CASE WHEN max(n_rows) <= 60 THEN 0.0 ELSE regr_intercept("Close", i - n_rows + 60) END AS intercept FROM bars WHERE i > n_rows - 60 GROUP BY symbol', keys="symbol")
on_bars("c7_normalize", lambda b: b.withColumns({"unit": series.normalize("Close"), "wide": series.normalize("Volume", True)}), d("unit", "wide"),
        f'SELECT *, ("Close" - min("Close") OVER {ALL}) / nullif(max("Close") OVER {ALL} - min("Close") OVER {ALL}, 0) AS unit, 2 * ("Volume" - min("Volume") OVER {ALL}) / nullif(max("Volume") OVER {ALL} - min("Volume") OVER {ALL}, 0) - 1 AS wide FROM bars')
on_bars("c8_crossover", lambda b: series.crossover(b.withColumns({"fast": series.rolling("Close", 5, full=False), "slow": series.rolling("Close", 20, full=False)}), "fast", "slow", "signal"), {"signal": "s"},
        f'''SELECT *, CASE WHEN (f <= 0 AND p > 0) OR (f < 0 AND p >= 0) THEN 's' WHEN (f >= 0 AND p < 0) OR (f > 0 AND p <= 0) THEN 'b' ELSE 'n' END AS signal FROM (SELECT *, lag(f) OVER {W} AS p FROM (SELECT *, avg("Close") OVER {R(5)} - avg("Close") OVER {R(20)} AS f FROM bars))''')
_RULES = [("big", "+", "Volume > 100"), ("rise", "+", "Close > Open"), ("fall", "-", "Close < Open")]
on_bars("c10_rule_value", lambda b: b.withColumn("state", series.rule_value([("Close > Open", "up"), ("Close < Open", "down"), ("Volume > 100", "busy")], "flat")), {"state": "s"},
        '''SELECT *, CASE WHEN "Volume" > 100 THEN 'busy' WHEN "Close" < "Open" THEN 'down' WHEN "Close" > "Open" THEN 'up' ELSE 'flat' END AS state FROM bars''')
on_bars("c11_rule_score", lambda b: b.withColumns(series.rule_score([("big", "Volume > 100", 0.5), ("rise", "Close > Open", 1), ("fall", "Close < Open", -1), ("thin", "Volume < 20", -0.25)])), d("up_score", "down_score") | {"up_names": "s", "down_names": "s"},
        '''SELECT *, (CASE WHEN "Volume" > 100 THEN 0.5 ELSE 0.0 END) + (CASE WHEN "Close" > "Open" THEN 1.0 ELSE 0.0 END) AS up_score, (CASE WHEN "Close" < "Open" THEN -1.0 ELSE 0.0 END) + (CASE WHEN "Volume" < 20 THEN -0.25 ELSE 0.0 END) AS down_score,
           concat_ws(', ', CASE WHEN "Volume" > 100 THEN 'big' END, CASE WHEN "Close" > "Open" THEN 'rise' END) AS up_names, concat_ws(', ', CASE WHEN "Close" < "Open" THEN 'fall' END, CASE WHEN "Volume" < 20 THEN 'thin' END) AS down_names FROM bars''')

# --- indicators of windows ---
C, H, L, V = '"Close"', '"High"', '"Low"', '"Volume"'
on_bars("b2_aroon", lambda b: recursive.recursive_block(b, ["aroon"]), d("aroon_up", "aroon_down", "aroon_gap"),
        f'''SELECT *, up - down AS aroon_gap, up AS aroon_up, down AS aroon_down FROM (SELECT *, list_position(w, list_max(w)) / 25.0 * 100 AS up, list_position(w, list_min(w)) / 25.0 * 100 AS down FROM (SELECT *, list({C}) OVER {R(25)} AS w FROM bars))''')
on_bars("b3_cci", lambda b: recursive.recursive_block(b, ["cci"]), d("cci", "cci_ma"),
        f'''SELECT *, {roll("avg", "cci", 5)} AS cci_ma FROM (SELECT *, CASE WHEN i >= 20 THEN (pp - m) / nullif(0.015 * list_avg(list_transform(w, lambda x: abs(x - m))), 0) END AS cci FROM (SELECT *, avg(pp) OVER {R(20)} AS m, list(pp) OVER {R(20)} AS w FROM (SELECT *, ({H} + {L} + {C}) / 3 AS pp FROM bars)))''')
on_bars("b4_dpo", indicators.dpo, d("dpo"), f'SELECT *, {lag(C, 11)} - avg({C}) OVER {R(20)} AS dpo FROM bars')
on_bars("b5_ichimoku", indicators.ichimoku, d("tankan", "kijun", "senkou_a", "senkou_b", "chikan"),
        f'''SELECT symbol, "Date", tankan, kijun, chikan, lag((tankan + kijun) / 2, 26) OVER {W} AS senkou_a, lag(sb, 26) OVER {W} AS senkou_b FROM (SELECT *, (max({H}) OVER {R(9)} + min({L}) OVER {R(9)}) / 2 AS tankan, (max({H}) OVER {R(26)} + min({L}) OVER {R(26)}) / 2 AS kijun,
            (max({H}) OVER {R(52)} + min({L}) OVER {R(52)}) / 2 AS sb, lead({C}, 26) OVER {W} AS chikan FROM bars)''')
on_bars("b5_ichimoku_original", lambda b: indicators.ichimoku(b, original=True), d("tankan", "kijun", "senkou_a", "senkou_b", "chikan"),
        f'''SELECT symbol, "Date", tankan, kijun, chikan, lag((tankan + kijun) / 2, 26) OVER {W} AS senkou_a, lag(sb, 26) OVER {W} AS senkou_b FROM (SELECT *, ({roll("avg", H, 9)} + {roll("avg", L, 9)}) / 2 AS tankan,
            ({roll("avg", H, 26)} + {roll("avg", L, 26)}) / 2 AS kijun, ({roll("avg", H, 52)} + {roll("avg", L, 52)}) / 2 AS sb, lead({C}, 26) OVER {W} AS chikan FROM bars)''')
_ROC = ", ".join(f"{C} / nullif({lag(C, k)}, 0) - 1 AS r{j}" for j, k in enumerate((10, 15, 20, 30)))
on_bars("b6_kst", indicators.kst, d("kst", "kst_sign", "kst_diff"),
        f'''SELECT *, (dd - avg(dd) OVER {ALL}) / nullif(stddev_samp(dd) OVER {ALL}, 0) AS kst_diff FROM (SELECT *, kst - kst_sign AS dd FROM (SELECT *, avg(kst) OVER {R(9)} AS kst_sign FROM (SELECT *, 100 * ({" + ".join(f"{j + 1} * avg(r{j}) OVER {R(n)}" for j, n in enumerate((10, 10, 10, 15)))}) AS kst FROM (SELECT *, {_ROC} FROM bars))))''')
on_bars("b10_vortex", indicators.vortex, d("vortex_pos", "vortex_neg", "vortex_diff"),
        f'''SELECT *, vortex_pos - vortex_neg AS vortex_diff FROM (SELECT *, sum(p) OVER {R(14)} / nullif({roll("sum", "tr", 14)}, 0) AS vortex_pos, sum(m) OVER {R(14)} / nullif({roll("sum", "tr", 14)}, 0) AS vortex_neg FROM (
            SELECT *, greatest({H}, {lag(C)}) - least({L}, {lag(C)}) AS tr, abs({H} - {lag(L)}) AS p, abs({L} - {lag(H)}) AS m FROM bars))''')
_CLV = f"coalesce((2 * {C} - {L} - {H}) / nullif({H} - {L}, 0), 0)"
on_bars("b17_adi", indicators.adi, d("adi"), f"SELECT *, a + {lag('a')} AS adi FROM (SELECT *, {_CLV} * {V} AS a FROM bars)")
on_bars("b18_cmf", indicators.cmf, d("cmf") | {"cmf_signal": "s"}, f"SELECT *, CASE WHEN cmf < -0.05 THEN 's' WHEN cmf > 0.05 THEN 'b' ELSE 'n' END AS cmf_signal FROM (SELECT *, sum(a) OVER {R(20)} / nullif(sum({V}) OVER {R(20)}, 0) AS cmf FROM (SELECT *, {_CLV} * {V} AS a FROM bars))")
on_bars("b19_eom", indicators.eom, d("eom", "eom_ma_14", "eom_diff"),
        f'''SELECT *, (dd - avg(dd) OVER {ALL}) / nullif(stddev_samp(dd) OVER {ALL}, 0) AS eom_diff FROM (SELECT *, eom - eom_ma_14 AS dd FROM (SELECT *, {roll("avg", "eom", 14)} AS eom_ma_14 FROM (SELECT *, avg(e) OVER {R(20)} AS eom FROM (
            SELECT *, ({H} - {lag(H)} + {L} - {lag(L)}) * ({H} - {L}) / nullif(2 * {V}, 0) AS e FROM bars))))''')
on_bars("b21_nvi", indicators.nvi, d("nvi"), f"SELECT *, 1000 + sum(s) OVER {RUN} AS nvi FROM (SELECT *, CASE WHEN {lag(V)} > {V} THEN ({C} / nullif({lag(C)}, 0) - 1) * 100 ELSE 0 END AS s FROM bars)")
on_bars("b22_obv", indicators.obv, d("obv"), f"SELECT *, sum(s) OVER {RUN} AS obv FROM (SELECT *, nullif(sign({C} - {lag(C)}), 0) * {V} AS s FROM bars)")
on_bars("b23_vpt", indicators.vpt, d("vpt"), f"SELECT *, v + {lag('v')} AS vpt FROM (SELECT *, {V} * ({C} / nullif({lag(C)}, 0) - 1) AS v FROM bars)")
on_bars("b24_ao", indicators.ao, d("ao", "ao_ma"), f"SELECT *, {roll('avg', 'ao', 2)} AS ao_ma FROM (SELECT *, avg(({H} + {L}) / 2) OVER {R(5)} - avg(({H} + {L}) / 2) OVER {R(34)} AS ao FROM bars)")
on_bars("b26_mfi", indicators.mfi, d("mfi"),
        f'''SELECT *, CASE WHEN {roll("sum", "w", 14).replace("CASE", "(CASE", 1)}) = 0 AND ({roll("sum", "u", 14)}) > 0 THEN 100.0 ELSE 100 - 100 / nullif(1 + {roll("sum", "u", 14)} / nullif({roll("sum", "w", 14)}, 0), 0) END AS mfi FROM (SELECT *, greatest(f, 0.0) AS u, greatest(-f, 0.0) AS w FROM (SELECT *, tp * {V} * coalesce(sign(tp - {lag("tp")}), 0) AS f FROM (SELECT *, ({H} + {L} + {C}) / 3 AS tp FROM bars)))''')
on_bars("b30_stoch", indicators.stoch, d("stoch_k", "stoch_d", "stoch_diff"), f"SELECT *, stoch_k - stoch_d AS stoch_diff FROM (SELECT *, avg(stoch_k) OVER {R(3)} AS stoch_d FROM (SELECT *, 100 * ({C} - min({L}) OVER {R(14)}) / nullif(max({H}) OVER {R(14)} - min({L}) OVER {R(14)}, 0) AS stoch_k FROM bars))")
_UO = lambda n: f"sum(bp) OVER {R(n)} / nullif(sum(tr) OVER {R(n)}, 0)"
on_bars("b32_uo", indicators.uo, d("uo", "uo_diff"),
        f'''SELECT *, uo - {lag("uo")} AS uo_diff FROM (SELECT *, 100 * (4 * {_UO(7)} + 2 * {_UO(14)} + {_UO(28)}) / 7 AS uo FROM (SELECT *, {C} - least(b, {L}) AS bp, greatest(b, {H}) - least(b, {L}) AS tr FROM (SELECT *, coalesce({lag(C)}, avg({C}) OVER {ALL}) AS b FROM bars)))''')
on_bars("b33_williams_r", indicators.williams_r, d("wr"), f"SELECT *, -100 * (max({H}) OVER {R(14)} - {C}) / nullif(max({H}) OVER {R(14)} - min({L}) OVER {R(14)}, 0) AS wr FROM bars")
on_bars("b34_bollinger", indicators.bollinger, d("mavg", "mstd", "bb_high", "bb_low"), f"SELECT *, mavg + 2 * mstd AS bb_high, mavg - 2 * mstd AS bb_low FROM (SELECT *, {roll("avg", C, 20)} AS mavg, {roll("stddev_pop", C, 20)} AS mstd FROM bars)")
on_bars("b35_donchian", indicators.donchian, d("dc_high", "dc_low", "dc_middle") | {"dc_signal": "s"}, f"SELECT *, CASE WHEN {C} >= dc_high THEN 's' WHEN {C} <= dc_low THEN 'b' ELSE 'n' END AS dc_signal, (dc_high + dc_low) / 2 AS dc_middle FROM (SELECT *, max({C}) OVER {R(20)} AS dc_high, min({C}) OVER {R(20)} AS dc_low FROM bars)")
on_bars("b37_ulcer", indicators.ulcer, d("ulcer"), f"SELECT *, sqrt({roll('avg', 'dd', 14)}) AS ulcer FROM (SELECT *, pow(100 * ({C} / nullif(max({C}) OVER {R(14)}, 0) - 1), 2) AS dd FROM bars)")
on_bars("b38_mean_reversion", indicators.mean_reversion, d("up_rate", "down_rate"),
        f'''SELECT symbol, avg(r) + 2 * sqrt(var_pop(r) * count(r) / 99 / (99.0 * 99 / 10000 - 4.0 / 100)) AS up_rate, avg(r) - 2 * sqrt(var_pop(r) * count(r) / 99 / (99.0 * 99 / 10000 - 4.0 / 100)) AS down_rate FROM (SELECT *, {C} / nullif({lag(C)}, 0) - 1 AS r FROM bars) WHERE i > n_rows - 99 GROUP BY symbol HAVING count(r) = 99''', keys="symbol")
on_bars("d1_candle_shape", indicators.candle_shape, d("shadow", "body", "shadow_upper_pct", "shadow_lower_pct", "body_pct") | {"color": "s"},
        f'''SELECT *, CAST(sign({C} - "Open") AS INTEGER) AS color, {H} - {L} AS shadow, abs({C} - "Open") AS body, ({H} - greatest("Open", {C})) / nullif({H} - {L}, 0) AS shadow_upper_pct, (least("Open", {C}) - {L}) / nullif({H} - {L}, 0) AS shadow_lower_pct, abs({C} - "Open") / nullif({H} - {L}, 0) AS body_pct FROM bars''')

# --- recursive indicators ---
_rec = lambda *names: lambda b: recursive.recursive_block(b, list(names))
on_bars("c2_ema", lambda b: recursive.recursive_block(b, ["macd"]), d("macd", "macd_sign", "macd_diff"),
        f'''WITH {ema_sql("bars", C, 2 / 13, 12, "f")}, {ema_sql("bars", C, 2 / 27, 26, "g")}, m AS (SELECT b.symbol, b."Date", b.i, f - g AS macd FROM bars b JOIN f_e USING (symbol, i) JOIN g_e USING (symbol, i)),
            {ema_sql("m", "macd", 2 / 10, 9, "macd_sign")} SELECT *, macd - macd_sign AS macd_diff FROM m JOIN macd_sign_e USING (symbol, i)''')
on_bars("b8_mass_index", _rec("mass_index"), d("mi"),
        f'''WITH h AS (SELECT *, {H} - {L} AS hl FROM bars), {ema_sql("h", "hl", 0.2, 9, "e1")}, h1 AS (SELECT * FROM h JOIN e1_e USING (symbol, i)), {ema_sql("h1", "e1", 0.2, 9, "e2")}
            SELECT *, {roll("sum", "x", 25)} AS mi FROM (SELECT *, e1 / nullif(e2, 0) AS x FROM h1 JOIN e2_e USING (symbol, i))''')
on_bars("b20_force_index", _rec("force_index"), d("fi", "fi_ema"), f'WITH h AS (SELECT *, ({C} - {lag(C, 2)}) * {V} AS fi FROM bars), {ema_sql("h", "fi", 2 / 23, 22, "fi_ema")} SELECT * FROM h JOIN fi_ema_e USING (symbol, i)')
on_bars("b28_rsi", _rec("rsi"), d("rsi", "srsi"),
        f'''WITH h0 AS (SELECT *, {C} - {lag(C)} AS m FROM bars), h AS (SELECT *, CASE WHEN m > 0 THEN m WHEN m <= 0 THEN 0.0 END AS u, CASE WHEN m < 0 THEN -m WHEN m >= 0 THEN 0.0 END AS w FROM h0), {ema_sql("h", "u", 1 / 14, 0, "eu")}, {ema_sql("h", "w", 1 / 14, 0, "ew")}
            SELECT *, (rsi - min(rsi) OVER {R(14)}) / nullif(max(rsi) OVER {R(14)} - min(rsi) OVER {R(14)}, 0) AS srsi FROM (SELECT *, 100 * eu / nullif(eu + ew, 0) AS rsi FROM h JOIN eu_e USING (symbol, i) JOIN ew_e USING (symbol, i))''')
on_bars("b27_atr", _rec("atr"), d("tr", "atr", "atr_diff"),
        f'''WITH RECURSIVE x AS (SELECT *, avg(tr) OVER {R(14)} AS m FROM (SELECT *, greatest({H} - {L}, abs({H} - {lag(C)}), abs({L} - {lag(C)})) AS tr FROM bars)),
            rec(symbol, i, atr) AS (SELECT symbol, i, m FROM x WHERE i <= 14 UNION ALL SELECT x.symbol, x.i, (rec.atr * 13 + x.tr) / 14 FROM rec JOIN x ON x.symbol = rec.symbol AND x.i = rec.i + 1 WHERE rec.i >= 14)
            SELECT *, atr - {lag("atr")} AS atr_diff FROM x JOIN rec USING (symbol, i)''')
on_bars("b25_kama", _rec("kama"), d("kama"),
        f'''WITH RECURSIVE x0 AS (SELECT *, abs({C} - {lag(C, 10)}) / nullif({roll("sum", "m", 10)}, 0) AS er0 FROM (SELECT *, abs({C} - {lag(C)}) AS m FROM bars)), x AS (SELECT *, last_value(er0 IGNORE NULLS) OVER {RUN} AS er FROM x0),
            rec(symbol, i, kama) AS (SELECT symbol, i, {C} FROM x WHERE i = 10 UNION ALL SELECT x.symbol, x.i, rec.kama + pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) * (x.{C} - rec.kama) FROM rec JOIN x ON x.symbol = rec.symbol AND x.i = rec.i + 1)
            SELECT * FROM x LEFT JOIN rec USING (symbol, i)''')
_BY_I = lambda x: x.replace('"Date"', "i")  # noqa: E731  windows over CTEs that hold no Date
on_bars("b9_trix", _rec("trix"), d("trix", "trix_sign", "trix_diff"),
        f'''WITH {ema_sql("bars", C, 2 / 16, 15, "e1")}, {ema_sql("e1_e", "e1", 2 / 16, 15, "e2")}, {ema_sql("e2_e", "e2", 2 / 16, 15, "e3")}, t AS (SELECT symbol, i, 100 * (e3 / {_BY_I(lag("e3"))} - 1) AS trix FROM e3_e), {ema_sql("t", "trix", 2 / 10, 9, "trix_sign")}
            SELECT *, trix - trix_sign AS trix_diff FROM bars JOIN t USING (symbol, i) JOIN trix_sign_e USING (symbol, i)''')
on_bars("b31_tsi", _rec("tsi"), d("tsi", "tsi_sign"),
        f'''WITH m AS (SELECT symbol, i, {C} - coalesce({lag(C)}, avg({C}) OVER {ALL}) AS m, abs({C} - coalesce({lag(C)}, avg({C}) OVER {ALL})) AS a FROM bars), {ema_sql("m", "m", 1 / 26, 0, "m1")}, {ema_sql("m1_e", "m1", 1 / 14, 0, "m2")}, {ema_sql("m", "a", 1 / 26, 0, "a1")}, {ema_sql("a1_e", "a1", 1 / 14, 0, "a2")},
            t AS (SELECT symbol, i, 100 * m2 / nullif(a2, 0) AS tsi FROM m2_e JOIN a2_e USING (symbol, i)), {ema_sql("t", "tsi", 2 / 8, 7, "tsi_sign")} SELECT * FROM bars JOIN t USING (symbol, i) JOIN tsi_sign_e USING (symbol, i)''')
on_bars("b36_keltner", _rec("keltner"), d("kc_middle", "kc_high", "kc_low"),
        f'''WITH RECURSIVE x AS (SELECT *, avg(tr) OVER {R(14)} AS w, avg(tp) OVER {R(10)} AS kc_middle FROM (SELECT *, ({H} + {L} + {C}) / 3 AS tp, greatest({H} - {L}, abs({H} - {lag(C)}), abs({L} - {lag(C)})) AS tr FROM bars)),
            rec(symbol, i, r) AS (SELECT symbol, i, w FROM x WHERE i <= 14 UNION ALL SELECT x.symbol, x.i, (rec.r * 13 + x.tr) / 14 FROM rec JOIN x ON x.symbol = rec.symbol AND x.i = rec.i + 1 WHERE rec.i >= 14)
            SELECT *, kc_middle + 2 * r AS kc_high, kc_middle - 2 * r AS kc_low FROM x JOIN rec USING (symbol, i)''')
on_bars("b1_adx", _rec("adx"), d("pdi", "mdi", "adx_strength", "adx_value", "adx_value_prediction"),
        f'''WITH x AS (SELECT *, greatest({H} - {lag(H)}, 0) AS u0, greatest({lag(L)} - {L}, 0) AS w0, greatest({H} - {L}, abs({H} - {lag(C)}), abs({L} - {lag(C)})) AS tr FROM bars), y AS (SELECT *, CASE WHEN i > 1 THEN u0 END AS u, CASE WHEN i > 1 THEN w0 END AS w FROM x),
            {ema_sql("y", "u", 2 / 15, 14, "eu")}, {ema_sql("y", "w", 2 / 15, 14, "ew")}, q AS (SELECT *, 100 * eu / nullif(tr, 0) AS pdi, 100 * ew / nullif(tr, 0) AS mdi FROM y JOIN eu_e USING (symbol, i) JOIN ew_e USING (symbol, i)),
            z AS (SELECT *, pdi - mdi AS df, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM q), {ema_sql("z", "dx", 2 / 15, 14, "adx_strength")}, {ema_sql("z", "df", 2 / 6, 5, "adx_value")},
            v AS (SELECT symbol, i, adx_value, adx_value - {_BY_I(lag("adx_value"))} AS ch FROM adx_value_e), {ema_sql("v", "ch", 0.5, 3, "ec")}, p AS (SELECT symbol, i, adx_value + ec AS g FROM v JOIN ec_e USING (symbol, i)), {ema_sql("p", "g", 2 / 6, 5, "adx_value_prediction")}
            SELECT * FROM z JOIN adx_strength_e USING (symbol, i) JOIN adx_value_e USING (symbol, i) JOIN adx_value_prediction_e USING (symbol, i)''')

on_bars("b21_nvi_ema", lambda b: recursive.recursive_block(indicators.nvi(b), ["nvi_ema"]), d("nvi_ema"), f'WITH h AS ({_BODY["b21_nvi"]}), {ema_sql("h", "nvi", 2 / 256, 255, "nvi_ema")} SELECT * FROM h JOIN nvi_ema_e USING (symbol, i)')


def crosses(x: str, up: str = "b", down: str = "s") -> str:
    """The way in which x passes zero."""
    return f"CASE WHEN {x} > 0 AND {lag(x)} <= 0 OR {x} = 0 AND {lag(x)} < 0 THEN '{up}' WHEN {x} < 0 AND {lag(x)} >= 0 OR {x} = 0 AND {lag(x)} > 0 THEN '{down}' ELSE 'n' END"


on_bars("c2_ema_scan", scans.macd_scan, d("macd", "macd_sign", "macd_diff"), _BODY["c2_ema"])
on_bars("b7_macd_signal", lambda b: indicators.macd_signal(_rec("macd")(b)), d("macd_diff") | {"macd_signal": "s"}, f"SELECT *, {crosses('macd_diff')} AS macd_signal FROM ({_BODY['c2_ema']})")
on_bars("b8_mass_signal", lambda b: indicators.mass_signal(_rec("mass_index")(b)), d("mi") | {"mi_signal": "s"},
        f"SELECT *, CASE WHEN {crosses('(mi - 26.5)')} = 's' THEN 's' WHEN {crosses('(mi - 27)')} = 'b' THEN 'b' ELSE 'n' END AS mi_signal FROM ({_BODY['b8_mass_index']})")
on_bars("b29_srsi_signal", lambda b: indicators.srsi_signal(_rec("rsi")(b)), d("srsi") | {"srsi_signal": "s"}, f"SELECT *, CASE WHEN srsi < 20 THEN 'b' WHEN srsi > 80 THEN 's' ELSE 'n' END AS srsi_signal FROM ({_BODY['b28_rsi']})")
on_bars("b31_tsi_signals", lambda b: indicators.tsi_signals(_rec("tsi")(b)), d("tsi") | {"tsi_fast_slow_signal": "s", "tsi_centerline_signal": "s"},
        f"SELECT *, {crosses('(tsi - tsi_sign)')} AS tsi_fast_slow_signal, {crosses('tsi')} AS tsi_centerline_signal FROM ({_BODY['b31_tsi']})")
_KC = f"CASE WHEN {C} > kc_high THEN 's' WHEN {C} < kc_low THEN 'b' ELSE 'n' END AS kc_signal"
on_bars("b36_keltner_signal", lambda b: indicators.keltner_signal(_rec("keltner")(b)), d("kc_middle") | {"kc_signal": "s"}, f"SELECT *, {_KC} FROM ({_BODY['b36_keltner']})")
on_bars("b36_keltner_bands", lambda b: indicators.keltner_signal(indicators.keltner_bands(b)), d("kc_middle", "kc_high", "kc_low") | {"kc_signal": "s"},
        f"SELECT *, {_KC} FROM (SELECT *, avg(({H} + {L} + {C}) / 3) OVER {R(10)} AS kc_middle, avg((4 * {H} - 2 * {L} + {C}) / 3) OVER {R(10)} AS kc_high, avg((4 * {L} - 2 * {H} + {C}) / 3) OVER {R(10)} AS kc_low FROM bars)")

# --- finance ---
_HPR = f'SELECT symbol, arg_max({C}, "Date") / nullif(arg_min({C}, "Date"), 0) - 1 AS hpr, date_diff(\'day\', min("Date"), max("Date")) AS days FROM bars GROUP BY symbol'
_RATES = "hpr, CASE WHEN days > 0 THEN pow(1 + hpr, 365.0 / days) - 1 END AS ear, hpr / nullif(days / 365.0, 0) AS apr, CASE WHEN days > 0 AND hpr > -1 THEN ln(pow(1 + hpr, 365.0 / days)) END AS ccr"
on_bars("h2_return_measures", finance.return_measures, d("hpr", "ear", "apr", "ccr"), f"SELECT symbol, {_RATES} FROM ({_HPR})", keys="symbol", symbol="p_brand")
_AV = f'''SELECT symbol, CASE WHEN date_diff('day', min("Date"), max("Date")) <= 1 THEN 0.0 ELSE sqrt(var_samp(r) * 365.0 / (date_diff('day', min("Date"), max("Date")) - 1)) END AS volatility FROM (SELECT *, {C} / nullif({lag(C)}, 0) - 1 AS r FROM bars) GROUP BY symbol'''
on_bars("h3_annual_volatility", lambda b: finance.annual_volatility(panel.change_rate(b)), d("volatility"), _AV, keys="symbol", symbol="p_brand")
on_bars("h6_sharpe", lambda b: finance.sharpe(panel.change_rate(b)), d("sharpe"), f"SELECT symbol, (ear - 0.04) / nullif(volatility, 0) AS sharpe FROM (SELECT symbol, {_RATES} FROM ({_HPR})) JOIN ({_AV}) USING (symbol)", keys="symbol", symbol="p_brand")
on_bars("h7_max_drawdown", finance.max_drawdown, d("max_drawdown"), f'SELECT a.symbol, min(b.{C} / a.{C} - 1) AS max_drawdown FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.i >= a.i GROUP BY a.symbol', keys="symbol", symbol="p_brand")
_SPAN = ("1994-01-01", "1996-12-31")
_IN = "\"Date\" BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"
_AV_SPAN = f'''SELECT symbol, CASE WHEN n <= 1 THEN 0.0 ELSE sqrt(v * 365.0 / (n - 1)) END AS volatility FROM (SELECT symbol, var_samp(r) AS v, date_diff('day', min("Date") FILTER (WHERE {_IN}), max("Date") FILTER (WHERE {_IN})) AS n
            FROM (SELECT *, {C} / nullif({lag(C)}, 0) - 1 AS r FROM bars) GROUP BY symbol)'''
_HPR_SPAN = _HPR.replace("FROM bars", f"FROM bars WHERE {_IN}")
on_bars("h3_annual_volatility_span", lambda b: finance.annual_volatility(panel.change_rate(b), "rate", *_SPAN), d("volatility"), _AV_SPAN, keys="symbol", symbol="p_brand")
on_bars("h6_sharpe_span", lambda b: finance.sharpe(panel.change_rate(b), 0.04, "Close", *_SPAN), d("sharpe"), f"SELECT symbol, (ear - 0.04) / nullif(volatility, 0) AS sharpe FROM (SELECT symbol, {_RATES} FROM ({_HPR_SPAN})) JOIN ({_AV_SPAN}) USING (symbol)", keys="symbol", symbol="p_brand")
on_bars("h7_max_drawdown_span", lambda b: finance.max_drawdown(b, "Close", *_SPAN), d("max_drawdown"), f'SELECT a.symbol, min(b.{C} / a.{C} - 1) AS max_drawdown FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.i >= a.i WHERE a.{_IN} AND b.{_IN} GROUP BY a.symbol', keys="symbol", symbol="p_brand")
on_bars("h5_period_rate_risk", lambda b: finance.period_rate_risk(b, "month"), d("hpr", "ccr", "rate_mean", "rate_std"),
        f'''SELECT symbol, period, hpr, CASE WHEN days > 0 AND pow(1 + hpr, 365.0 / days) - 1 > -1 THEN ln(1 + (pow(1 + hpr, 365.0 / days) - 1)) END AS ccr, rate_mean, rate_std FROM (SELECT symbol, CAST(date_trunc('month', "Date") AS DATE) AS period, arg_max({C}, "Date") / nullif(arg_min({C}, "Date"), 0) - 1 AS hpr,
            date_diff('day', min("Date"), max("Date")) AS days, avg(r) AS rate_mean, stddev_samp(r) AS rate_std, count(*) AS n FROM (SELECT *, {C} / nullif({lag(C)}, 0) - 1 AS r FROM bars) GROUP BY 1, 2) WHERE n > 1''', keys="symbol, period", digits=3)

# --- ranking ---
on_bars("m2_return_features", ranking.return_features, d(*[f"{k}_{w}d" for w in (5, 20, 60) for k in ("ret", "logret")]),
        "SELECT *, " + ", ".join(f"{C} / nullif({lag(C, w)}, 0) - 1 AS ret_{w}d, ln({C} / nullif({lag(C, w)}, 0)) AS logret_{w}d" for w in (5, 20, 60)) + " FROM bars", symbol="p_brand")
on_bars("m3_range_features", ranking.range_features, d(*[f"pct_from_{w}d_{k}" for w in (60, 252) for k in ("high", "low")]),
        "SELECT *, " + ", ".join(f"CASE WHEN n_rows >= {w} AND i >= {w // 2} THEN {C} / {a}({C}) OVER {R(w)} - 1 END AS pct_from_{w}d_{k}" for w in (60, 252) for k, a in (("high", "max"), ("low", "min"))) + " FROM bars", symbol="p_brand")
_LR = f"ln({C} / nullif({lag(C)}, 0))"
on_bars("m4_realized_vol", ranking.realized_vol, d("vol_5d", "vol_20d", "vol_60d"),
        "SELECT *, " + ", ".join(f"CASE WHEN n_rows >= {w} AND count(lr) OVER {R(w)} >= {max(2, w // 2)} THEN stddev_samp(lr) OVER {R(w)} END AS vol_{w}d" for w in (5, 20, 60)) + f" FROM (SELECT *, {_LR} AS lr FROM bars)", symbol="p_brand")
on_bars("m5_volume_features", ranking.volume_features, d("vol_ma_ratio_5d", "vol_ma_ratio_20d", "vol_zscore_5d", "vol_zscore_20d", "vol_ret_corr_20d"),
        "SELECT *, " + ", ".join(f"CASE WHEN n_rows >= {w} AND i >= {max(2, w // 2)} THEN {V} / nullif(avg({V}) OVER {R(w)}, 0) END AS vol_ma_ratio_{w}d, CASE WHEN n_rows >= {w} AND i >= {max(2, w // 2)} THEN ({V} - avg({V}) OVER {R(w)}) / nullif(stddev_samp({V}) OVER {R(w)}, 0) END AS vol_zscore_{w}d" for w in (5, 20))
        + f", CASE WHEN count(lr) OVER {R(20)} >= 20 THEN corr({V}, lr) OVER {R(20)} END AS vol_ret_corr_20d FROM (SELECT *, abs({_LR}) AS lr FROM bars)", symbol="p_brand")


def _against_first(b: DataFrame) -> DataFrame:
    return ranking.relative_strength(b, b.filter("symbol = 'STANDARD'"))


on_bars("m6_relative_strength", _against_first, d("rel_strength_5d", "rel_strength_20d", "rel_strength_60d", "beta_60d"),
        f'''SELECT *, CASE WHEN count(s) OVER {R(60)} >= 60 THEN covar_samp(s, bb) OVER {R(60)} / nullif(var_samp(bb) OVER {R(60)}, 0) END AS beta_60d FROM (SELECT *, {", ".join(f"{C} / nullif({lag(C, w)}, 0) - bench / nullif({lag('bench', w)}, 0) AS rel_strength_{w}d" for w in (5, 20, 60))},
            {C} / nullif({lag(C)}, 0) - 1 AS s, bench / nullif({lag("bench")}, 0) - 1 AS bb FROM (SELECT b.*, x.{C} AS bench FROM bars b JOIN bars x ON x.symbol = 'STANDARD' AND x."Date" = b."Date"))''', digits=3)
on_bars("m7_calendar_features", ranking.calendar_features, d("dow", "month", "quarter", "is_month_end", "is_quarter_end"),
        'SELECT *, isodow("Date") - 1 AS dow, month("Date") AS month, quarter("Date") AS quarter, CASE WHEN last_day("Date") = "Date" THEN 1 ELSE 0 END AS is_month_end, CASE WHEN last_day("Date") = "Date" AND month("Date") % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end FROM bars')
on_bars("m10_forward_label", ranking.forward_label, d("fwd_ret") | {"label": "s"},
        f"SELECT *, CASE WHEN fwd_ret IS NULL THEN NULL WHEN fwd_ret > 0.02 THEN 2 WHEN fwd_ret < -0.02 THEN 0 ELSE 1 END AS label FROM (SELECT *, ln(lead({C}, 5) OVER {W} / {C}) AS fwd_ret FROM bars)", symbol="p_brand")
on_bars("m12_walk_forward", lambda b: ranking.walk_forward(b).select("fold", *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")]), dict.fromkeys(("fold", "train_start", "train_end", "test_start", "test_end"), "s"),
        '''WITH n AS (SELECT "Date", row_number() OVER (ORDER BY "Date") - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT "Date" FROM bars))
           SELECT CAST(a.k / 60 AS INTEGER) AS fold, CAST(a."Date" AS VARCHAR) AS train_start, CAST(b."Date" AS VARCHAR) AS train_end, CAST(e."Date" AS VARCHAR) AS test_start, CAST(f."Date" AS VARCHAR) AS test_end
           FROM n a JOIN n b ON b.k = a.k + 249 JOIN n e ON e.k = a.k + 250 JOIN n f ON f.k = a.k + 309 WHERE a.k % 60 = 0''', keys="")


def _scored(b: DataFrame) -> DataFrame:
    return ranking.forward_label(ranking.return_features(b, (20,)))


_SCORED = f'''SELECT *, {C} / nullif({lag(C, 20)}, 0) - 1 AS p, ln(lead({C}, 5) OVER {W} / {C}) AS f FROM bars'''
_IC = f'''WITH s AS (SELECT * FROM ({_SCORED}) WHERE p IS NOT NULL AND f IS NOT NULL), r AS (SELECT "Date", rank() OVER (PARTITION BY "Date" ORDER BY p) + (count(*) OVER (PARTITION BY "Date", p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY "Date" ORDER BY f) + (count(*) OVER (PARTITION BY "Date", f) - 1) / 2.0 AS rf FROM s)
          SELECT "Date", count(*) AS n, CASE WHEN min(rp) < max(rp) AND min(rf) < max(rf) THEN round(corr(rp, rf), 12) END AS ic FROM r GROUP BY "Date" HAVING count(*) >= 5'''
on_bars("m18_ic_by_date", lambda b: ranking.ic_by_date(_scored(b), "ret_20d", "fwd_ret"), {"n": "s", "ic": "d"}, _IC, keys="Date", symbol="p_brand")
on_bars("m18_ic_summary", lambda b: ranking.ic_summary(ranking.ic_by_date(_scored(b), "ret_20d", "fwd_ret")), {"n_dates": "s"} | d("ic_mean", "ic_std", "positive_share"),
        f"SELECT count(ic) AS n_dates, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END) AS positive_share FROM ({_IC})", keys="", symbol="p_brand")
on_bars("m20_layered_by_date", lambda b: ranking.layered_by_date(_scored(b), "ret_20d", "fwd_ret"), {"layer": "s", "n_dates": "s", "mean_ret": "d"},
        f'''WITH s AS (SELECT "Date", symbol, f, row_number() OVER (PARTITION BY "Date" ORDER BY p, symbol) AS r, count(*) OVER (PARTITION BY "Date") AS n FROM ({_SCORED}) WHERE p IS NOT NULL AND f IS NOT NULL)
            SELECT layer, count(*) AS n_dates, avg(m) AS mean_ret FROM (SELECT "Date", CAST(greatest(((r - 1) * 5 + n - 2) // (n - 1), 1) - 1 AS INTEGER) AS layer, avg(f) AS m FROM s WHERE n > 1 GROUP BY 1, 2) GROUP BY layer''', keys="", symbol="p_brand")
on_bars("m21_oos_tail", lambda b: ranking.oos_tail(b, 20), d("Close"), "SELECT * FROM bars WHERE i > n_rows - 20", symbol="p_brand")


# --- trading ---
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), F.try_divide("l_extendedprice", "l_quantity").alias("price"))


_register("k6_order_ledger", lambda s, p: rounded(trading.order_ledger(_orders(s, p), 1000.0), 2),
          """SELECT o_custkey AS account, l_suppkey AS symbol, round(1000 + sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice - 3 ELSE -(l_extendedprice + 3) END) + 0.0012371, 2) + 0.0 AS cash,
             round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) + 0.0012371, 2) + 0.0 AS position FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")


def _backtested(b: DataFrame, **stops: float) -> DataFrame:
    crossed = series.crossover(b.withColumns({"fast": series.rolling("Close", 5, full=False), "slow": series.rolling("Close", 20, full=False)}), "fast", "slow", "signal")
    return trading.backtest(crossed, 1_000_000.0, **stops)


_SIG = f'''SELECT *, CASE WHEN (f <= 0 AND p > 0) OR (f < 0 AND p >= 0) THEN 's' WHEN (f >= 0 AND p < 0) OR (f > 0 AND p <= 0) THEN 'b' ELSE 'n' END AS signal FROM (SELECT *, lag(f) OVER {W} AS p FROM (SELECT *, avg({C}) OVER {R(5)} - avg({C}) OVER {R(20)} AS f FROM bars))'''


def _backtest_sql(stopped: str) -> str:
    """Cash, stock and the price of the last b, bar by bar; stopped: when the holding return h sells."""
    return f'''WITH RECURSIVE g AS ({_SIG}), rec(symbol, i, e, money, stock, paid) AS (
        SELECT symbol, 0, 'n', 1000000.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE FROM g WHERE i = 1 UNION ALL
        SELECT symbol, i, e, CASE WHEN e = 'b' AND n > 0 THEN money - n * c - 3 WHEN e = 's' AND stock * c > 3 THEN money + stock * c - 3 ELSE money END,
               CASE WHEN e = 'b' AND n > 0 THEN stock + CAST(n AS BIGINT) WHEN e = 's' AND stock * c > 3 THEN 0 ELSE stock END, CASE e WHEN 'b' THEN c WHEN 's' THEN 0.0 ELSE paid END
        FROM (SELECT *, floor((money - 3) / c) AS n, CASE WHEN stock > 0 AND ({stopped}) THEN 's' ELSE signal END AS e
              FROM (SELECT g.symbol, g.i, g.signal, g.{C} AS c, rec.money, rec.stock, rec.paid, CASE WHEN rec.paid > 0 THEN (g.{C} - rec.paid) / rec.paid ELSE 1e300 END AS h FROM rec JOIN g ON g.symbol = rec.symbol AND g.i = rec.i + 1)))
        SELECT g.symbol, g."Date", e AS signal, money, stock, money + stock * {C} AS value FROM g JOIN rec USING (symbol, i)'''


on_bars("k1_backtest", _backtested, {"signal": "s", "money": "d", "stock": "s", "value": "d"}, _backtest_sql("false"), digits=2)
on_bars("k1_backtest_stops", lambda b: _backtested(b, stop_profit=0.2, stop_loss=-0.1), {"signal": "s", "money": "d", "stock": "s", "value": "d"}, _backtest_sql("h >= 0.2 OR h <= -0.1"), digits=2)


def _latest_ranked(b: DataFrame) -> DataFrame:
    """The nightly report: rates, bands, crossing and streak of every symbol's newest bar, ranked."""
    b = panel.change_rate(indicators.bollinger(b))
    b = series.crossover(b.withColumns({"fast": series.rolling("Close", 5, full=False), "slow": series.rolling("Close", 20, full=False), "dir": F.signum(F.col("Close") - panel.lag("Close"))}), "fast", "slow", "signal")
    latest = panel.latest_per_symbol(series.streak(b, "dir", "days"))
    return latest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "symbol")))


on_bars("latest_ranked", _latest_ranked, d("Close", "rate", "bb_high", "bb_low") | {"signal": "s", "place": "s"},
        f'''SELECT *, row_number() OVER (ORDER BY rate DESC, symbol) AS place FROM (SELECT *, {C} / nullif({lag(C)}, 0) - 1 AS rate, CASE WHEN i >= 20 THEN avg({C}) OVER {R(20)} + 2 * stddev_pop({C}) OVER {R(20)} END AS bb_high, CASE WHEN i >= 20 THEN avg({C}) OVER {R(20)} - 2 * stddev_pop({C}) OVER {R(20)} END AS bb_low FROM ({_SIG})) WHERE i = n_rows''', symbol="p_brand")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from marketloom.plans import desk, market, rules  # noqa: E402, F401, I001  register their queries with the functions above
from marketloom.plans import columns  # noqa: E402, F401  shows columns of the others' queries
