"""Queries of columns that the other modules' queries do not show; plans.registry collects them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.operators import indicators, portfolio, ranking, recursive, trends
from marketloom.plans import market, nightly
from marketloom.plans import registry as R
from marketloom.plans.analysis import staged
from marketloom.plans.desk import O
from marketloom.plans.registry import _BODY, C, H, L, V, W, d, lag, on_bars, rounded


def s(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "s")


# --- bars ---
def _kept(keep: str) -> Callable[[SparkSession, str], DataFrame]:
    """The first or last trade of each part type and day."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
        trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 0").join(part, "l_partkey")
        trades = trades.withColumns({"Date": F.col("l_shipdate").cast("date"), "price": F.col("l_extendedprice") / F.col("l_quantity")})
        return rounded(panel.dedupe(trades, list(panel.ORDER), keep).select("symbol", "Date", "price", F.col("l_quantity").cast("double").alias("quantity")))

    return build


for _keep, _place in (("first", "a"), ("last", "z")):
    R._register(f"p1_dedupe_{_keep}", _kept(_keep), f"""WITH {R._BARS.format(symbol="p_type")} SELECT symbol, CAST("Date" AS VARCHAR) AS "Date", round(price + {R._shift(4)!r}::DOUBLE, 4) + 0.0 AS price,
        round(q + {R._shift(4)!r}::DOUBLE, 4) + 0.0 AS quantity FROM o WHERE {_place} = 1""")
on_bars("p8_heikin_ashi_replaced", lambda b: panel.heikin_ashi(b, replace=True), d("Open", "High", "Low", "Close"),
        f'SELECT symbol, "Date", H_Open AS "Open", H_High AS "High", H_Low AS "Low", H_Close AS "Close" FROM ({_BODY["p8_heikin_ashi"]})')
R._register("p11_zone_time", lambda spark, f: spark.read.parquet(f"{f}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).select(
    "event_id", *[F.date_format(panel.zone_time(c, zone, unit), "yyyy-MM-dd HH:mm:ss").alias(name) for name, c, zone, unit in (
        ("new_york", F.col("t"), "America/New_York", "us"), ("shanghai", F.col("t") / 1000, "Asia/Shanghai", "ms"))], panel.plus_days(F.timestamp_micros("t").cast("date"), -40).cast("string").alias("before")),
    "SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS new_york, strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shanghai, CAST(CAST(ts AS DATE) - 40 AS VARCHAR) AS before FROM events")

# --- series and indicators ---
on_bars("c12_exponential_averages", lambda b: recursive.exponential_averages(b, "Close", [5, 20]), d("Close_ma_5", "Close_ma_20"),
        f"WITH {R.ema_sql('bars', C, 2 / 6, 5, 'e5')}, {R.ema_sql('bars', C, 2 / 21, 20, 'e20')} SELECT bars.*, e5 AS Close_ma_5, e20 AS Close_ma_20 FROM bars JOIN e5_e USING (symbol, i) JOIN e20_e USING (symbol, i)", symbol="p_brand")
on_bars("b12_stc_signal", lambda b: indicators.stc_signal(recursive.recursive_block(b, ["stc"])), s("stc_signal"), f"SELECT *, CASE WHEN stc < 75 THEN 's' WHEN stc > 25 THEN 'b' ELSE 'n' END AS stc_signal FROM ({_BODY['b12_stc']})")
on_bars("b14_cloud", lambda b: trends.line_trend(indicators.candle_shape(indicators.ichimoku(b)), "ichimoku", "tankan", "kijun"), d("ichimoku_cloud_top", "ichimoku_cloud_bottom"),
        "SELECT *, CASE WHEN dist > 0 THEN t ELSE k END AS ichimoku_cloud_top, CASE WHEN dist > 0 THEN k ELSE t END AS ichimoku_cloud_bottom FROM (" + _BODY["b14_line_trend"] + ")")

#: Letters: indicator, its query, what is up, what is down, what stands for neither.
_LETTERS = [
    ("kst", indicators.kst, "b6_kst", "kst_diff > 0", "kst_diff <= 0", "NULL"), ("eom", indicators.eom, "b19_eom", "eom_diff > 0", "eom_diff <= 0", "NULL"),
    ("cci", lambda b: recursive.recursive_block(b, ["cci"]), "b3_cci", "cci_ma > 0", "cci_ma <= 0", "NULL"), ("fi", lambda b: recursive.recursive_block(b, ["force_index"]), "b20_force_index", "fi_ema > 0", "fi_ema <= 0", "NULL"),
    ("psar", lambda b: recursive.recursive_block(b, ["psar"]), "b11_psar", "psar_up > 0", "psar_down > 0", "''"),
    ("trix", lambda b: recursive.recursive_block(b, ["trix"]), "b9_trix", f"trix > lag(trix) OVER {W}", f"trix < lag(trix) OVER {W}", "'n'"),
]
for _name, _made, _of, _up, _down, _else in _LETTERS:
    on_bars(f"b16_{_name}_trend", lambda b, name=_name, made=_made: trends.simple_trends(made(b), [name]), s(f"{_name}_trend"), f"SELECT *, CASE WHEN {_down} THEN 'd' WHEN {_up} THEN 'u' ELSE {_else} END AS {_name}_trend FROM ({_BODY[_of]})")
on_bars("b16_aroon_trend", lambda b: trends.simple_trends(recursive.recursive_block(b, ["aroon"]), ["aroon"]), s("aroon_trend"),
        f'''WITH a AS (SELECT *, round(aroon_up, 1) AS u, round(aroon_down, 1) AS dn, round(aroon_up - aroon_down, 1) AS g FROM ({_BODY["b2_aroon"]})), m AS (SELECT *, u - {lag("u")} AS du, dn - {lag("dn")} AS dd, g - {lag("g")} AS dg FROM a)
            SELECT *, CASE WHEN abs(g) <= 32 AND (coalesce(dg = 0 AND du = dd AND dd < 0, false) OR coalesce(du < 0 AND dn <= 4, false) OR coalesce(dd < 0 AND u <= 4, false)) THEN 'n'
              WHEN dn >= 96 OR (dn >= 88 AND u <= 12) THEN 'd' WHEN u >= 96 OR (u >= 88 AND dn <= 12) THEN 'u' WHEN dd < 0 AND (du >= 0 OR dn > u) THEN 'u' WHEN du < 0 AND (dd >= 0 OR u > dn) THEN 'd' ELSE '' END AS aroon_trend FROM m''')

# --- patterns ---
on_bars("d5_window", lambda b: market._patterns(b).withColumnRenamed("window", "gap_window"), s("gap_window"), f"SELECT *, CASE gap WHEN 2 THEN 'u' WHEN -2 THEN 'd' ELSE 'n' END AS gap_window FROM ({_BODY['d2_candle_gap']})", symbol="l_suppkey")
_STEPS = ", ".join(f"lag({c}, {n}) OVER {W} AS p{n}_{x}" for c, n, x in (("bt", 1, "t"), ("bb", 1, "b"), ("us", 1, "us"), (H, 1, "h"), (L, 1, "l"), (C, 1, "c"), ("position", 1, "position"), ("size", 1, "size"), ("extreme", 1, "extreme"), ("bt", 2, "t"), ("bb", 2, "b"), ("k", 2, "k")))
_PLACED = f"""SELECT *, lag(place) OVER {W} AS p1_place FROM (SELECT *, CASE WHEN p1_t IS NULL THEN '' WHEN bt <= p1_b THEN 'down' WHEN bb < p1_b AND bt <= p1_t THEN 'mid_down' WHEN bb < p1_b THEN 'out' WHEN bt <= p1_t THEN 'mid' WHEN bb < p1_t THEN 'mid_up' ELSE 'up' END AS place,
    CASE WHEN pct < 0.05 OR (sd < -1 AND bd < -1) OR (pct < 0.15 AND (sd > 1.5 OR sd < -0.5 OR (sd < 0 AND bd < -0.5))) THEN 'x' ELSE 'n' END AS doji FROM (SELECT *, {_STEPS} FROM ({market._SIZED})))"""
on_bars("d6_flat_star", market._patterns, s("flat", "star"),
        f"""SELECT *, CASE WHEN doji = 'n' AND position = 'down' AND abs({L} - p1_l) / {C} <= 0.002 AND k = 1 THEN 'u'
              WHEN doji = 'n' AND position = 'up' AND (abs({H} - p1_h) / {C} <= 0.002 OR (abs({H} - p1_h) / {C} <= 0.004 AND {C} <= p1_c AND abs(us - p1_us) <= 0.05)) THEN 'd' ELSE 'n' END AS flat,
            CASE WHEN p1_place = 'up' AND place = 'down' AND position = 'up' AND (ki_distance = 'gg' OR p1_extreme = 'u') AND p1_position = 'up' AND p2_k = 1 AND k = -1 AND (size = 'u' OR bt + bb < p2_t + p2_b) AND p1_size <> 'u' THEN 'd'
              WHEN p1_place = 'down' AND place = 'up' AND position = 'down' AND (ki_distance = 'rr' OR p1_extreme = 'd') AND p1_position = 'down' AND k = 1 AND size <> 'd' AND (size = 'u' OR (bt + bb) * 0.5 > p2_t) AND p1_size <> 'u' AND p1_t < p2_b AND p1_t < bb THEN 'u' ELSE 'n' END AS star
            FROM ({_PLACED})""", symbol="l_suppkey")


# --- portfolios and layers ---
def _report(b: DataFrame) -> DataFrame:
    """Brand#11 as the benchmark, the closes of all brands together as the portfolio."""
    records = b.select("symbol", "Date", F.col("Close").alias("value"))
    whole = records.groupBy("Date").agg(F.sum("value").alias("value"))
    return portfolio.backtest_report(records, 0.04, whole, "Brand#11")


_ENDS = """SELECT symbol, min("Date") AS a, max("Date") AS z, date_diff('day', min("Date"), max("Date")) AS days, arg_min(v, "Date") AS start_money, arg_max(v, "Date") AS end_money, var_samp(r) AS var
    FROM (SELECT *, v / lag(v) OVER (PARTITION BY symbol ORDER BY "Date") - 1 AS r FROM x) GROUP BY symbol"""
on_bars("k4_report_rates", _report, d("start_money", "end_money", "profit", "hpr", "ear", "sharpe", "max_drawdown") | s("place"),
        f"""WITH x AS (SELECT symbol, "Date", {C} AS v FROM bars UNION ALL SELECT 'whole', "Date", sum({C}) FROM bars GROUP BY "Date"),
            e AS (SELECT *, pow(end_money / start_money, 365.0 / days) - 1 AS ear, sqrt(var * 365.0 / (days - 1)) AS vol FROM ({_ENDS})),
            t AS (SELECT symbol, min(v / top - 1) AS max_drawdown FROM (SELECT *, max(v) OVER (PARTITION BY symbol ORDER BY "Date" ROWS UNBOUNDED PRECEDING) AS top FROM x) GROUP BY symbol),
            r AS (SELECT symbol, start_money, end_money, ear, (ear - 0.04) / vol AS sharpe, max_drawdown FROM e JOIN t USING (symbol)),
            u AS (SELECT * FROM r WHERE symbol <> 'whole' UNION ALL SELECT n, CASE n WHEN 'mean' THEN a ELSE sa END, CASE n WHEN 'mean' THEN z ELSE sz END, w.ear, w.sharpe, w.max_drawdown FROM (VALUES ('mean'), ('total')) AS names(n),
              (SELECT avg(start_money) AS a, avg(end_money) AS z, sum(start_money) AS sa, sum(end_money) AS sz FROM r WHERE symbol NOT IN ('whole', 'Brand#11')), (SELECT * FROM r WHERE symbol = 'whole') w)
            SELECT *, end_money - start_money AS profit, end_money / start_money - 1 AS hpr, row_number() OVER (ORDER BY CASE WHEN symbol IN ('mean', 'total') THEN 2 WHEN symbol = 'Brand#11' THEN 1 ELSE 0 END, ear DESC, symbol) AS place FROM u""", keys="symbol", symbol="p_brand", digits=3)
on_bars("m20_layer_spread", lambda b: ranking.layer_spread(R._scored(b), "ret_20d", "fwd_ret"), d("top", "bottom", "spread"),
        f'''WITH s AS (SELECT "Date", symbol, f, row_number() OVER (PARTITION BY "Date" ORDER BY p, symbol) AS r, count(*) OVER (PARTITION BY "Date") AS n FROM ({R._SCORED}) WHERE p IS NOT NULL AND f IS NOT NULL),
            m AS (SELECT greatest(((r - 1) * 5 + n - 2) // (n - 1), 1) AS layer, avg(f) AS m FROM s WHERE n > 1 GROUP BY 1) SELECT arg_max(m, layer) AS top, arg_min(m, layer) AS bottom, arg_max(m, layer) - arg_min(m, layer) AS spread FROM m''', keys="", symbol="p_brand")

# --- nights from a state ---
_CUT = "2000-12-31"


def _night(b: DataFrame) -> DataFrame:
    """What two nights add to the state of all days before; the first takes a month, the second the rest."""
    day, cut = F.col("Date"), F.lit(_CUT).cast("date")
    state = staged(nightly.state_of(nightly.causal_features(b.filter(day <= cut))), "state")
    first = staged(nightly.night(state, b.filter((day > cut) & (day <= F.date_add(cut, 31)))), "night")
    state = staged(nightly.next_state(state, first), "state")
    return first.unionByName(nightly.night(state, b.filter(day > F.date_add(cut, 31))))


_AFTER = f"""WHERE "Date" > DATE '{_CUT}'"""
on_bars("g8_nightly_lines", _night, d("tankan_day", "kijun_day", "ichimoku_distance", "ichimoku_distance_change", "ichimoku_rate", "ichimoku_distance_day", "ichimoku_direction_day") | s("ichimoku_place"), f"SELECT * FROM ({_BODY['b14_line_trend']}) {_AFTER}")
on_bars("g8_nightly_adx", _night, d("pdi", "mdi", "adx_strength", "adx_value", "adx_value_prediction"), f"SELECT * FROM ({_BODY['b1_adx']}) {_AFTER}")
