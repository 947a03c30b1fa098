"""Queries of stored bars, portfolios, candles, evaluation and streams; plans.registry collects them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import panel
from marketloom.operators import candles, evaluation, portfolio, ranking, trading
from marketloom.plans import registry as R
from marketloom.plans.registry import ALL, C, H, L, RUN, V, W, d, lag, on_bars, rounded
from marketloom.sources import history
from marketloom.sources.files import shared_path
from marketloom.streaming import quotes as streams

OHLCV = ("Open", "High", "Low", "Close", "Volume")
O = '"Open"'  # noqa: E741


def day(text: str) -> F.Column:
    return F.to_date(F.lit(text))


# --- stored bars ---
def _vendor(b: DataFrame) -> DataFrame:
    """Vendor rows: short names, and a second, later row on days of odd volume."""
    rows = b.select("symbol", F.col("Date").alias("d"), F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"), F.col("Close").alias("c"), F.col("Volume").alias("v"), F.lit(1).alias("seq"))
    return rows.unionByName(rows.filter("v % 2 = 1").withColumns({"c": F.col("c") + 1, "seq": F.lit(2)}))


on_bars("a3_normalize_quotes", lambda b: history.normalize_quotes(_vendor(b), {"d": "Date", "o": "Open", "h": "High", "l": "Low", "c": "Close", "v": "Volume"}, "seq"), d("Close", "AdjClose", "Dividend", "Split"),
        f"SELECT *, c AS AdjClose, 0 AS Dividend, 1 AS Split FROM (SELECT symbol, \"Date\", {C} + CASE WHEN {V} % 2 = 1 THEN 1 ELSE 0 END AS c, {C} + CASE WHEN {V} % 2 = 1 THEN 1 ELSE 0 END AS \"Close\" FROM bars)")
on_bars("a4_attach_actions", lambda b: history.attach_actions(b, b.filter("day(Date) = 15").select("symbol", "Date", (F.col("Close") / 100).alias("value")), b.filter("day(Date) = 1").select("symbol", "Date", F.when(F.month("Date") == 2, "x").otherwise("3/2").alias("split"))), d("Dividend", "Split"),
        f'SELECT *, CASE WHEN day("Date") = 15 THEN {C} / 100 ELSE 0 END AS Dividend, CASE WHEN day("Date") = 1 AND month("Date") <> 2 THEN 1.5 ELSE 1 END AS Split FROM bars')
on_bars("a5_merge_history", lambda b: history.merge_history(b.filter(F.col("Date") < day("2000-01-01")), b.filter(F.col("Date") >= day("1999-06-01")).withColumn("Close", F.when(F.day("Date") != 9, F.col("Close") * 2))), d("Close", "Volume"),
        f'''SELECT symbol, "Date", {C} * CASE WHEN "Date" >= DATE '1999-06-01' THEN 2 ELSE 1 END AS "Close", "Volume" FROM bars WHERE "Date" < DATE '1999-06-01' OR day("Date") <> 9''', symbol="p_brand")


def _snapshot(b: DataFrame) -> DataFrame:
    last = panel.latest_per_symbol(b)
    return last.select("symbol", F.when(F.col("Volume") % 2 == 1, F.date_add("Date", 1)).otherwise(F.col("Date")).alias("Date"), (F.col("Close") * 1.01).alias("Close"), F.lit(None).cast("double").alias("Volume"))


on_bars("a6_overlay_realtime", lambda b: history.overlay_realtime(b, _snapshot(b)), d("Open", "Close", "Volume"),
        f'''SELECT symbol, "Date", {O}, CASE WHEN i = n_rows AND {V} % 2 = 0 THEN {C} * 1.01 ELSE {C} END AS "Close", {V} FROM bars
            UNION ALL SELECT symbol, "Date" + 1, NULL, {C} * 1.01, NULL FROM bars WHERE i = n_rows AND {V} % 2 = 1''', symbol="l_suppkey")
on_bars("a7_stale_symbols", lambda b: history.stale_symbols(b.filter("symbol <> 'Brand#11'"), b.select("symbol", F.lit("x").alias("market")).distinct(), history.market_dates(b, {"x": "Brand#12"}), "1998-01-01").select("symbol", F.col("last_date").cast("string").alias("last_date"), F.col("restart").cast("string").alias("restart")), {"last_date": "s", "restart": "s"},
        '''WITH m AS (SELECT max("Date") AS z FROM bars WHERE symbol = 'Brand#12'), l AS (SELECT symbol, CASE WHEN symbol <> 'Brand#11' THEN max("Date") END AS z FROM bars GROUP BY symbol)
           SELECT symbol, CAST(l.z AS VARCHAR) AS last_date, CAST(l.z - 3 AS VARCHAR) AS restart FROM l, m WHERE l.z IS NULL OR l.z < m.z''', keys="symbol", symbol="p_brand")
on_bars("a8_market_dates", lambda b: history.market_dates(b, {"x": "STANDARD", "y": "ECONOMY"}).select("market", F.col("market_date").cast("string").alias("market_date")), {"market": "s", "market_date": "s"},
        '''SELECT CASE symbol WHEN 'STANDARD' THEN 'x' ELSE 'y' END AS market, CAST(max("Date") AS VARCHAR) AS market_date FROM bars WHERE symbol IN ('STANDARD', 'ECONOMY') GROUP BY symbol''', keys="")
_CODES = "SELECT lpad(CAST(s_suppkey * 7919 % 999983 AS {text}), 6, '0') AS symbol FROM supplier UNION ALL SELECT lpad(CAST(s_suppkey AS {text}), 5, '0') FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT lower(n_name) || '1' FROM nation"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    text = s.select(F.lpad((F.col("s_suppkey") * 7919 % 999983).cast("string"), 6, "0").alias("symbol")).unionAll(s.select(F.lpad(F.col("s_suppkey").cast("string"), 5, "0")))
    return history.classify_symbols(text.unionAll(n.select("n_name")).unionAll(n.select(F.concat(F.lower("n_name"), F.lit("1")))))


R._register("a9_classify_symbols", _codes, f"""SELECT symbol, market, CASE market WHEN 'us' THEN upper(symbol) WHEN 'cn' THEN symbol || CASE WHEN symbol < '600000' THEN '.SHE' ELSE '.SHG' END WHEN 'hk' THEN symbol[2:] || '.HK' ELSE symbol END AS vendor_symbol FROM (
    SELECT symbol, CASE WHEN regexp_full_match(symbol, '[A-Za-z]+') THEN 'us' WHEN regexp_full_match(symbol, '[0-9]+') THEN CASE length(symbol) WHEN 6 THEN 'cn' WHEN 5 THEN 'hk' ELSE 'other' END ELSE 'other' END AS market FROM ({_CODES.format(text='VARCHAR')}))""")


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.to_json(F.collect_list("n_name")).alias("l"))
    text = F.concat(F.lit('{"'), F.col("r_name"), F.lit('": '), F.col("l"), F.lit(', "updated": "2024-01-01"}'))
    return history.explode_pools(rows.select(text.alias("pools")))


R._register("a10_explode_pools", _pools, "SELECT r_name AS pool, n_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles: each page holds a customer's, and every page comes twice."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    null = F.lit(None).cast("string")
    doc = F.struct(F.col("o_orderkey").cast("string").alias("_id"), F.struct(F.col("o_orderstatus").alias("main")).alias("headline"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"), F.col("o_orderpriority").alias("news_desk"),
                   null.alias("section_name"), null.alias("snippet"), null.alias("lead_paragraph"), F.concat(F.lit("x/"), F.col("o_orderkey").cast("string")).alias("web_url"), F.col("o_custkey").cast("long").alias("word_count"))
    pages = o.groupBy("o_custkey", F.pmod("o_orderkey", F.lit(64))).agg(F.to_json(F.struct(F.struct(F.collect_list(doc).alias("docs")).alias("response"))).alias("page")).select("page")
    out = history.flatten_news(pages.unionAll(pages)).select("_id", "title", F.col("pub_date").cast("date").cast("string").alias("pub_date"), "desk", "url", "word_count")
    return out.withColumnRenamed("_id", "id")


R._register("a11_flatten_news", _news, "SELECT CAST(o_orderkey AS VARCHAR) AS id, any_value(o_orderstatus) AS title, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS pub_date, any_value(o_orderpriority) AS desk, 'x/' || o_orderkey AS url, any_value(o_custkey) AS word_count FROM orders GROUP BY o_orderkey")
on_bars("p4_clean_bars", lambda b: panel.clean_bars(b.withColumns({"AdjClose": F.when(F.day("Date") != 9, F.col("Close")), "Split": F.lit(None).cast("double"), "Dividend": F.lit(None).cast("double"), "Volume": F.when(F.col("Volume") % 2 == 1, 0.0).otherwise(F.col("Volume"))})), d("Close", "Split"),
        f'''WITH n AS (SELECT *, max("Date") OVER {ALL} AS z FROM bars), f AS (SELECT *, max(CASE WHEN "Date" = z AND {V} % 2 = 1 THEN 1 ELSE 0 END) OVER {ALL} AS bad FROM n),
            k AS (SELECT *, max("Date") OVER {ALL} AS last FROM f WHERE day("Date") <> 9) SELECT *, 1.0 AS Split FROM k WHERE NOT (bad = 1 AND "Date" = last)''', symbol="p_brand")


# --- portfolios ---
on_bars("k2_benchmark_track", lambda b: portfolio.benchmark_track(b, "STANDARD", 1e6), {"stock": "s"} | d("money", "value"),
        f'''WITH x AS (SELECT *, floor((1e6 - 3) / first_value({C}) OVER {W}) AS k, first_value({C}) OVER {W} AS p FROM bars WHERE symbol = 'STANDARD')
            SELECT *, CAST(CASE WHEN i < n_rows THEN k ELSE 0 END AS BIGINT) AS stock, CASE WHEN i < n_rows THEN 1e6 - k * p - 3 ELSE 1e6 - k * p - 3 + k * {C} - 3 END AS money, CASE WHEN i < n_rows THEN 1e6 - k * p - 3 + k * {C} ELSE 1e6 - k * p - 3 + k * {C} - 3 END AS value FROM x''', digits=2)
_worth = lambda b: b.select("symbol", "Date", F.col("Close").alias("value"))
on_bars("k3_portfolio_value", lambda b: portfolio.portfolio_value(_worth(b), b.filter("symbol = '1'")), d("value"),
        f'''WITH k AS (SELECT DISTINCT "Date" FROM bars WHERE symbol = '1'), s AS (SELECT DISTINCT symbol FROM bars),
            g AS (SELECT k."Date", symbol, (SELECT arg_min({C}, b."Date") FROM bars b WHERE b.symbol = s.symbol AND b."Date" >= k."Date") AS v FROM k, s) SELECT "Date", sum(coalesce(v, 0)) AS value FROM g GROUP BY "Date"''', keys="Date", symbol="l_suppkey", digits=2)
_SPAN = f'''SELECT symbol, min("Date") AS a, max("Date") AS z, date_diff('day', min("Date"), max("Date")) AS days, arg_min({C}, "Date") AS start_money, arg_max({C}, "Date") AS end_money, var_samp(r) AS v FROM (SELECT *, {C} / {lag(C)} - 1 AS r FROM bars) GROUP BY symbol'''
on_bars("k4_backtest_report", lambda b: portfolio.backtest_report(_worth(b)), d("start_money", "end_money", "profit", "hpr", "ear", "sharpe", "max_drawdown") | {"place": "s"},
        f'''WITH e AS (SELECT *, pow(end_money / start_money, 365.0 / days) - 1 AS ear, sqrt(v * 365.0 / (days - 1)) AS vol FROM ({_SPAN})), dd AS (SELECT a.symbol, min(b.{C} / a.{C} - 1) AS max_drawdown FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.i >= a.i GROUP BY a.symbol),
            u AS (SELECT symbol, start_money, end_money, ear, (ear - 0.04) / vol AS sharpe, max_drawdown FROM e JOIN dd USING (symbol) UNION ALL SELECT 'mean', avg(start_money), avg(end_money), NULL, NULL, NULL FROM e UNION ALL SELECT 'total', sum(start_money), sum(end_money), NULL, NULL, NULL FROM e)
            SELECT *, end_money - start_money AS profit, end_money / start_money - 1 AS hpr, row_number() OVER (ORDER BY symbol IN ('mean', 'total'), ear DESC, symbol) AS place FROM u''', keys="symbol", symbol="p_brand", digits=3)
on_bars("k5_coverage_plan", lambda b: portfolio.coverage_plan(b.filter("symbol <> '3'"), b, "1995-03-01", "2001-06-01"), {"plan": "s"},
        '''SELECT symbol, CASE WHEN symbol <> '3' AND min("Date") <= DATE '1995-03-01' AND max("Date") >= DATE '2001-06-01' THEN 'cut' ELSE 'trend' END AS plan FROM bars GROUP BY symbol''', keys="symbol", symbol="l_suppkey")


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's ledger of all accounts against a broker that knows half of the suppliers, a third of them otherwise."""
    ledger = trading.order_ledger(R._orders(spark, sf_dir).withColumn("account", F.lit("a")), 1000.0)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("symbol"))
    broker = ledger.filter("symbol % 2 = 0").select("symbol", (F.col("position") + F.when(F.col("symbol") % 3 == 0, 5.0).otherwise(0.0)).alias("quantity"))
    return rounded(portfolio.reconcile(ledger.drop("account"), broker, s, 1000.0), 2)


R._register("k7_reconcile", _reconciled,
            """WITH l AS (SELECT l_suppkey AS symbol, 1000 + sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice - 3 ELSE -(l_extendedprice + 3) END) AS cash, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
               x AS (SELECT s_suppkey AS symbol, coalesce(cash, 1000) AS cash, coalesce(p, 0) AS p, CASE WHEN p IS NOT NULL AND s_suppkey % 2 = 0 THEN p + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END ELSE 0 END AS q FROM supplier LEFT JOIN l ON symbol = s_suppkey)
               SELECT symbol, round(CASE WHEN p = q THEN cash WHEN q > 0 THEN 0 ELSE 1000 END + 0.0012371::DOUBLE, 2) + 0.0 AS cash, round(CASE WHEN p = q THEN p WHEN q > 0 THEN q ELSE 0 END + 0.0012371::DOUBLE, 2) + 0.0 AS position, p <> q AS conflict FROM x""")
_held = lambda b: b.withColumns({"rate": F.col("Close") / F.col("Open") - 1, "rate_inday": F.col("High") / F.col("Low") - 1})
on_bars("k9_stop_orders", lambda b: portfolio.stop_orders(_held(b), -0.9, 3.0, None, 40.0), d("rate", "rate_inday"),
        f"SELECT * FROM (SELECT *, {C} / {O} - 1 AS rate, {H} / {L} - 1 AS rate_inday FROM bars) WHERE rate < -0.9 OR rate > 3 OR rate_inday > 40")
#: Conditions as people store them: by the day of the month, one for each; the last two are refused.
_CONDITIONS = ["price > 5000", "quantity < 30 and price < 900", "not (price > 1000 or quantity >= 20)", "100 < price * 2 - quantity < 400", "symbol in ['PROMO', 'SMALL'] & (rate != 0)",
               "price.apply(exit)", "price > 0; drop"]


def _conditioned(b: DataFrame) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t in _CONDITIONS]), F.day("Date") % len(_CONDITIONS) + 1)
    rate = F.when(F.day("Date") < 25, F.col("Close") / F.col("Open") - 1)
    return portfolio.condition_orders(b.select("symbol", "Date", F.col("Close").alias("price"), F.col("Volume").alias("quantity"), rate.alias("rate"), text.alias("condition")))


on_bars("k11_condition_orders", _conditioned, d("price", "quantity"),
        f'''SELECT symbol, "Date", {C} AS price, {V} AS quantity FROM bars WHERE CASE day("Date") % 7 WHEN 0 THEN {C} > 5000 WHEN 1 THEN {V} < 30 AND {C} < 900 WHEN 2 THEN {C} <= 1000 AND {V} < 20
            WHEN 3 THEN {C} * 2 - {V} > 100 AND {C} * 2 - {V} < 400 WHEN 4 THEN symbol IN ('PROMO', 'SMALL') AND (day("Date") >= 25 OR {C} <> {O}) ELSE false END''')
on_bars("k12_portfolio_levels", lambda b: portfolio.portfolio_levels(b.select(F.concat(F.lit("US."), "symbol").alias("symbol"), "Date", F.col("Open").alias("latest_price")), panel.latest_per_symbol(b.withColumns({"supporter": F.min("Close").over(panel.rows(20)), "resistanter": F.max("Close").over(panel.rows(20))})).filter("symbol <> 'PROMO'")), d("latest_price", "supporter", "resistanter") | {"alert": "s"},
        f'''WITH l AS (SELECT * FROM (SELECT *, min({C}) OVER {R.R(20)} AS lo, max({C}) OVER {R.R(20)} AS hi FROM bars) WHERE i = n_rows AND symbol <> 'PROMO')
            SELECT 'US.' || b.symbol AS symbol, b."Date", coalesce(l.{C}, b.{O}) AS latest_price, lo AS supporter, hi AS resistanter, CASE WHEN l.{C} <= lo THEN 'support' WHEN l.{C} >= hi THEN 'resistant' END AS alert FROM bars b LEFT JOIN l ON l.symbol = b.symbol''')


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    held = o.select(F.lit("p").alias("platform"), F.col("o_custkey").alias("account"), F.col("o_totalprice").alias("market_value"))
    return rounded(portfolio.account_totals(held, c.select(F.lit("p").alias("platform"), F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))), 2)


R._register("k13_account_totals", _accounts, """SELECT 'p' AS platform, c_custkey AS account, round(any_value(c_acctbal) + 0.0012371::DOUBLE, 2) + 0.0 AS cash, round(coalesce(sum(o_totalprice), 0) + 0.0012371::DOUBLE, 2) + 0.0 AS market_value, count(o_custkey) AS n_positions,
    round(coalesce(sum(o_totalprice), 0) + any_value(c_acctbal) + 0.0012371::DOUBLE, 2) + 0.0 AS net_value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")

# --- candles ---
_BODY = f"greatest({O}, {C}) AS bt, least({O}, {C}) AS bb, CAST(sign({C} - {O}) AS INTEGER) AS k"
on_bars("d1_candle_place", candles.candle_place, {"place": "s", "place_score": "d"},
        f'''WITH s AS (SELECT symbol, "Date", {_BODY} FROM bars), p AS (SELECT *, lag(bt) OVER {W} AS pt, lag(bb) OVER {W} AS pb, lag(k) OVER {W} AS pk FROM s),
            q AS (SELECT *, CASE WHEN pt IS NULL THEN '' WHEN bt <= pb THEN 'down' WHEN bb >= pt AND NOT (bt <= pt AND bb >= pb) THEN 'up' WHEN bt > pt AND bb < pb THEN 'out' WHEN bt <= pt AND bb >= pb THEN 'mid' WHEN bt > pt THEN 'mid_up' ELSE 'mid_down' END AS place FROM p)
            SELECT *, CASE WHEN place IN ('up', 'down', 'out') THEN coalesce(map {{'1up': 0.99, '1down': -0.33, '1out': 0.66, '-1down': -0.99, '-1up': 0.33, '-1out': -0.66}}[k || place], 0)
              ELSE coalesce(map {{'1 1 mid_down': -0.33, '1 1 mid_up': 0.33, '-1 1 mid_down': 0.33, '-1 1 mid': 0.33, '-1 1 mid_up': 0.66, '-1 -1 mid_up': 0.33, '-1 -1 mid_down': -0.33, '1 -1 mid_up': -0.33, '1 -1 mid': -0.33, '1 -1 mid_down': -0.66}}[pk || ' ' || k || ' ' || place], 0) END AS place_score FROM q''')
_FILL = lambda x: f"last_value({x} IGNORE NULLS) OVER {RUN}"
on_bars("d2_candle_gap", candles.candle_gap, d("gap", "gap_color", "gap_top", "gap_bottom", "gap_distance"),
        f'''WITH g AS (SELECT *, {lag(H)} AS ph, {lag(L)} AS pl FROM bars), m AS (SELECT symbol, avg({L} - ph) FILTER ({L} > ph) AS mu, avg(pl - {H}) FILTER (pl > {H}) AS md FROM g GROUP BY symbol),
            x AS (SELECT g.*, {L} > ph AND {L} - ph >= mu AS su, pl > {H} AND pl - {H} >= md AS sd FROM g JOIN m USING (symbol)), r AS (SELECT symbol, count(*) FILTER (su) / count(*) < 0.05 AS ru, count(*) FILTER (sd) / count(*) < 0.05 AS rd FROM x GROUP BY symbol),
            y AS (SELECT x.*, CASE WHEN su AND ru THEN 2 WHEN sd AND rd THEN -2 WHEN {L} > ph THEN 1 WHEN pl > {H} THEN -1 ELSE 0 END AS gap FROM x JOIN r USING (symbol)),
            z AS (SELECT *, CASE gap WHEN 2 THEN {L} WHEN -2 THEN pl END AS t, CASE gap WHEN 2 THEN ph WHEN -2 THEN {H} END AS b, CASE gap WHEN 2 THEN 1 WHEN -2 THEN -1 END AS k FROM y)
            SELECT *, coalesce({_FILL("k")}, 0) AS gap_color, {_FILL("t")} AS gap_top, {_FILL("b")} AS gap_bottom, ({_FILL("t")} - {_FILL("b")}) * coalesce({_FILL("k")}, 0) AS gap_distance FROM z''', symbol="l_suppkey")
on_bars("d4_body_size", lambda b: candles.long_shadow(candles.body_size_class(b)), d("body_diff", "shadow_diff") | dict.fromkeys(("shadow_trend", "entity_trend", "long_shadow"), "s"),
        f'''WITH s AS (SELECT *, {H} - {L} AS sh, abs({C} - {O}) AS bo FROM bars), t AS (SELECT *, bo / nullif(sh, 0) AS pct, ({H} - greatest({O}, {C})) / nullif(sh, 0) AS us, (least({O}, {C}) - {L}) / nullif(sh, 0) AS ls, bo / nullif({R.roll("avg", "bo", 30)}, 0) - 1 AS body_diff, sh / nullif({R.roll("avg", "sh", 30)}, 0) - 1 AS shadow_diff FROM s),
            u AS (SELECT *, CASE WHEN shadow_diff <= -0.5 THEN 'd' WHEN shadow_diff >= 1 THEN 'u' ELSE 'n' END AS shadow_trend FROM t)
            SELECT *, CASE WHEN body_diff <= -0.5 THEN 'd' WHEN body_diff >= 1.5 OR (body_diff >= 1 AND shadow_trend = 'u' AND pct >= 0.8) THEN 'u' ELSE 'n' END AS entity_trend, CASE WHEN shadow_diff > 0.25 AND ls > 0.5 THEN 'u' WHEN shadow_diff > 0.25 AND us > 0.5 THEN 'd' ELSE 'n' END AS long_shadow FROM u''')

# --- evaluation ---
on_bars("m9_feature_summary", lambda b: evaluation.feature_summary(ranking.return_features(b, (5, 20)), ["Volume", "ret_5d", "logret_20d"]).select("feature", "nulls", "total", F.when(F.col("feature") == "Volume", F.col("n_distinct")).alias("n_distinct")), dict.fromkeys(("feature", "nulls", "total", "n_distinct"), "s"),
        f'''WITH x AS (SELECT *, {lag(C, 5)} AS a, {lag(C, 20)} AS b FROM bars) SELECT 'Volume' AS feature, count(*) - count({V}) AS nulls, count(*) AS total, count(DISTINCT {V}) AS n_distinct FROM x UNION ALL SELECT 'ret_5d', count(*) - count(a), count(*), NULL FROM x UNION ALL SELECT 'logret_20d', count(*) - count(b), count(*), NULL FROM x''', keys="", symbol="p_brand")


def _sketched(b: DataFrame) -> DataFrame:
    """Sketches beside what is counted exactly: whether each number lies within its bound."""
    rows = ranking.return_features(b, (5, 20))
    sketch = evaluation.feature_sketch(rows, ["Volume", "Close", "ret_5d", "symbol"])
    exact = evaluation.feature_summary(rows, ["Volume", "Close", "ret_5d", "symbol"]).select("feature", F.col("n_distinct").alias("exact"))
    out = sketch.join(exact, "feature").withColumn("distinct_ok", F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.1))
    return out.select("feature", "nulls", "total", "distinct_ok", F.col("quantiles")[1].alias("median"))


on_bars("m9_feature_sketch", lambda b: _sketched(b).withColumn("median", F.when(F.col("feature") == "Volume", F.col("median"))), dict.fromkeys(("feature", "nulls", "total", "distinct_ok"), "s") | d("median"),
        f'''WITH x AS (SELECT *, {lag(C, 5)} AS a FROM bars), n AS (SELECT count(*) AS t FROM x)
            SELECT 'Volume' AS feature, 0 AS nulls, t AS total, true AS distinct_ok, (SELECT quantile_disc({V}, 0.5) FROM x) AS median FROM n UNION ALL SELECT 'Close', 0, t, true, NULL FROM n
            UNION ALL SELECT 'ret_5d', (SELECT count(*) - count(a) FROM x), t, true, NULL FROM n UNION ALL SELECT 'symbol', 0, t, true, NULL FROM n''', keys="", symbol="p_brand")
_coded = lambda b: b.withColumns({"name": F.when(F.col("symbol").endswith("2"), "xST").otherwise("y"), "symbol": F.concat(F.when(F.col("symbol").endswith("1"), "300").otherwise("600"), "symbol")})
on_bars("m11_limit_filter", lambda b: ranking_limit(b), d("Close"),
        f'''WITH x AS (SELECT *, abs({C} / {lag(C)} - 1) AS r, CASE WHEN symbol = 'Brand#13' THEN 0.5 WHEN symbol LIKE '%1' THEN 0.2 WHEN symbol LIKE '%2' THEN 0.05 ELSE 0.1 END AS lim FROM bars)
            SELECT CASE WHEN symbol LIKE '%1' THEN '300' ELSE '600' END || symbol AS symbol, "Date", {C} FROM x WHERE r IS NULL OR r < lim - 0.001''', symbol="p_brand")


def ranking_limit(b: DataFrame) -> DataFrame:
    own = b.filter("symbol = 'Brand#13'").select(F.lit("600Brand#13").alias("symbol"), F.lit(0.5).alias("limit")).distinct()
    return evaluation.limit_filter(_coded(b), overrides=own)


def _aligned(b: DataFrame) -> DataFrame:
    return evaluation.align_xy(ranking.return_features(b, (20, 60)), ranking.forward_label(b), ["ret_20d", "ret_60d"])


on_bars("m13_align_xy", _aligned, d("ret_20d", "ret_60d") | {"label": "s"},
        f'''SELECT *, CASE WHEN f > 0.02 THEN 2 WHEN f < -0.02 THEN 0 ELSE 1 END AS label FROM (SELECT *, {C} / {lag(C, 20)} - 1 AS ret_20d, {C} / {lag(C, 60)} - 1 AS ret_60d, ln(lead({C}, 5) OVER {W} / {C}) AS f FROM bars) WHERE f IS NOT NULL AND ret_60d IS NOT NULL''', symbol="p_brand")
on_bars("m14_diagnose_pool", lambda b: evaluation.diagnose_pool(b, _aligned(b), b, 20, 500), dict.fromkeys(("raw_rows", "aligned_rows", "reason"), "s"),
        '''SELECT symbol, n AS raw_rows, CASE WHEN n < 20 THEN 0 ELSE greatest(n - 65, 0) END AS aligned_rows, CASE WHEN n < 20 THEN 'raw rows < min_history(20)' WHEN n <= 65 THEN 'no rows after features+align' WHEN n - 65 < 500 THEN 'aligned rows < train_window(500)' ELSE 'ok' END AS reason
           FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)''', keys="symbol", symbol="l_suppkey")
_RK = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
_S = f"SELECT * FROM ({R._SCORED}) WHERE p IS NOT NULL AND f IS NOT NULL"
on_bars("m17_ic_pooled", lambda b: evaluation.ic_pooled(R._scored(b), "ret_20d", "fwd_ret"), {"n": "s", "ic": "d"}, f"SELECT count(*) AS n, corr(a, b) AS ic FROM (SELECT {_RK('p')} AS a, {_RK('f')} AS b FROM ({_S}))", keys="", symbol="p_brand")
on_bars("m19_layered", lambda b: evaluation.layered(R._scored(b).withColumn("ret_20d", F.round("ret_20d", 3)), "ret_20d", "fwd_ret"), {"layer": "s", "n": "s", "mean": "d", "std": "d"},
        f'''WITH s AS (SELECT round(p, 3) AS p, f FROM ({_S})), q AS (SELECT list_distinct(quantile_cont(p, [0.2, 0.4, 0.6, 0.8])) AS e, min(p) AS lo FROM s)
            SELECT CAST(1 + len(list_filter(e, lambda x: x > lo AND x < p)) AS INTEGER) AS layer, count(*) AS n, avg(f) AS mean, stddev_samp(f) AS std FROM s, q GROUP BY 1''', keys="", symbol="p_brand", digits=3)
on_bars("m22_signal_win_rate", lambda b: evaluation.signal_win_rate(R._scored(b).withColumn("signal", F.when(F.col("ret_20d") > 1, "s").when(F.col("ret_20d") < -0.5, "b").otherwise("n"))), {"signal": "s", "n": "s", "hits": "s", "hit_rate": "d"},
        f'''SELECT signal, count(*) AS n, count(*) FILTER (ok) AS hits, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS hit_rate FROM (SELECT CASE WHEN p > 1 THEN 's' ELSE 'b' END AS signal, CASE WHEN p > 1 THEN f < 0 ELSE f > 0 END AS ok FROM ({_S}) WHERE p > 1 OR p < -0.5) GROUP BY signal''', keys="", symbol="p_brand")
_PR = lambda x: f"(rank() OVER (PARTITION BY \"Date\" ORDER BY {x}) + (count(*) OVER (PARTITION BY \"Date\", {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY \"Date\")"
on_bars("m23_score_comparison", lambda b: evaluation.score_comparison(R._scored(b), "ret_20d", "Volume", "fwd_ret"), d("ic_a", "ic_b", "ic_blend", "a_minus_b", "blend_minus_a"),
        f'''WITH s AS ({_S}), x AS (SELECT *, 0.5 * ({_PR('p')}) + 0.5 * ({_PR(V)}) AS m FROM s), r AS (SELECT {_RK('p')} AS a, {_RK(V)} AS b, {_RK('round(m, 12)')} AS c, {_RK('f')} AS t FROM x), k AS (SELECT corr(a, t) AS ic_a, corr(b, t) AS ic_b, corr(c, t) AS ic_blend FROM r)
            SELECT *, ic_a - ic_b AS a_minus_b, ic_blend - ic_a AS blend_minus_a FROM k''', keys="", symbol="p_brand")
on_bars("g15_signal_lists", lambda b: panel.latest_per_symbol(b.withColumn("signal", F.when(F.col("Close") > F.col("Open"), "b").otherwise("s"))).groupBy("signal").agg(F.array_join(F.sort_array(F.collect_list("symbol")), ", ").alias("symbols")), {"signal": "s", "symbols": "s"},
        f"SELECT CASE WHEN {C} > {O} THEN 'b' ELSE 's' END AS signal, string_agg(symbol, ', ' ORDER BY symbol) AS symbols FROM bars WHERE i = n_rows GROUP BY 1", keys="", symbol="p_brand")


# --- streams ---
def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream of quotes, written batch by batch into the shared folder and read back."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    quotes = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") + 1.0).alias("price"), F.lit(1.0).alias("quantity"))
    root = shared_path(spark, "streams")
    streams.write_updates(streams.stream_bars(quotes), f"{root}/bars", f"{root}/state").awaitTermination()
    return rounded(streams.newest_bars(spark.read.parquet(f"{root}/bars")).withColumnRenamed("start", "Date"))


R._register("s1_stream_bars", _streamed, f"""SELECT event_type AS symbol, CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS "Date", """ + ", ".join(f'round({x} + {R._shift(4)!r}::DOUBLE, 4) + 0.0 AS "{n}"' for n, x in (
    ("Open", "arg_min(value + 1.0, (ts, event_id))"), ("High", "max(value + 1.0)"), ("Low", "min(value + 1.0)"), ("Close", "arg_max(value + 1.0, (ts, event_id))"), ("Volume", "count(*)"))) + " FROM events GROUP BY 1, 2")
