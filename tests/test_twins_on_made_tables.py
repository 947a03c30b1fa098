"""Queries against their SQL twins on tables made to meet rules that the smallest tables never reach."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd

from marketloom.plans.registry import oracle_sql, queries

TIMES = "coerce_timestamps"


def twins(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the tables, both sorted, with columns in order of name."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(folder / f"{t}.parquet", **{TIMES: "us"})
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = queries()[name](spark, str(folder)).toPandas(), con.sql(oracle_sql()[name]).df()
    plain = lambda df: sorted(df[sorted(df.columns)].itertuples(index=False, name=None), key=str)
    return plain(got), plain(want), got


def trades(candles):
    """Tables part and lineitem with one bar a day: four trades of one piece for open, low, high and close."""
    lines = [(o, k) for o, candle in enumerate(candles) for k in enumerate(candle)]
    return {"part": pd.DataFrame({"p_partkey": [1], "p_type": ["A"], "p_brand": ["B"]}),
            "lineitem": pd.DataFrame({"l_orderkey": [o for o, _ in lines], "l_partkey": 1, "l_suppkey": 1, "l_linenumber": [k for _, (k, _) in lines], "l_quantity": 1.0,
                                      "l_extendedprice": [float(x) for _, (_, x) in lines], "l_shipdate": [dt.datetime(2024, 1, 1) + dt.timedelta(o) for o, _ in lines]})}


def test_single_candle_before_the_mean_range_is_full(spark, tmp_path):
    candles = [(100 + i, 100 + i, 100.5 + i, 100.5 + i) for i in range(45)]
    for i in (24, 39):
        candles[i] = (100 + i, 96 + i, 101 + i, 101 + i)  # a hammer at the top
    candles[27] = (100 + 27, 100 + 27, 105 + 27, 101 + 27)  # a meteor at the top
    got, want, rows = twins(spark, tmp_path, "d5_single_candle", **trades(candles))
    assert got == want
    days = lambda c: sorted(rows[rows[c] == "d"]["Date"])
    assert days("hammer") == ["2024-01-25", "2024-02-09"] and days("meteor") == ["2024-01-28"]


def test_single_candle_of_the_analysis_has_no_hammer_before_the_mean_range_is_full(spark, tmp_path):
    from marketloom.panel import trade_bars
    from marketloom.plans.market import _patterns

    candles = [(100 + i, 100 + i, 100.5 + i, 100.5 + i) for i in range(45)]
    for i in (24, 39):
        candles[i] = (100 + i, 96 + i, 101 + i, 101 + i)
    for t, rows in trades(candles).items():
        rows.to_parquet(tmp_path / f"{t}.parquet", **{TIMES: "us"})
    rows = _patterns(trade_bars(spark, str(tmp_path))).toPandas()
    assert [str(day) for day in rows[rows["hammer"] == "d"]["Date"]] == ["2024-02-09"]


def accounts(orders, balances):
    """Tables orders (key, account, status, price) and customer."""
    return {"orders": pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]), "customer": pd.DataFrame({"c_custkey": list(balances), "c_acctbal": list(balances.values())}, dtype=float).astype({"c_custkey": "int64"})}


def test_size_orders_where_a_share_divides_evenly(spark, tmp_path):
    """(5000 - 5) / 49.95 is 100; Python's // gives 99, for 49.95 is stored a little too large."""
    got, want, rows = twins(spark, tmp_path, "k10_size_orders", **accounts([(1, 1, "O", 4995.0), (2, 1, "O", 30000.0)], {1: 600.0}))
    assert got == want and rows.sort_values("symbol")["quantity"].tolist() == [100, 3]


def test_size_orders_without_a_known_balance(spark, tmp_path):
    got, want, rows = twins(spark, tmp_path, "k10_size_orders", **accounts([(1, 1, "O", 30000.0), (2, 2, "O", 30000.0), (3, 1, "F", 1.0)], {1: None, 2: 900.0}))
    assert got == want and rows["side"].tolist() == ["SELL", "BUY"]


def test_size_orders_of_accounts_over_many_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    keys = rng.permutation(900)
    orders = [(int(k), 0 if n < 300 else int(rng.integers(1, 60)), "OPF"[rng.integers(3)], round(float(rng.uniform(1000, 300000)), 2)) for n, k in enumerate(keys)]
    made = accounts(orders, {0: 1e6} | {k: round(float(rng.uniform(-900, 9000)), 2) for k in range(1, 60)})
    for size in (1, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got, want, rows = twins(spark, tmp_path, "k10_size_orders", **made)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and (rows["account"] == 0).sum() > 100 and rows["account"].nunique() > 50


def test_size_orders_calls_python_by_batches_not_by_account(spark, tmp_path):
    for t, rows in accounts([(1, 1, "O", 30000.0)], {1: 900.0}).items():
        rows.to_parquet(tmp_path / f"{t}.parquet")
    plan = queries()["k10_size_orders"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
