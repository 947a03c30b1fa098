"""Stored bars as CSV files and bucketed tables, sketches, and days by exchange."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import series
from marketloom.operators import evaluation
from marketloom.sources import history
from marketloom.streaming import quotes


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), *[float(i + k) for k in range(5)], 10.0 * i, 0.0, 1.0) for s in ("A", "B b", "0700.HK", "C#1+2%") for i in range(30)]
    return spark.createDataFrame(rows, "symbol string, " + history.BARS)


def test_csv_of_both_layouts(spark, bars, tmp_path):
    history.save_bars(bars, str(tmp_path / "saved"), "csv")
    for p in bars.toPandas().groupby("symbol"):
        (tmp_path / "plain").mkdir(exist_ok=True)
        p[1].drop(columns="symbol").to_csv(tmp_path / "plain" / f"{p[0]}.csv", index=False)
    want = sorted(map(tuple, bars.collect()))
    for folder in ("saved", "plain"):
        got = history.load_bars(spark, str(tmp_path / folder), "csv")
        assert sorted(map(tuple, got.select(bars.columns).collect())) == want
    assert got.rdd.getNumPartitions() < 30


def test_bucketed_bars_need_no_exchange(spark, bars):
    history.save_bar_table(bars, "bars_in_buckets", 4)
    table = history.load_bar_table(spark, "bars_in_buckets")
    assert sorted(map(tuple, table.select(bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    for df in (table.withColumn("m", series.rolling("Close", 5)), table.groupBy("symbol").agg(F.max("Date")), table.join(table.groupBy("symbol").agg(F.max("Close").alias("top")).hint("merge"), "symbol")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan


def test_sketches_keep_their_bounds(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=20000)
    df = spark.createDataFrame([(int(i % 3000), float(v) if i % 10 else None, datetime.date(2020, 1, 1) + datetime.timedelta(days=int(i % 100)), str(i % 7)) for i, v in enumerate(x)], "a long, b double, c date, d string").repartition(6)
    sketch = evaluation.feature_sketch(df, ["a", "b", "c", "d"], [0.1, 0.5, 0.9])
    plan = sketch._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in plan
    got = {r.feature: r for r in sketch.collect()}
    exact = {r.feature: r for r in evaluation.feature_summary(df, ["a", "b", "c", "d"]).collect()}
    for c, r in got.items():
        assert (r.nulls, r.total, r.dtype) == (exact[c].nulls, exact[c].total, exact[c].dtype)
        assert abs(r.n_distinct - exact[c].n_distinct) <= 0.08 * exact[c].n_distinct
    held = np.sort([v for i, v in enumerate(x) if i % 10])
    for q, v in zip((0.1, 0.5, 0.9), got["b"].quantiles):
        assert abs(np.searchsorted(held, v) - q * len(held)) <= 2 * len(held) / 10000 + 1
    assert got["d"].quantiles is None and got["c"].quantiles[1] in (18311.0, 18312.0)
    assert evaluation.feature_sketch(df.filter("a < 0"), ["a"]).first().n_distinct == 0


def test_days_end_at_the_exchange(spark, tmp_path):
    def at(text):
        return datetime.datetime.fromisoformat(text)

    batches = [
        [("U1", at("2024-03-09 15:00"), 1, 10.0, 1.0), ("C1", at("2024-03-09 17:00"), 2, 20.0, 1.0), ("X1", at("2024-03-09 12:00"), 3, 1.0, 1.0)],  # 17:00 is the tenth in Shanghai
        [("U1", at("2024-03-10 03:30"), 4, 11.0, 2.0), ("U1", at("2024-03-10 05:30"), 5, 12.0, 4.0), ("C1", at("2024-03-09 14:00"), 6, 19.0, 2.0)],  # 03:30 is still the ninth in New York
        [("U1", at("2024-03-12 12:00"), 7, 13.0, 1.0), ("C1", at("2024-03-12 12:00"), 8, 21.0, 1.0)],
        [("U1", at("2024-03-09 16:00"), 9, 99.0, 1.0), ("U1", at("2024-03-11 20:00"), 10, 14.0, 1.0)],  # too late, and late but within the next day
    ]
    schema, folder = "symbol string, ts timestamp, seq long, price double, quantity double", str(tmp_path / "in")
    dropped, states = [], []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = quotes.stream_exchange_bars(spark.readStream.schema(schema).parquet(folder), {"U": "America/New_York", "C": "Asia/Shanghai"})
        q = quotes.write_updates(stream.withColumnRenamed("Date", "start"), str(tmp_path / "bars"), str(tmp_path / "state"))
        q.awaitTermination()
        progress = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        dropped.append(sum(p["numRowsDroppedByWatermark"] for p in progress))
        states.append(progress[-1]["numRowsTotal"])
    got = sorted((r.symbol, str(r.start), r.Open, r.High, r.Close, r.Volume) for r in quotes.newest_bars(spark.read.parquet(str(tmp_path / "bars"))).collect())
    assert got == [("C1", "2024-03-09", 19.0, 19.0, 19.0, 2.0), ("C1", "2024-03-10", 20.0, 20.0, 20.0, 1.0), ("C1", "2024-03-12", 21.0, 21.0, 21.0, 1.0),
                   ("U1", "2024-03-09", 10.0, 11.0, 11.0, 3.0), ("U1", "2024-03-10", 12.0, 12.0, 12.0, 4.0), ("U1", "2024-03-11", 14.0, 14.0, 14.0, 1.0), ("U1", "2024-03-12", 13.0, 13.0, 13.0, 1.0)]
    assert dropped[:2] == [0, 0] and dropped[3] == 1
    assert states[-1] <= 3  # the days before have left the state
