"""The store of bars that batches keep up to date."""

import datetime
from pathlib import Path

import pytest

from marketloom.streaming import overlay

SCHEMA = "symbol string, Date date, Close double, Volume double"


def day(m, d):
    return datetime.date(2024, m, d)


def bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shown(spark, path):
    return sorted((r.symbol, r.Date, r.Close, r.Volume, r.batch) for r in overlay.read_store(spark, path).collect())


def files(path, month):
    return sorted(p.name for p in Path(path, f"month={month}").glob("*.parquet"))


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    overlay.create_store(bars(spark, [("a", day(1, 30), 1.0, 10.0), ("a", day(2, 1), 2.0, 20.0), ("b", day(2, 1), 3.0, 30.0), ("b", day(3, 1), 4.0, 40.0)]), path)
    return path


def test_batches_rewrite_what_they_touch(spark, store):
    january, march = files(store, 202401), files(store, 202403)
    assert overlay.merge_batch(bars(spark, [("a", day(2, 1), 2.5, None), ("c", day(2, 2), 9.0, 90.0)]), 0, store) == [202402]
    assert (files(store, 202401), files(store, 202403)) == (january, march)
    want = [("a", day(1, 30), 1.0, 10.0, -1), ("a", day(2, 1), 2.5, 20.0, 0), ("b", day(2, 1), 3.0, 30.0, -1), ("b", day(3, 1), 4.0, 40.0, -1), ("c", day(2, 2), 9.0, 90.0, 0)]
    assert shown(spark, store) == want
    assert overlay.merge_batch(bars(spark, []), 1, store) == [] and shown(spark, store) == want
    assert overlay.merge_batch(bars(spark, [("a", day(2, 1), 2.75, 21.0), ("d", day(4, 1), 1.0, 1.0)]), 2, store) == [202402, 202404]
    want = sorted([*[r for r in want if r[:2] != ("a", day(2, 1))], ("a", day(2, 1), 2.75, 21.0, 2), ("d", day(4, 1), 1.0, 1.0, 2)])
    assert shown(spark, store) == want
    # The same batch again, and one that came before it: nothing changes.
    overlay.merge_batch(bars(spark, [("a", day(2, 1), 2.75, 21.0), ("d", day(4, 1), 1.0, 1.0)]), 2, store)
    overlay.merge_batch(bars(spark, [("a", day(2, 1), 2.5, None), ("c", day(2, 2), 9.0, 90.0)]), 0, store)
    assert shown(spark, store) == want


def test_a_batch_that_lost_a_month_is_finished(spark, store, monkeypatch):
    batch = bars(spark, [("a", day(1, 30), 7.0, 70.0), ("a", day(2, 1), 8.0, 80.0)])
    put, calls = overlay._put, []

    def stops(rows, path, **how):
        calls.append(path)
        if path == store:  # the old files are gone, the new ones not there yet
            for p in Path(store, "month=202402").glob("*"):
                p.unlink()
            raise RuntimeError("lost")
        put(rows, path, **how)

    monkeypatch.setattr(overlay, "_put", stops)
    with pytest.raises(RuntimeError):
        overlay.merge_batch(batch, 5, store)
    monkeypatch.setattr(overlay, "_put", put)
    assert overlay.merge_batch(batch, 5, store) == [202401, 202402]
    assert shown(spark, store) == [("a", day(1, 30), 7.0, 70.0, 5), ("a", day(2, 1), 8.0, 80.0, 5), ("b", day(2, 1), 3.0, 30.0, -1), ("b", day(3, 1), 4.0, 40.0, -1)]


def test_a_stream_goes_on_where_it_stopped(spark, store, tmp_path):
    def run():
        overlay.keep_updated(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), store, str(tmp_path / "state")).awaitTermination()

    for n, rows in enumerate(([("a", day(2, 1), 2.5, 25.0)], [("b", day(2, 1), 3.5, None)], [("a", day(2, 1), 2.6, 26.0)])):
        bars(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()
    assert shown(spark, store) == [("a", day(1, 30), 1.0, 10.0, -1), ("a", day(2, 1), 2.6, 26.0, 2), ("b", day(2, 1), 3.5, 30.0, 1), ("b", day(3, 1), 4.0, 40.0, -1)]
