"""Quotes as streams: running bars and alerts; overlay.py puts the bars over stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bars(quotes: DataFrame, period: str = "1 day", watermark: str = "15 minutes") -> DataFrame:
    """Running bars by symbol and period of a stream (symbol, ts, seq, price, quantity); quotes behind the watermark are dropped.

    seq orders quotes of the same time. The state is one small row a symbol and open period.
    """
    at = F.struct("ts", "seq")
    bars = quotes.withWatermark("ts", watermark).groupBy(F.window("ts", period), "symbol").agg(
        F.min_by("price", at).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max_by("price", at).alias("Close"), F.sum("quantity").alias("Volume"))
    return bars.select("symbol", F.col("window.start").alias("start"), "Open", "High", "Low", "Close", "Volume")


def stream_exchange_bars(quotes: DataFrame, zones: dict[str, str], late: str = "15 minutes", prefix: int = 1) -> DataFrame:
    """Running daily bars by the calendar of each symbol's exchange, of a stream (symbol, ts, seq, price, quantity).

    zones maps the first `prefix` characters of a symbol to a zone name; '' is the zone of all others, and without it they are
    left out. A quote belongs to the date at its exchange, which may differ from the date in UTC and be 23 or 25 hours long.

    The end of that day is the event time. A day takes quotes until the stream has seen a day that ends a day and `late` after it, that
    is, through the whole next day; then its state goes, and quotes that come still later are dropped. The state is one small row
    a symbol and open day.
    """
    zone = F.lit(zones.get("")).cast("string")
    for start, name in zones.items():
        zone = F.when(F.substring("symbol", 1, prefix) == start, name).otherwise(zone) if start else zone
    dated = quotes.withColumn("_zone", zone).filter("_zone is not null").withColumn("Date", F.from_utc_timestamp("ts", F.col("_zone")).cast("date"))
    ends = dated.withColumn("day_end", F.to_utc_timestamp(F.date_add("Date", 1).cast("timestamp"), F.col("_zone"))).withWatermark("day_end", f"1 day {late}")
    at = F.struct("ts", "seq")
    return ends.groupBy("symbol", "Date", "day_end").agg(
        F.min_by("price", at).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max_by("price", at).alias("Close"), F.sum("quantity").alias("Volume")).drop("day_end")


def write_updates(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's changed bars under batch=<id>. A batch that runs again overwrites its own folder, so nothing doubles."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bars.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_bars(updates: DataFrame) -> DataFrame:
    """The bar of each symbol and period from the last batch that changed it."""
    cols = [c for c in updates.columns if c not in ("symbol", "start", "batch")]
    return updates.groupBy("symbol", "start").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("symbol", "start", "r.*")


def stream_alerts(quotes: DataFrame, levels: DataFrame) -> DataFrame:
    """Quotes at or beyond a level of their symbol (symbol, supporter, resistanter), a stream joined with a table."""
    out = quotes.join(levels, "symbol")
    p = F.col("price")
    return out.withColumn("alert", F.when(p <= F.col("supporter"), "support").when(p >= F.col("resistanter"), "resistant")).filter("alert is not null")
