"""A store of bars that a stream keeps up to date: each batch rewrites the months that it touches, and nothing else.

A store is a folder of Parquet, partitioned by month (year * 100 + month), whose rows carry the number of the batch that wrote
them last; history has -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.sources.files import children, exists, remove

KEY, HISTORY = ("symbol", "Date"), -1


def _month() -> Column:
    return F.year("Date") * 100 + F.month("Date")


def _put(rows: DataFrame, path: str, whole: bool = False) -> None:
    """Write rows by month: of a folder that is there only the months that rows hold are replaced, or all (whole), which also marks
    the folder as complete (_SUCCESS)."""
    rows.hint("rebalance", "month").write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").parquet(path)


def create_store(bars: DataFrame, path: str) -> None:
    """Write bars (one row a symbol and Date) as the history of a new store."""
    _put(bars.withColumns({"batch": F.lit(HISTORY).cast("long"), "month": _month()}), path)


def _stored(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` {kind}" for c, kind in columns) + ", batch long, month int").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The bars of a store as they stand; a filter on Date should come with one on month, which prunes folders."""
    return spark.read.parquet(path)


def merge_batch(batch: DataFrame, number: int, path: str) -> list[int]:
    """Put a batch's bars over those of the store, column by column, and return the months that were rewritten.

    A null of the batch keeps the stored value, keys that only one side has stay, and a row that a later batch wrote is not
    touched, so a batch may run again at any time. First the new state of the touched months is written beside the store, as a
    whole and under the batch's number; then it replaces these months. A run that stops in between is finished by the next run of
    the same number from what was written, never from a store that lost a month. What an earlier batch left there goes. Numbers
    rise over the life of a store: one stream, with one checkpoint, writes it.
    """
    spark = batch.sparkSession
    columns = [x for x in batch.dtypes if x[0] not in ("batch", "month")]
    values = [c for c, _ in columns if c not in KEY]
    stage, own = f"{path.rstrip('/')}__staged", f"batch={number}"
    if not exists(spark, f"{stage}/{own}/_SUCCESS"):
        new = batch.select([c for c, _ in columns]).withColumn("month", _month()).persist()
        try:
            months = sorted(r[0] for r in new.select("month").distinct().collect())  # a batch spans few months
            if not months:
                return []
            old = _stored(spark, path, columns).filter(F.col("month").isin(months))
            newer = new.select(*KEY, "month", *[F.col(c).alias(f"_{c}") for c in values], F.lit(number).cast("long").alias("_batch"))
            both = old.join(newer, [*KEY, "month"], "full")
            taken = F.col("_batch").isNotNull() & (F.coalesce("batch", F.lit(HISTORY)) <= number)
            merged = both.select(*KEY, *[F.when(taken, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in values],
                                 F.when(taken, F.col("_batch")).otherwise(F.col("batch")).alias("batch"), "month")
            _put(merged, f"{stage}/{own}", whole=True)
        finally:
            new.unpersist()
    staged = _stored(spark, f"{stage}/{own}", columns)
    months = sorted(int(x.split("=")[1]) for x in children(spark, f"{stage}/{own}") if x.startswith("month="))
    _put(staged, path)
    for name in children(spark, stage):
        if name.startswith("batch=") and int(name.split("=")[1]) < number:
            remove(spark, f"{stage}/{name}")
    return months


def keep_updated(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of bars (symbol, Date and values) into a store, all that is there and then stop."""
    def put(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path)

    return bars.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
