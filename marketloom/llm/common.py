"""Shared pieces: tables, the shared scratch folder, word splitting and caches that live as long as a Python worker."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: the only characters that separate words.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a folder of the warehouse of a session on one
    machine (tests). On a cluster no such folder is known, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marketloom/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The shuffle files of the write go when it ends: nothing reads them again, and they would lie on the executors' disks until the
    driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch at most: texts may be long, and both the executor and its worker hold whole batches.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python few at a time: the session's Arrow batches hold BATCH_ROWS rows from here on, or fewer if it says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """The runs of characters between SEPARATORS; no other space separates."""
    if not text:
        return []
    for c in SEPARATORS[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def worker_cache(name: str) -> dict:
    """A dictionary that outlives the task, for what is costly to build in each Python worker."""
    holder = sys.modules.setdefault("_marketloom_worker_cache", types.ModuleType("_marketloom_worker_cache"))
    return holder.__dict__.setdefault(name, {})


class TwoGenerations:
    """A cache of bytes by string that holds about 2 * limit bytes: when the young half is full it becomes the old half.

    A key is kept from its second time on (told by a few bits of its hash), so that the many words met once take no place.
    """

    #: About what a key, a value and their place in the table take besides their contents; places of the bits of keys met once.
    EACH, MET = 200, 1 << 20

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.held, self.met = limit, {}, {}, 0, bytearray(self.MET)

    def offer(self, key: str, value: bytes) -> None:
        place = hash(key) & (self.MET - 1)
        if self.met[place]:
            self.put(key, value)
        else:
            self.met[place] = 1

    def offer_all(self, keys: list[str], values: list[bytes]) -> None:
        """offer for each of many keys."""
        met, last = self.met, self.MET - 1
        for key, value in zip(keys, values):
            place = hash(key) & last
            if met[place]:
                self.put(key, value)
                met = self.met
            else:
                met[place] = 1

    def put(self, key: str, value: bytes) -> None:
        if self.held >= self.limit:
            self.old, self.young, self.held, self.met = self.young, {}, 0, bytearray(self.MET)
        self.young[key] = value
        self.held += len(key) + len(value) + self.EACH

    def get(self, key: str) -> bytes | None:
        """The value, or None; what is found in the old half becomes young again."""
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def shrink(self) -> None:
        """At the end of a task: the old half goes."""
        self.old = {}
