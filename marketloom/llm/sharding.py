"""Sharding by histogram sort: splitters of equal bytes are found by exact counts below probes, then rows move once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import materialise

#: Bits that each round of probes resolves, from the highest; the first 64 are the text's hash, the next 64 the doc_id.
_MIN = -(1 << 63)
_ROUNDS = (12, 10, 10, 10, 11, 11, 12, 10, 10, 10, 11, 11)


def _digits(hash_col: Column, id_col: Column) -> list[Column]:
    """The sort key as unsigned digits. The doc_id's sign bit is turned so that negative ids come first."""
    out, left, word = [], 64, hash_col
    for bits in _ROUNDS:
        left -= bits
        out.append(F.shiftrightunsigned(word, left).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
        if left == 0:
            left, word = 64, id_col.bitwiseXOR(F.lit(_MIN))
    return out


def _crossings(rows: DataFrame, cols: list[str], targets: DataFrame) -> dict:
    """For each target the cell of its prefix that holds it: (digit, bytes and rows before it in the prefix, bytes and rows in it).

    Cells are counted exactly; only one row a target comes back.
    """
    order = Window.partitionBy(*cols[:-1]).orderBy(cols[-1]).rowsBetween(Window.unboundedPreceding, 0)  # at most 4096 cells each
    cells = rows.groupBy(*cols).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    cells = cells.withColumns({"upto": F.sum("size").over(order), "n_upto": F.sum("n").over(order)})
    on = [F.col(f"t.{c}") == F.col(f"c.{c}") for c in cols[:-1]]
    on += [F.col("c.upto") + F.col("t.below") >= F.col("t.goal"), F.col("c.upto") - F.col("c.size") + F.col("t.below") < F.col("t.goal")]
    held = cells.alias("c").join(F.broadcast(targets.alias("t")), on)  # at most one row a splitter
    return {r[0]: tuple(r)[1:] for r in held.select("t.k", f"c.{cols[-1]}", F.col("c.upto") - F.col("c.size"), F.col("c.n_upto") - F.col("c.n"), "c.size", "c.n").collect()}


def shard_documents(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, parts_per_shard: int | None = None) -> DataFrame:
    """Put every document into one of n_shards shards of near equal bytes.

    The order is (hash of the text, doc_id), so equal texts lie together and only a splitter that must cut them does. Each
    round counts the exact bytes and rows of the candidate intervals and refines those that hold a splitter, until the bytes
    below each are within tolerance of its share (or one row remains). Finer splitters, with a loose tolerance, cut shards
    into parts for the one exchange, in which the whole rows move; no part holds more than its share, whatever repeats.

    Returns the columns of docs with size (UTF-8 bytes of the text + 1; null text: 1), text_crc32 (of the text as it lies in its
    shard; null text: 0), shard, slot (gapless from 0 in a shard); columns of docs with one of these names are left out, as are
    those whose names start with _hs_. Rows that repeat a doc_id and text are separate rows; a null doc_id comes before all
    others. Fewer rows than shards leave some shards empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    per = parts_per_shard or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    n_parts = n_shards * per
    text = F.coalesce(F.col("text"), F.lit(""))
    size, hashed, doc_id = F.octet_length(text).cast("long") + 1, F.xxhash64(text), F.col("doc_id").cast("long")
    light = materialise(docs.select(doc_id.alias("doc_id"), size.alias("size"), hashed.alias("h")), "sizes")
    digits = _digits(F.col("h"), F.coalesce(F.col("doc_id"), F.lit(_MIN)))
    keyed = light.select("size", *[d.alias(f"d{i}") for i, d in enumerate(digits)])

    total = light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / n_parts
    # A splitter is a digit prefix: rows below it, in bytes and rows, are before it. open: the prefix that still holds the target.
    open_ = {k: ((), 0, 0) for k in range(1, n_parts)} if total else {}
    splitters: dict = {}
    for level in range(len(_ROUNDS)):
        if not open_:
            break
        cols = [f"d{i}" for i in range(level + 1)]
        names = "".join(f", d{i} int" for i in range(level))
        targets = spark.createDataFrame([(k, share * k, below, *prefix) for k, (prefix, below, _) in open_.items()], f"k int, goal double, below long{names}")
        rows = keyed.join(F.broadcast(targets.select(*cols[:-1]).distinct()), cols[:-1]) if level else keyed  # at most n_parts prefixes
        found, next_open = _crossings(rows, cols, targets), {}
        for k, (prefix, below, n_below) in open_.items():
            goal = share * k
            digit, before, n_before, held, n = found[k]
            below, n_below = below + before, n_below + n_before
            allowed = tolerance * share * per if k % per == 0 else 0.25 * share
            if goal - below <= allowed and goal - below <= below + held - goal:
                splitters[k] = (prefix + (digit,), n_below)
            elif below + held - goal <= allowed or n == 1 or level == len(_ROUNDS) - 1:
                splitters[k] = (prefix + (digit + 1,), n_below + n)
            else:
                next_open[k] = (prefix + (digit,), below, n_below)
        open_ = next_open
    # Parts in order; equal splitters leave an empty part between them.
    first = {0: 0} | {k: n for k, (_, n) in sorted(splitters.items())}
    part = _count_at_or_below([_bound(splitters[k][0]) for k in sorted(splitters)])
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot") and not c.startswith("_hs_")]
    keys = docs.select(*own, size.alias("size"), hashed.bitwiseXOR(F.lit(_MIN)).alias("_hs_hi"), F.coalesce(doc_id, F.lit(_MIN)).alias("_hs_lo"))
    moved = keys.withColumn("_hs_part", part("_hs_hi", "_hs_lo")).repartition(n_parts, "_hs_part").withColumn("text_crc32", F.crc32(text.cast("binary")))
    starts = spark.createDataFrame([(k, k // per, n - first[k // per * per]) for k, n in sorted(first.items())], "_hs_part int, shard int, _hs_start long")
    order = Window.partitionBy("_hs_part").orderBy("_hs_hi", "_hs_lo", "size", "text_crc32")
    return (moved.withColumn("_hs_row", F.row_number().over(order) - 1).join(F.broadcast(starts), "_hs_part")  # one row a part
            .select(*own, "size", "text_crc32", "shard", (F.col("_hs_start") + F.col("_hs_row")).alias("slot")))


def histogram_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, parts_per_shard: int | None = None) -> DataFrame:
    """The digest of shard_documents: doc_id, size, text_crc32, shard, slot."""
    return shard_documents(docs, n_shards, tolerance, parts_per_shard).select("doc_id", "size", "text_crc32", "shard", "slot")


def _bound(digits: tuple) -> tuple[int, int] | None:
    """The least key (hash, doc_id) with these leading digits, as two signed longs; None beyond every key."""
    key = sum(d << (128 - sum(_ROUNDS[: i + 1])) for i, d in enumerate(digits))
    return None if key >> 128 else ((key >> 64) + _MIN, (key & ((1 << 64) - 1)) + _MIN)


def _count_at_or_below(bounds: list):
    """A function of two long columns: how many of the sorted bounds are at or below the row's key, by binary search."""
    held = [b for b in bounds if b is not None]
    his, los = (np.array([b[i] for b in held], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def count(hi: pd.Series, lo: pd.Series) -> pd.Series:
        h, x = hi.to_numpy(), lo.to_numpy()
        out, upto = np.searchsorted(his, h, "left"), np.searchsorted(his, h, "right")
        for begin in np.unique(out[upto > out]):  # rows whose text a splitter cuts
            own = (out == begin) & (upto > begin)
            end = upto[own][0]
            out[own] = begin + np.searchsorted(los[begin:end], x[own], "right")
        return pd.Series(out.astype(np.int32))

    return count
