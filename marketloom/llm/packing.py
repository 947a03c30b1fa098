"""Packing along a Hilbert curve: neighbours in content share sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise, small_batches, worker_cache
from marketloom.llm.tokens import encoded, rest, slices

#: Hashed vector, its projection, and bits of each projected dimension on the curve.
BUCKETS, DIMENSIONS, BITS = 4096, 4, 10


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer points (rows of cells) along the Hilbert curve, by the public transpose method."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(seed: int = 11) -> np.ndarray:
    cache = worker_cache("projection")
    if seed not in cache:
        cache[seed] = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return cache[seed]


def curve_keys(all_ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents: token ids hashed to BUCKETS counts, damped, normed, projected, cut into cells."""
    proj = _projection()
    points = np.zeros((len(all_ids), DIMENSIONS))
    for i, ids in enumerate(all_ids):
        hashed = (ids.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)
        counts = np.bincount((hashed & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        held = np.flatnonzero(counts)
        v = np.log1p(counts[held])
        points[i] = (v / np.sqrt(v @ v)) @ proj[held]
    # Projections of unit vectors are about standard normal: the logistic curve spreads them over the cells.
    cells = np.floor((1 << BITS) / (1 + np.exp(-1.702 * points))).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Lay all documents along the Hilbert curve of their contents and cut the line into sequences of `length` ids.

    Documents are range-sorted by (Hilbert key, doc_id); exact copies share a key, so the doc_id and size spread them. Sums of
    ids of the ranges (one row a range) give every document its place on the one line, and sequence k holds places
    k * length to (k + 1) * length - 1: only the very last sequence is shorter. No document meets another on a driver.

    Returns one row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit integers), ids_crc32 (of those bytes),
    doc_tokens, sequence_id, offset. A null text is empty and holds
    the end id only. Repeated rows are packed each; null doc_ids too. An empty table gives no rows; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            ids = list(encoded(some.column("text").to_pylist(), tokenizer, False, end_id))
            # Two bytes an id where the vocabulary allows; the first byte says which.
            small = [(b"\x02" + x.astype("<u2").tobytes()) if not len(x) or x.max() < 65536 else b"\x04" + x.tobytes() for x in ids]
            yield pa.record_batch({"doc_id": some.column("doc_id"), "key": pa.array(curve_keys(ids), pa.int64()), "n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(small, pa.binary())})
        rest(tokenizer, False)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(keyed, "doc_id long, key long, n long, ids binary"), "tokens")
    line = tokens.repartitionByRange(n, "key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n", "ids")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for pdf in batches:
            ends = before + pdf["n"].cumsum()
            before = int(ends.iloc[-1]) if len(pdf) else before
            yield pdf[["doc_id", "n", "ids"]].astype({"doc_id": "Int64"}).assign(part=part, before=ends - pdf["n"])

    line = materialise(line.mapInPandas(summed, "doc_id long, n long, ids binary, part int, before long"), "line")
    starts, place = [], 0
    for part, total in sorted(line.groupBy("part").agg(F.sum("n")).collect()):  # one row a range
        starts.append((part, place))
        place += total
    begins = spark.createDataFrame(starts, "part int, begin long")
    placed = line.join(F.broadcast(begins), "part").withColumn("place", F.col("begin") + F.col("before"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for doc_id, n, raw, place in zip(pdf["doc_id"], pdf["n"], pdf["ids"], pdf["place"]):
                ids = np.frombuffer(raw, dtype="<u2" if raw[0] == 2 else "<u4", offset=1).astype("<u4")
                at = 0
                while at < n:
                    offset = (place + at) % length
                    take = min(n - at, length - offset)
                    rows.append((doc_id, at, take, ids[at : at + take].tobytes(), n, (place + at) // length, offset))
                    at += take
                    held += take
                if held > 2_000_000:
                    yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    cut = placed.select("doc_id", "n", "ids", "place").mapInPandas(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return cut.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

