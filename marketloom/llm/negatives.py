"""Hard negatives: exact integer scores of anchor and candidate tiles by Strassen's recursion, kept in mergeable heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import materialise
from marketloom.llm.vectors import finite, integers, packed

#: Sides of the tiles that are no longer split; anchors and candidates that a task holds together; candidates scored at once.
_LEAF, _ANCHORS, _CANDIDATES, _STRIP = 32, 2048, 32768, 4096

_NOTHING = np.iinfo(np.int64).min


def strassen(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a @ c.T of int64 tiles (m, k) and (n, k): seven products of half tiles in place of eight, odd sides padded with a zero."""
    (m, k), n = a.shape, len(c)
    if min(m, k, n) <= _LEAF:
        return np.einsum("ij,kj->ik", a, c)
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(c, ((0, n % 2), (0, k % 2))))[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    # c.T in quarters: its first half of rows are the first components, its first half of columns the first candidates.
    b11, b12, b21, b22 = c[:j, :i], c[j:, :i], c[:j, i:], c[j:, i:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), dtype=np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def best(scores: np.ndarray, fits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n highest scores that fit in each row; of equal scores the leftmost."""
    s = np.where(fits, scores, _NOTHING)
    if s.shape[1] > n:
        cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n, None]
        above, level = s > cut, (s == cut) & fits
        # Only rows with more equals at the cut than places need counting.
        spare = n - above.sum(axis=1)
        crowded = np.flatnonzero(level.sum(axis=1) > spare)
        level[crowded] &= np.cumsum(level[crowded], axis=1) <= spare[crowded, None]
        fits = above | level
    return np.nonzero(fits)


class _Side:
    """Rows (vec_id, label, q) of one side of a cell, in order of vec_id, zero padded to dim components."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        pdf = pdf.sort_values("vec_id")
        self.pdf, self.ids, self.labels = pdf, pdf["vec_id"].to_numpy(), pdf["label"].to_numpy()
        self.q = np.zeros((len(pdf), dim), dtype=np.int64)
        for i, x in enumerate(pdf["q"]):
            own = np.frombuffer(x, dtype=np.int32)
            self.q[i, : len(own)] = own


def _sides(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[_Side, _Side]:
    dim = max((len(x) // 4 for p in (anchors, rows) for x in p["q"]), default=0)
    return _Side(anchors, dim), _Side(rows, dim)


def _merged(heaps: list[pd.DataFrame], by: list[str], name: str, n: int) -> pd.DataFrame:
    """The first n rows by score and id of each group in all heaps together."""
    both = pd.concat(heaps).sort_values([*by, f"{name}_score", f"{name}_id"], ascending=[True] * len(by) + [False, True])
    return both.groupby(by, sort=False).head(n)


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first n rows of each anchor's label in one cell."""
    out = []
    if len(anchors) and len(rows):
        a, c = _sides(anchors, rows)
        for at in range(0, len(c.ids), _STRIP):
            ids, labels, q = (x[at : at + _STRIP] for x in (c.ids, c.labels, c.q))
            scores = strassen(a.q, q)
            i, j = best(scores, (labels[None, :] == a.labels[:, None]) & (ids[None, :] != a.ids[:, None]), n)
            out.append(pd.DataFrame({"anchor_id": a.ids[i], "positive_id": ids[j], "positive_score": scores[i, j]}))
    return _merged(out, ["anchor_id"], "positive", n) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "positive_id", "positive_score")})


_NEGATIVE = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, n: int, low: int, high: int) -> pd.DataFrame:
    """The first n rows of other labels in the window of each anchor and positive, in one cell."""
    out = []
    if len(anchors) and len(rows):
        a, c = _sides(anchors, rows)
        ids_of, scores_of = ([np.asarray(x, dtype=np.int64) for x in a.pdf[k]] for k in ("positive_ids", "positive_scores"))
        most = max(map(len, ids_of))
        for at in range(0, len(c.ids), _STRIP):
            ids, labels, q = (x[at : at + _STRIP] for x in (c.ids, c.labels, c.q))
            scores = strassen(a.q, q)
            other = labels[None, :] != a.labels[:, None]
            for p in range(most):
                has = np.array([i for i, x in enumerate(ids_of) if len(x) > p], dtype=np.int64)
                own = np.array([scores_of[i][p] for i in has], dtype=np.int64)[:, None]
                s = scores[has]
                i, j = best(s, other[has] & (low * own <= 100 * s) & (100 * s <= high * own), n)
                out.append(pd.DataFrame({"anchor_id": a.ids[has[i]], "positive_id": [ids_of[x][p] for x in has[i]], "positive_score": own[i, 0], "negative_id": ids[j], "negative_score": s[i, j]}, dtype="int64"))
    return _merged(out, ["anchor_id", "positive_id"], "negative", n) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in _NEGATIVE})


def hard_negatives(rows: DataFrame, anchors: DataFrame, vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """The first rows of other labels whose score lies between low and high percent of each positive's, for every anchor.

    rows has vec_id, label and a vector, anchors the vec_ids (each once) of the rows that ask. A score is the inner product of
    floor(scale * component), shorter vectors as if followed by zeros; higher scores come first, ties by smaller vec_id. An
    anchor's positives are its first `positives` rows of the same label, itself left out.

    Anchors are dealt by hash to tiles and rows to slices; a task scores one tile against one slice, so a label or vector that
    a third of all rows share spreads like any other. Each cell keeps its first rows as a heap of a fixed size; ranks by anchor
    merge the heaps. Shuffled rows are those of the table times the number of tiles, and heaps times the number of slices.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a null vec_id, label or vector,
    or a null or non-finite component, take no part. Of rows that repeat a vec_id the one with the least (label, vector) stands
    for all. Anchors without rows, positives or negatives give no rows, nor does an empty table. Components whose integer
    reaches 2 ** 27 raise ArithmeticError. Other columns are not looked at.
    """
    spark = rows.sparkSession
    part = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("v"))
    part = part.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v"))
    one = Window.partitionBy("vec_id").orderBy("label", "v")
    part = part.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, lengths = integers(batch.column(2), scale)
            q = q.astype("<i4")
            if len(set(lengths.tolist())) == 1 and lengths[0]:
                column = packed(q.reshape(len(lengths), -1))
            else:
                ends = np.cumsum(lengths)
                column = pa.array([q[e - n : e].tobytes() for e, n in zip(ends, lengths)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=["vec_id", "label", "q"])

    table = materialise(part.mapInArrow(whole, "vec_id long, label long, q binary"), "vectors")
    asked = materialise(table.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"), "anchors")
    tiles, slices = (max(1, -(-df.count() // n)) for df, n in ((asked, _ANCHORS), (table, _CANDIDATES)))
    # At least as many cells as the session has shuffle partitions, so that few anchors still use all executors.
    slices = max(slices, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // tiles))
    dealt = lambda df, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    cell = ["tile", "slice"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = table.withColumn("slice", dealt(table, slices)).withColumn("tile", upto(tiles)).repartition(tiles * slices, *cell).groupBy(*cell)

    def asking(df: DataFrame) -> DataFrame:
        return df.withColumn("tile", dealt(df, tiles)).withColumn("slice", upto(slices)).repartition(tiles * slices, *cell).groupBy(*cell)

    def first(df: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(f"{name}_score"), f"{name}_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    near = asking(asked).cogroup(held).applyInPandas(lambda a, r: _positives(a, r, positives), "anchor_id long, positive_id long, positive_score long")
    near = first(near, ["anchor_id"], "positive", positives)
    own = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    with_own = asked.join(own, asked["vec_id"] == own["anchor_id"]).select("vec_id", "label", "q", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    with_own = materialise(with_own, "positives")
    hard = asking(with_own).cogroup(held).applyInPandas(lambda a, r: _negatives(a, r, negatives, low, high), ", ".join(f"{c} long" for c in _NEGATIVE))
    return first(hard, ["anchor_id", "positive_id"], "negative", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
