"""Line dedup over windows of three lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise, small_batches

WINDOW = 3


def _without_covered(text: pd.Series, starts: pd.Series, window: int) -> pd.DataFrame:
    """Drop the lines that the windows at starts cover."""
    cleaned, total, removed = [], [], []
    for t, at in zip(text, starts):
        if t is None or t != t:
            cleaned.append(None), total.append(0), removed.append(0)
            continue
        lines = t.split("\n")
        total.append(len(lines))
        if at is None or len(at) == 0:
            cleaned.append(t), removed.append(0)
            continue
        edge = np.zeros(len(lines) + 1, dtype=np.int64)
        at = np.asarray(at, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + window, len(lines)), -1)
        covered = np.cumsum(edge[:-1]) > 0
        cleaned.append("\n".join(x for x, c in zip(lines, covered) if not c))
        removed.append(int(covered.sum()))
    return pd.DataFrame({"text": pd.Series(cleaned, dtype=object), "n_lines": pd.Series(total, dtype="int64"), "n_removed": pd.Series(removed, dtype="int64")})


#: Tells texts of one doc_id apart.
TEXT_KEY = "_text_key"


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, TEXT_KEY, starts): the windows of consecutive lines whose content occurred before, in order of (doc_id, text key, line).

    docs has doc_id, text and TEXT_KEY. Windows compare by 128 bits of hash of their trimmed lines; a window without any visible
    character is no window. The first occurrence of each content is found with a pre-aggregated minimum, so a passage that a third
    of all documents share costs each task one row; the join that then marks later occurrences has one row a content on its small side.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    at = docs.select("doc_id", TEXT_KEY, lines.alias("l")).filter(F.size("l") >= window)
    spans = F.transform(F.sequence(F.lit(0), F.size("l") - window), lambda i: F.array_join(F.slice("l", i + 1, F.lit(window)), "\n"))
    hashed = F.transform(spans, lambda w: F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(7), w).alias("h2"), (F.length(F.trim(F.translate(w, "\n", ""))) > 0).alias("visible")))
    each = at.select("doc_id", TEXT_KEY, F.posexplode(hashed).alias("pos", "w")).filter("w.visible").select("doc_id", TEXT_KEY, "pos", "w.h1", "w.h2")
    each = materialise(each, "line_windows")
    place = F.struct("doc_id", TEXT_KEY, "pos")
    first = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialise(first, "first_lines")  # so that the join may split the rows of a window that very many documents hold
    later = each.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", TEXT_KEY).agg(F.collect_set("pos").alias("starts"))


def clean_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with a column _clean (text, n_lines, n_removed) beside its own; see dedup_lines."""
    small_batches(docs.sparkSession)
    keyed = docs.withColumn(TEXT_KEY, F.xxhash64("text"))
    starts = repeated_windows(keyed.select("doc_id", TEXT_KEY, "text").filter("doc_id is not null"), window).withColumnRenamed("starts", "_starts")

    def cleaned(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return _without_covered(text, starts, window)

    # Said to be nondeterministic, so that a filter on _clean is not pushed below it: that would call it twice for each row, in two
    # Python workers a task.
    cleaned = F.pandas_udf(cleaned, "text string, n_lines long, n_removed long").asNondeterministic()
    return keyed.join(starts, ["doc_id", TEXT_KEY], "left").withColumn("_clean", cleaned("text", "_starts")).drop("_starts", TEXT_KEY)


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every later occurrence of a run of `window` lines that occurred before in any document.

    Order is (doc_id, line number). Covered positions of overlapping windows merge; all other lines stay as they were, and so
    do texts of fewer than `window` lines. A text whose every line is covered becomes empty.

    Returns doc_id, text, n_lines, n_removed, one row for each row given. A null text stays null with no lines; the empty text
    is one empty line. Rows that share doc_id and text count as one document, so none of them is later than another; texts that
    differ under one doc_id are documents of their own, in order of their hash. A null doc_id keeps its text. Other columns are
    not looked at.
    """
    return clean_lines(docs.select("doc_id", "text"), window).select("doc_id", "_clean.text", "_clean.n_lines", "_clean.n_removed")
