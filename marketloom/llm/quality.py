"""Weak supervision of text quality: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import small_batches, words_of

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Very common words of the four languages.
COMMON = frozenset("the of and to in is that for with as on be at by this el la de que y en los se del las por con para der die und das von den mit ist des im le les et des un une est pour dans sur en du au".split())


def text_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_common, n_alpha, n_ended."""
    words = words_of(text)
    if not words:
        n_symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
        return 0, 0, n_symbols, 0, 0, 0, 0, 0, 0
    n = len(words)
    repeat = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) < len(windows):
        seen: dict = {}
        again = np.zeros(len(windows), dtype=bool)
        for i, w in enumerate(windows):
            j = seen.setdefault(w, i)
            if j != i:
                again[i] = again[j] = True
        edge = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(again)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    alpha = sum(map(str.isalpha, words))
    return (n, sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines),
            sum(w.lower() in COMMON for w in words), alpha, sum(w[-1] in ".,;:!?" for w in words))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_common long, n_alpha long, n_ended long"


def _counts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(None if t is None or t != t else t) for t in text], columns=[c.split()[0] for c in COUNTS.split(", ")], dtype="int64")


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def vote_columns() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, -1 abstains."""
    def votes(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    length, few = _share("word_chars"), F.col("n_words") < 20
    return {
        "v_length": votes(F.col("n_words") < 10, F.col("n_words") >= 40),
        "v_word_size": F.when(few, -1).otherwise(votes((length < 2.5) | (length > 12), (length >= 3) & (length <= 9))),
        "v_symbols": votes(_share("n_symbols") > 0.1, _share("n_symbols") < 0.02),
        "v_lines": F.when(F.col("n_lines") < 4, -1).otherwise(votes(_share("n_dup_lines", "n_lines") > 0.3, _share("n_dup_lines", "n_lines") <= 0.1)),
        "v_repeats": F.when(few, -1).otherwise(votes(_share("n_repeat_words") > 0.2, _share("n_repeat_words") < 0.05)),
        "v_common": F.when(few, -1).otherwise(votes(_share("n_common") < 0.02, _share("n_common") >= 0.08)),
        "v_alpha": F.when(few, -1).otherwise(votes(_share("n_alpha") < 0.5, _share("n_alpha") >= 0.75)),
        "v_sentences": F.when(few, -1).otherwise(votes((_share("n_ended") < 0.01) | (_share("n_ended") > 0.6), (_share("n_ended") >= 0.04) & (_share("n_ended") <= 0.4))),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.8, accuracy: float = 0.8, strength: float = 0.01) -> tuple[float, np.ndarray]:
    """EM over distinct vote patterns: the share of good texts and P(vote | class) of every rule (rules x class x vote).

    Rules start better than chance, which names the classes; `strength` of all texts count as a pseudo-sample of that start, so
    no class can empty out and no rule turns on its own evidence alone.
    """
    m, total = patterns.shape[1], counts.sum()
    start = np.empty((m, 2, 3))
    for j in range(m):
        away = counts[patterns[:, j] == -1].sum() / max(total, 1)
        start[j, :, 2] = away
        start[j, 0, :2] = (1 - away) * np.array([accuracy, 1 - accuracy])
        start[j, 1, :2] = (1 - away) * np.array([1 - accuracy, accuracy])
    slot = np.where(patterns < 0, 2, patterns)
    table, share = start.copy(), prior
    pseudo = max(strength * total, 1.0)
    for _ in range(rounds):
        log = np.log(np.maximum(table[np.arange(m), :, slot], 1e-12)).sum(axis=1) + np.log([1 - share, share])
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        weight = np.stack([(1 - p) * counts, p * counts], axis=1)
        new = pseudo * start * np.array([1 - prior, prior])[None, :, None]
        for v in range(3):
            new[:, :, v] += (slot == v).T @ weight
        new /= np.maximum(new.sum(axis=2, keepdims=True), 1e-12)
        moved, table = np.abs(new - table).max(), new
        share = float(np.clip((weight[:, 1].sum() + pseudo * prior) / (total + pseudo), 1e-6, 1 - 1e-6))
        if moved < 1e-9:
            break
    return share, table


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Judge every text by the posterior probability that it is good.

    The corpus is read once for counts and written as a short row a document; EM then sees only the distinct vote patterns with
    their numbers of texts (at most 3 ** rules rows, whatever the corpus holds), and the posterior is a sum of logarithms in
    each row. Every text counts, none is sampled.

    Returns doc_id, the counts, base_failed, the votes, quality (probability) and kept, one row for each row given. Null and
    empty texts have no words and fail the base. An empty table gives no rows. Other columns are not looked at.
    """
    from marketloom.llm.common import materialise

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.pandas_udf(_counts, COUNTS)("text").alias("c")).select("doc_id", "c.*")
    rules = vote_columns()
    base = ("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    voted = materialise(rows.withColumns(rules).withColumn("base_failed", F.expr(base)), "votes")
    seen = voted.groupBy(*rules).agg(F.count("*").alias("n")).collect()
    if not seen:
        return voted.withColumn("quality", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    share, table = fit_votes(np.array([r[:-1] for r in seen], dtype=int), np.array([r[-1] for r in seen], dtype=float))
    logit = F.lit(math.log(share / (1 - share)))
    ratio = np.log(np.maximum(table[:, 1], 1e-12)) - np.log(np.maximum(table[:, 0], 1e-12))
    for j, name in enumerate(rules):
        v = F.col(name)
        logit = logit + F.when(v == 0, float(ratio[j, 0])).when(v == 1, float(ratio[j, 1])).otherwise(float(ratio[j, 2]))
    return voted.withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
