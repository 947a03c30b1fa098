"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import small_batches, worker_cache
from marketloom.llm.tokens import blocks, slices

#: Hashed n-gram features, and n-gram lengths.
FEATURES, LENGTHS = 1 << 15, (1, 2, 3)


def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a space. Digits, signs and spaces all read as one kind of gap."""
    worker_cache("encoders").clear()  # what an earlier job left in this worker
    cache = worker_cache("letters")
    if "table" not in cache:
        points = np.arange(0x110000, dtype=np.uint32)
        keep = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        cache["table"] = np.where(keep, points, 32).astype(np.uint32)
    return cache["table"]


def ngram_hashes(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of the whole text, lower-cased, gaps joined; empty without a letter."""
    if not text:
        return np.empty(0, dtype=np.int64)
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    gap = c == 32
    c = np.concatenate([[32], c[~(gap & np.concatenate([[True], gap[:-1]]))], [32]]).astype(np.uint64)
    if len(c) == 2 or (c == 32).all():
        return np.empty(0, dtype=np.int64)
    out, h = [], np.zeros(len(c), dtype=np.uint64)
    for n in LENGTHS:
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(49)).astype(np.int64))
    return np.concatenate(out)


def _texts(pdf: pd.DataFrame) -> list:
    return [None if t is None or t != t else t for t in pdf["text"]]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs; each task sends one row a feature at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for some in slices(batches):
            for t in some.column("text").to_pylist():
                hit = np.bincount(ngram_hashes(t), minlength=FEATURES) > 0
                df[:FEATURES] += hit
                n += 1
        df[FEATURES] = n
        at = np.flatnonzero(df)
        yield pa.record_batch({"feature": pa.array(at, pa.int32()), "n": pa.array(df[at], pa.int64())})

    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for feature, n in docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n
    return out[:FEATURES], int(out[FEATURES])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def parts(self) -> tuple:
        """Plain lists and arrays, which a worker can read without this package."""
        return self.languages, self.idf, self.weights, self.bias, self.temperature


def probabilities(model: tuple, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities by language, and which texts have a letter. model: LanguageModel.parts()."""
    languages, idf, weights, bias, temperature = model
    logits, known = np.zeros((len(texts), len(languages))), np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        at, value = vector(t, idf)
        if len(at):
            known[i] = True
            logits[i] = value @ weights[at] + bias
    z = logits / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True)) if len(texts) and len(languages) else z
    return z / np.maximum(z.sum(axis=1, keepdims=True), 1e-300), known


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of a text with unit length: feature numbers and values."""
    h = ngram_hashes(text)
    if not len(h):
        return h, np.empty(0)
    counts = np.bincount(h, minlength=FEATURES)
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / (norm if norm > 0 else 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, proximal, per coordinate, with elastic net; the bias is a feature without penalty."""
    z, n = np.zeros((FEATURES + 1, n_classes)), np.zeros((FEATURES + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        free = (at == FEATURES)[:, None]
        a, b = np.where(free, 0.0, l1), np.where(free, 0.0, l2)
        w = -(z[at] - np.sign(z[at]) * a) / ((beta + np.sqrt(n[at])) / alpha + b)
        return np.where(np.abs(z[at]) <= a, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature in [0.05, 20] with the least log loss, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_language_model(docs: DataFrame, may_learn: Column, rows_per_language: int = 800, label_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample: at most rows_per_language documents of each language, those with the least hash of doc_id.

    may_learn says which rows may be seen. Document frequencies come from all those rows. A fifth of the sample is kept from
    training for the temperature. Null labels and texts without letters teach nothing; without any row the model is empty and
    predicts und. One language alone is predicted with certainty.
    """
    small_batches(docs.sparkSession)
    pool = docs.select(F.col("text"), F.col(label_col).alias("label"), F.col("doc_id")).filter(may_learn & F.col("label").isNotNull() & F.col("text").isNotNull())
    df, n_docs = document_frequencies(pool)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    idf[df == 0] = 0.0
    counts = {r.label: r.n for r in pool.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # A cut of the hash that holds the wanted number of rows with room to spare; then exactly the least of them.
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))
    drawn = pool.withColumn("_draw", draw)
    cut = F.lit(0.0)
    for label, n in counts.items():
        cut = F.when(F.col("label") == label, min(1.0, (1.3 * rows_per_language + 60) / n)).otherwise(cut)
    sample: list = []
    taken: dict = {}
    for r in sorted(drawn.filter(F.col("_draw") < cut * float(1 << 52)).select("label", "_draw", "text").collect(), key=lambda r: (r[1], r[2])):
        if taken.get(r.label, 0) < rows_per_language and len(ngram_hashes(r.text)):
            taken[r.label] = taken.get(r.label, 0) + 1
            sample.append(r)
    languages = sorted(taken)
    if not languages:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    number = {x: i for i, x in enumerate(languages)}
    rows, labels = [vector(r.text, idf) for r in sample], np.array([number[r.label] for r in sample])
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    w, b = ftrl([rows[i] for i in train], labels[train], len(languages))
    temperature = 1.0
    if held.any() and len(languages) > 1:
        logits = np.stack([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(held)])
        temperature = fit_temperature(logits, labels[held])
    return LanguageModel(languages, idf, w, b, temperature)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text, one row for each row given; und and 0 for null or letterless texts.

    Of equally likely languages the first by name is taken. Rows with a null doc_id or one met before are rows like any other.
    Only the text is looked at: other columns, whatever their names, do not matter.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # FEATURES x languages numbers

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        languages = m[0]
        for pdf in blocks(batches, 512):
            p, known = probabilities(m, _texts(pdf))
            best = p.argmax(axis=1) if languages else np.zeros(len(p), dtype=int)
            known = known & bool(languages)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "lang_pred": [languages[b] if k else "und" for b, k in zip(best, known)],
                "score": [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]})

    return docs.select("doc_id", "text").mapInPandas(predict, "doc_id long, lang_pred string, score double")


def known_languages(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text the model assigns a language with a score of at least `least`.

    Null, empty and letterless texts have no language and go. Repeated rows share their fate; doc_id is not looked at.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for some in slices(batches):
            p, known = probabilities(m, some.column("text").to_pylist())
            yield some.filter(pa.array(known & (p.max(axis=1, initial=0.0) >= least)))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(accepted, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    model = train_language_model(docs, ~held_out(F.col("doc_id")))
    return predict_language(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
