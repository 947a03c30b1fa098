"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet into the shared folder and hands
it on. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import materialise, table
from marketloom.llm.decontaminate import find_contamination
from marketloom.llm.language import known_languages, train_language_model
from marketloom.llm.lines import TEXT_KEY, clean_lines
from marketloom.llm.neardup import near_duplicate_rows
from marketloom.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language is less likely than not, go."""
    return known_languages(docs, train_language_model(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go from the texts; a document that loses all its lines goes too."""
    lost = (F.col("_clean.n_removed") > 0) & (F.col("_clean.n_removed") == F.col("_clean.n_lines"))
    kept = clean_lines(docs).filter(~lost)
    return kept.withColumns({"text": F.col("_clean.text"), "n_chars": F.length("_clean.text").cast("long")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one with the least doc_id."""
    gone = near_duplicate_rows(docs, size=5, percent=80).filter("NOT kept").select("doc_id", TEXT_KEY)
    return docs.withColumn(TEXT_KEY, F.xxhash64("text")).join(gone, ["doc_id", TEXT_KEY], "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, verbatim or with other values, go."""
    gone = find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 ids, along the Hilbert curve."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("packing", packing)]

#: Language ID and packing cannot be said in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
