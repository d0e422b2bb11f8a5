"""A training corpus in five stages, each over all that the one before it kept.

Every stage but the last returns the columns of ``documents`` and no others: further columns of its input are dropped,
so none can clash with a stage's own.  What a stage decides takes effect on rows and texts.  Texts are read whole,
however long; every stage gives an empty table of its columns for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import langid, neardup, packing, pii, substrings
from shelfmark.llm.shared import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or between two languages, go.  lang becomes the predicted
    one; the model learns from the rows of docs that op10 may learn from.

    Null and empty texts have no letter and go; a null doc_id is judged by its text like any other; repeated rows are
    judged alike; ties between languages go to the alphabetically first, and near ties go altogether; if no row has a
    language to learn from, nothing can be told and every document goes."""
    model = langid.learn(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text", "source", "n_chars"), model)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of least doc_id.

    Texts without a word are in no class and stay; rows that are repeated whole, or share the least doc_id, all stay; a
    row without doc_id goes if its class has one, and stays if the class has none."""
    return neardup.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that an earlier one holds; a text that loses all words goes.

    Texts without a word stay; a row without doc_id keeps its text and takes no passage from others; rows of one doc_id
    take none from one another; n_chars follows the text."""
    return _documents(substrings.deduplicate(docs).where("n_words > n_removed or n_words = 0").drop("n_words", "n_removed", "kept_sha256"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format, with the session's key (pii.KEY_SETTING).

    Every row stays; null texts stay null; equal values get equal pseudonyms in all rows; n_chars follows the text."""
    return _documents(pii.pseudonymize(docs, pii.session_key(spark)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 2048 tokens.

    A null or empty text is one piece, its end token; each repeated row is placed; equal lengths are taken in the order
    of doc_id and piece."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: Signatures, tokens and trained classifiers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
