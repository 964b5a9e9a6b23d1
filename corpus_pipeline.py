"""A corpus pipeline over the table documents: toxic documents go, exact and near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from loamline.llm.common import shared_folder, table
from loamline.llm.queries import piece_model


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is trained on the labels of the stage's own documents.

    Rows with a null or empty text are scored like any other; repeated rows all stay or go; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside; null and empty texts are one group."""
    return exact_dedup.dedup(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at 80 % similarity of five-word shingles; texts without words and rows without doc_id stay."""
    return ngram_join.leave_one(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole texts; those without words are not taken."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each document of the mix, one row for each copy."""
    return pieces.encode(docs, piece_model())


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("ngram_jaccard_join", near_copies_out),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The classifier and the vocabulary can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
