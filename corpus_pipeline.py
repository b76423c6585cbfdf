"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, whatever these are besides doc_id, text and source. All take
null values in any column, empty and very long texts, repeated rows and empty tables,
as their operators say. ``run`` writes each stage's rows as Parquet to the shared folder,
reads them again for the next one and deletes what the stage worked with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathshade.llm import pieces
from pathshade.llm.mixing import mixed_documents
from pathshade.llm.near_duplicates import without_near_duplicates
from pathshade.llm.queries import PIECE_MODEL
from pathshade.llm.sentences import without_repeats
from pathshade.llm.toxicity import train, without_toxic
from pathshade.session import delete, scratch, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Learns from the labelled rows that are not
    held out; without both classes among them every document stays (or, if all
    are toxic, none). Null and empty texts score what a text without words does."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one row of those that
    repeat it. Rows without an id, and different texts under one id, are told apart; of
    null and empty texts one stays."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of later occurrences of repeated spans go; every row stays, with
    an empty text if nothing is left."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for, in shuffled shards. Null is a
    source of its own; documents without words are left out."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and score of each row; an empty text has no ids."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can express neither the fitted classifier nor the piece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as spent:
            docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        for path in spent[:-1]:  # the last one holds the stage's rows
            delete(spark, path)
    return docs
