"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.

In every stage a null text counts as empty, extra columns of any name are passed on
by all stages but the last, texts are read whole whatever their length, repeated rows
are handled one by one unless the stage says otherwise, and an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailloom.llm import bloomdedup, mixing, oddsketch, packing, quality
from mailloom.llm.staging import mark, settled


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the upper grade is high enough (neither toxic nor junk).

    An empty text has score 0, and stays if the thresholds let it. Equal texts stay or go
    together. Without ratings all documents stay.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of largest id, nulls the smallest; of repeated rows one."""
    return bloomdedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words: the one of smallest id.

    Documents without words stay, and so do those with a null id. Rows that share an id stay or go together.
    """
    return oddsketch.drop_near_duplicates(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; without words, once. Null is a source of its own."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their token ids. A document without words is one end token."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``. Each stage's tables are deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, function in STAGES:
        docs = settled(function(spark, docs, sf_dir), name.replace(" ", "-"), since)
    return docs
