"""A corpus pipeline of five stages: language, exact copies, near copies, personal data, packing.

All stages but the last return the columns of what they get, whatever else these hold. Null and empty texts go at the first
stage, as they have no language; a later stage that is given some treats them as its operator states. Rows with a null id are kept
by every stage that tells rows apart by their ids. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import common, exact_dedup, language_id, ngram_join, packing, pii

#: The key that surrogates of personal data are drawn with.
KEY = "corpus"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go; rows are judged one by one, so repeated rows stay together."""
    return language_id.in_known_language(docs, language_id.fitted(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat both id and text, one."""
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays; rows that share it stay together."""
    groups = ngram_join.jaccard_components(docs)
    lost = common.written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")), "near-lost")
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates, equal ones in equal rows; ``n_chars`` follows the text. No row goes."""
    clean = pii.replace_private(docs, KEY).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: one row per piece of every row."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("private", private),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The tokenizer, the language model and the keyed surrogates are beyond SQL.
ORACLE_SQL = None
