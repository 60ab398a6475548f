"""A training-data pipeline over ``documents``: language ID, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and its result, written and read again, is the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, simhash
from tessera.llm.common import remove_folder, shared_folder, table
from tessera.llm.queries import tokenizer

#: A document in which no language has a third of the words is noise; one of two or three parts in as many languages isn't.
LEAST_SCORE = 0.34


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in which no learned language has LEAST_SCORE of the words. Of three or more learned
    languages one can have less than that; if no document has a language, those with letters all stay."""
    return langid.keep(docs, langid.learn(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, or not at all."""
    return mixing.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("mixing", mixed), ("best_fit_packing", packed)]

#: The language model and the tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet beside the session's checkpoints. A stage's folder goes when the next
    one is written; the last one is what the result is read from."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
