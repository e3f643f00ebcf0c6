"""Training-corpus pipeline over ``documents``: five stages, each one operator of ``inkmeter.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes each result as Parquet below the shared checkpoint folder and reads it
back for the next stage.  All stages but the last return the columns of their
input.

1. language_id: documents without a recognised language go.
2. simhash_near_dedup: one document of each group of near copies stays, the one with the smallest doc_id.
3. decontamination: documents that hold a benchmark item go.
4. mixing: every source is read as often as the temperature mixture asks, at least once.
5. token_store: token ids are written as compressed shards and read back, one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.llm import decontam, language, mixing, simhash_pivots, token_store
from inkmeter.llm.common import kept, table
from inkmeter.llm.queries import MAX_EPOCHS, tokenizer_path
from inkmeter.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised.  The model learns from the rows not held out, as in op5."""
    ship_package(spark)
    return language.recognised(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies."""
    ship_package(spark)
    return simhash_pivots.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture reads them."""
    return mixing.mixed(docs, max_epochs=MAX_EPOCHS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and place of every row, read back from the written shards."""
    ship_package(spark)
    return token_store.store_and_read(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_store", token_ids),
]

#: The language stage is a trained model, which SQL cannot express; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
