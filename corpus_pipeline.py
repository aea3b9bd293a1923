"""A training-data pipeline over the documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm.common import free, materialize, small_batches, table, written
from quernel.llm.decontaminate import decontaminate
from quernel.llm.ngram_join import deduplicate
from quernel.llm.quality_knn import keep_good
from quernel.llm.sharding import shard
from quernel.llm.source_mix import mix_sources

SHARDS = 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose labelled neighbours vote for low quality or for toxic."""
    return keep_good(docs, table(small_batches(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source schedule takes it, once at least."""
    return mix_sources(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document."""
    return shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
    ("sharding", sharding),
]
#: The classifier's latent space can't be written in SQL; a test holds run() against plain loops over all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Nulls, empty texts, repeated rows and other columns are treated as each stage's operator says; a
    column called ``shard`` is replaced. Empty tables give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    before = written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        free(spark, before)  # what the stage used, and its input, now that its result stands
    return STAGES[-1][1](spark, docs, sf_dir)
