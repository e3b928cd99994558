"""From raw documents to sharded training data, every step one of the corpus operators.

Each stage takes the whole table that the one before it kept, applies its decisions and
returns documents again; the last returns the shards. ``run`` writes what a stage
returns to the shared folder and reads it back, so a lost executor costs one stage.
"""

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.llm import decontaminate, jaccard_join, langid, mixing, sharding
from shelfwatch.llm.common import DOCUMENT, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which no language is recognised."""
    return langid.recognised(docs.select(*DOCUMENT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs.select(*DOCUMENT), jaccard_join.COMMON_SHINGLE, jaccard_join.COMMON_SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return decontaminate.decontaminated(docs.select(*DOCUMENT), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As often as the mix takes each document: not at all, once or twice."""
    return mixing.mixed_documents(docs.select(*DOCUMENT))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; the copies of a document stay together."""
    return sharding.contract_rows(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("shard", shard),
]

# A trained network and a packing are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
