"""From raw documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept; all but the last return the columns of
`documents`. Toxic documents go, then documents of low quality, then all but the first document
of each group of near copies; the rest are repeated or left out as the mix of languages asks, and
what remains is packed into sequences. Each stage's result is written and read again, so a lost
executor costs one stage's tasks at most.

The stages fit their models on the documents they are given and on the table `labels`. SQL cannot
express them; the tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfindex.llm import jaccard, mixing, packing, quality, toxicity
from shelfindex.llm.common import kept
from shelfindex.llm.queries import MIX, WORD_VOCABULARY


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.accepted(docs, labels(spark, sf_dir))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be of low quality."""
    return quality.accepted(docs, labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.first_of_groups(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix asks."""
    return mixing.mixed(docs, MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", harmless),
    ("quality", good),
    ("ngram_jaccard_join", distinct),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
