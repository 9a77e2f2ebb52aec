"""A corpus from raw documents: language, near duplicates, benchmark passages, source weights, shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import cadenza
from cadenza.llm import balance, decontamination, hilbert, jaccard_trees, language_cnn
from cadenza.llm.common import documents, table
from cadenza.session import materialize

# Lets Python workers run the package's functions when it is not installed on them.
cloudpickle.register_pickle_by_value(cadenza)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without letters go."""
    return language_cnn.keep_recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by shingle similarity, the one with the smallest doc_id."""
    return jaccard_trees.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them."""
    return balance.repeat(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot along the Hilbert curve."""
    return hilbert.shard(docs, 16, carry=docs.columns)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: No SQL: the first stage is a trained network. A test holds every stage against a plain version on all of a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table: its columns, as often as the mix takes each row, with shard and slot.

    Each stage is written and read again before the next. Null texts and texts without letters go in the first stage; a
    null lang or source is a value of its own; rows that repeat an id and text end as one before the mix. An empty table
    gives no rows. Other columns of ``documents`` are carried, less those that the last stage names itself.
    """
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
