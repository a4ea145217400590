"""The corpus pipeline: quality, near duplicates, contamination, source weights, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from apexframe.llm.common import stored
from apexframe.llm.decontaminate import drop_contaminated
from apexframe.llm.mixing import mixed_documents
from apexframe.llm.near_dup import keep_one_of_each
from apexframe.llm.quality import fit_quality, keep_good
from apexframe.llm.queries import EVEN, SHARDS, table
from apexframe.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (bad or toxic) go.

    Edge cases: null and empty texts, null metadata and very long texts are scored as they are; repeated rows go or stay together; without labels, or
    on an empty table, nothing goes.
    """
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or equal copies stays: the one with the smallest id.

    Edge cases: null and empty texts are equal to each other, so one stays; a null id stays only where its group has no
    other; of rows that repeat id and text one stays; an empty table stays empty.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go.

    Edge cases: texts without words stay; repeated rows go or stay together; an empty benchmark or table takes nothing away.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents recur as often as their source's weight asks for; each stays at least once.

    Edge cases: a null source is a source of its own; documents and sources without tokens are kept once for each epoch of their source; repeated
    rows recur alike; an empty table stays empty.
    """
    return mixed_documents(docs, even=EVEN)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reading gets its shard and slot.

    Edge cases: null and empty texts have 8 bytes and are linked to nothing; repeated readings are rows like any other and are
    linked as equal texts; an empty table stays empty.
    """
    return shard_documents(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Classifier scores and propagation rounds have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
