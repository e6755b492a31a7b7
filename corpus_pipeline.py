"""From documents to packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of
documents; the last returns pieces of sequences.  Between stages the rows are
written as Parquet in the shared folder and read again, so a lost executor
never costs more than the stage that is under way; what a stage wrote besides is then
taken away.

Every stage takes rows with null or repeated ids and with null texts, and
further columns of any name, which all but the last give back as they are; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartflow.llm import mixing, packing, pii, quality_rules, simhash
from chartflow.llm.common import fresh_folder, mark, remove_written, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those with a null or empty text too.  Repeated rows are judged each; without labels the base rule decides."""
    return quality_rules.keep(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the least id, null ids last; of rows that share it one.  Texts without words are one group."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every row stays."""
    return pii.redact(docs, pii.train(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target shares: a row for each round in which words of a document are taken, arranged by output shard.  Texts without words are not taken; a null source is one."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids.  Rows are packed in the order of their shards; a null text is an end mark alone."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path, since = f"{folder}/{number}-{name}", mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        remove_written(spark, since)
        docs = spark.read.parquet(path)
    return docs


#: Trained models and tokens can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
