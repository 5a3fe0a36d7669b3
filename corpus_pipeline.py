"""Corpus pipeline: the stages that turn ``documents`` into mixed, sharded training
data. Every stage reads what the one before it wrote, as Parquet in the shared folder;
its decisions take effect for all later ones.

1. language: documents without a language, or with less than three tenths of their
   letters in one (text of two or three languages stays), go;
2. near_duplicates: of each SimHash group the document with the smallest id stays;
3. decontaminate: documents that hold a benchmark item go;
4. mix: documents are replicated to the sources' target weights and shuffled;
5. shard: rows are dealt to 16 shards of even bytes, equal texts together.

An empty table passes through all stages. Repeated rows that survive stage 2 (there are
none) and copies made by stage 4 are rows like any other in stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from giftrisk.llm import decontaminate as decon
from giftrisk.llm import language_id, mixing, sharding, simhash_dedup
from giftrisk.llm.common import documents, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicate(docs, shingle=3, max_distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decon.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]

#: Viterbi, SimHash and label propagation have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline_{name}")
    return docs
