"""From raw documents to a training mix, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet in the shared folder and reads it
back as the next stage's docs. All but the last keep the columns of documents, whatever further ones it has.

Defined results: a null, empty or blank text is rejected by the first stage. Rows that share an id are judged each by its own
text in the first and fourth stage; in the second and third they are one node, never each other's copies. A row without
an id is nobody's copy and loses nothing to substring removal. Empty tables give empty results, and an empty
benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgauge.llm import decontam, minhash, mixing, quality, substring_dedup
from webgauge.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the smallest id stays."""
    return minhash.first_of_each(docs)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has are cut; a document with nothing left goes."""
    return substring_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words, with repeats, the mix takes of each remaining document."""
    return mixing.sample(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_repeats", substring_repeats),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: SQL can't express the first stage, whose weights are estimated step by step.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
