"""What the operators share: a scratch folder, written intermediate tables and row keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and is at most this many rows of a few longs.
BROADCAST_ROWS = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; below a local one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-webgauge-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read back: lineage ends here.

    What lies at ``path``, if one is given, is replaced; steps that follow each other take turns between two such paths.
    The shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, name)
    schema, before = df.schema, spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def emptied(spark: SparkSession, *paths: str) -> None:
    """Written tables that nothing needs any more give their space back."""
    for path in paths:
        spark.range(0).write.mode("overwrite").parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a counted frame of narrow rows if it is small; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """The documents, all columns, whose id and further keys are no row of ``gone`` (written); null ids are alike.

    Columns of ``gone`` are taken by place, so it doesn't matter what the documents' further columns are called.
    """
    names = [f"gone_{k}" for k in range(1 + len(keys))]
    gone = maybe_broadcast(gone.toDF(*names), gone.count()).alias("gone_rows")
    numbered = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key_0"), *(k.alias(f"key_{i}") for i, k in enumerate(keys, 1)))
    same = [F.col(f"key_{i}").eqNullSafe(F.col(n)) for i, n in enumerate(names)]
    return numbered.join(gone, reduce(Column.__and__, same), "left_anti").select("row.*")
