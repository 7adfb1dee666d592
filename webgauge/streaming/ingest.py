"""Pages as they are fetched: a stream of files audited batch by batch, live counts, and first sightings of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webgauge.operators.audit import facts
from webgauge.sources.tables import SCHEMAS, Store


def page_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of pages in a folder."""
    return spark.readStream.schema(SCHEMAS["pages"]).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def ingest(pages: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends each batch to the store; a page that is there already is ignored, so a repeated batch changes nothing."""
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: store.insert_ignore("pages", df)).start()


def live_counts(pages: DataFrame) -> DataFrame:
    """run_id, pages, auditable: how far each run is."""
    return pages.groupBy("run_id").agg(F.count("*").alias("pages"), F.count("html").alias("auditable"))


def state_on_disk(spark: SparkSession) -> None:
    """Keyed state goes to RocksDB on the executors' disks, with its changes in the checkpoint: it may outgrow memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def first_sightings(pages: DataFrame, late: str | None = None) -> DataFrame:
    """Each address of a run once, whenever it comes again: the state keeps all addresses, as text, so nothing is mistaken for another.

    With ``late``, only repeats within that much event time are known, and the state forgets what is older. For the exact form call ``state_on_disk`` first.
    """
    if late is None:
        return pages.dropDuplicates(["run_id", "url"])
    return pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["run_id", "url"])


def fact_stream(pages: DataFrame) -> DataFrame:
    """Facts of pages as they come; the rules across pages wait for the run's end."""
    return facts(pages)


def windowed_failures(pages: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Failed and all fetches by window of event time."""
    w = pages.withWatermark("fetched_at", late).groupBy("run_id", F.window("fetched_at", width))
    return w.agg(F.count("*").alias("pages"), F.count_if((F.col("status") >= 400) | (F.col("status") == 0)).alias("failures"))
