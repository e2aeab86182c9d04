"""Confirm events as a stream: counts by window with late events, and a memory that learns as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Confirm events from parquet files as they appear: in the folder ``name`` in ``folder``, or files of that name in it."""
    there = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", 16)
    if any(f.endswith(f"/{name}") for f in there.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")


def once(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each event once; state is kept for ``lateness``, and repeats that come later count again."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def counted(events: DataFrame, lateness: str = "7 days", window: str = "1 day") -> DataFrame:
    """(day, state, arrivals) by window of the events' time; later than ``lateness`` ones are let go."""
    by = events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), F.coalesce("state", F.lit("unchanged")).alias("state"))
    return by.agg(F.count("*").alias("arrivals")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "state", "arrivals")


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """What a stream holds when all that is there has been read.

    Each batch is written to the shared folder under its number, so that a batch that is repeated gives the same; of a complete
    stream the last batch counts, of an appending one all do. Nothing of it goes through the driver.
    """
    out = f"{folder}/rows"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*")
    if mode == "complete" and query.lastProgress:
        rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/batch={query.lastProgress['batchId']}")
    return rows.select(*stream.columns)


def learn(events: DataFrame, segments: DataFrame, memory_path: str, checkpoint: str):
    """Teach the memory at ``memory_path`` with each batch of events; a batch's version is written beside it and then named.

    The memory is read at the version of the last batch, so a batch that is repeated after a failure gives the same.
    """
    from weftwork.operators.learn import merged, taught

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{memory_path}/version={number}")
        merged(before, taught(batch, segments)).write.mode("overwrite").parquet(f"{memory_path}/version={number + 1}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
