"""Raw records as a stream: from landing files into the landing table and into node tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stelwerk.operators.merge import Store
from stelwerk.sources.raw import SCHEMA


def landing(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def deduplicated(raw: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each record key once. Keys are forgotten once the watermark has passed them, so the state stays bounded; a repeat
    later than that comes through again."""
    return raw.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["_key"])


def counts(raw: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Records per source, kind and window of fetching, final once the watermark has passed the window."""
    by = raw.withWatermark("fetched_at", lateness).groupBy(F.window("fetched_at", window).alias("w"), "source", "kind")
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "source", "kind", "n")


def into_table(counted: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes an aggregate as it stands after each micro-batch over the one before it: a table in the shared folder, not rows
    in the driver."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = counted.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_store(raw: DataFrame, store: Store, plan: Callable[[DataFrame], Mapping[str, DataFrame]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a normalizer over each micro-batch and upserts what it makes into the store, one delta a table and batch (compact
    them when the stream is done). Merging is by key, so a batch that is tried again changes nothing. ``checkpoint`` must be
    a shared folder."""

    def merge(batch: DataFrame, _: int) -> None:
        for table, df in plan(batch).items():
            store.upsert(table, df)

    writer = raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
