"""Incremental loads: what has arrived since the last run, by a file stream that stops when it has caught up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import TableStore


def stream_jsonl(spark: SparkSession, path: str, schema: StructType, loaded_at: datetime | None = None) -> DataFrame:
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_source_file"), (F.lit(loaded_at) if loaded_at else F.current_timestamp()).alias("_bronze_ingested_at"))


def load_new(store: TableStore, rows: DataFrame, table: str, key: str, checkpoint: str, partition: str | None = None, upsert: bool = False, latest_by: str | None = None) -> StreamingQuery:
    """Merge the files that the checkpoint has not seen, then stop. A batch that is run again adds nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if upsert:
            store.merge_upsert(table, batch, key, partition, latest_by)
        else:
            store.merge_insert(table, batch, key, partition)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(rows: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row per key, with state kept as long as the watermark allows."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def events_with_labels(events: DataFrame, labels: DataFrame, key: str = "transaction_id", delay: str = "36 days") -> DataFrame:
    """Stream-stream left join of events and the labels that arrive up to `delay` later."""
    e = events.withWatermark("event_timestamp", "1 day")
    right = labels.withColumnRenamed(key, "_label_key").withWatermark("label_timestamp", "1 day")
    on = (F.col(key) == F.col("_label_key")) & (F.col("label_timestamp") >= F.col("event_timestamp")) & (F.col("label_timestamp") <= F.col("event_timestamp") + F.expr(f"INTERVAL {delay}"))
    return e.join(right, on, "leftOuter").drop("_label_key")


def activity(rows: DataFrame, entity: str, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and amounts per entity and event-time window, closed by the watermark."""
    at = F.window("event_timestamp", window, slide) if slide else F.window("event_timestamp", window)
    return rows.withWatermark("event_timestamp", delay).groupBy(at.alias("w"), F.col(entity)).agg(F.count("*").alias("txn_count"), F.sum("amount").alias("amount_sum")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), entity, "txn_count", "amount_sum")
