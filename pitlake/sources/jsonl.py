"""JSON Lines feeds with imposed schemas and row lineage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, loaded_at: datetime | None = None) -> DataFrame:
    """All files below path, and two lineage columns: `_source_file` and `_bronze_ingested_at`.

    Folder names are not taken as columns. A broken line becomes a row of nulls (which the key rule rejects later), a
    mistyped field a null, an unknown field nothing. Without loaded_at, the load time is the query's."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_source_file"), (F.lit(loaded_at) if loaded_at else F.current_timestamp()).alias("_bronze_ingested_at"))


def write_jsonl(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON object per line; timestamps in UTC with whole seconds."""
    w = df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").option("ignoreNullFields", "false")
    (w.partitionBy(partition) if partition else w).json(path)
