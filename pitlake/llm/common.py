"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, ship

# The byte classes that the operators' contracts name.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Maps a byte to its lower case where it belongs to an alphanumeric word (0-9, a-z, any non-ASCII byte) and to a blank elsewhere.
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the session ends."""
    path = shared_path(spark, "llm")
    _made.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


def bounded(spark: SparkSession) -> None:
    """Prepare a session for Python stages: ship the code, and keep what passes between Spark and Python small, since a batch is held several times over while it is worked on.

    The two settings are read when a frame runs, which is after this returns, so they stay; smaller ones that the caller
    chose are left alone."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_dir() made and that no frame reads any more."""
    _remove(spark, path)


def staged(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write df to path and read it back: the lineage ends there, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_name(doc_id: Column, text: Column) -> Column:
    """128 bits of doc_id and text: rows that agree in both have one name."""
    mark = lambda x: F.when(x.isNull(), "-").otherwise("+")
    as_text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(mark(doc_id), F.length(as_text).cast("string"), mark(text), as_text, F.coalesce(text, F.lit(""))).cast("binary")))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def flat(parts: list[np.ndarray], dtype: object) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
