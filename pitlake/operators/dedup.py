"""Deduplication by key: one version stays, the others can be quarantined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rules import Dedup


def numbered(df: DataFrame, key: str, order_by: str, keep: str = "latest") -> DataFrame:
    """`_version`: 1 for the row that stays (Spark then keeps one row a key and task before it shuffles). Ties are broken by a hash of all columns, so a second run decides alike."""
    o = F.col(order_by).desc_nulls_last() if keep == "latest" else F.col(order_by).asc_nulls_last()
    return df.withColumn("_version", F.row_number().over(Window.partitionBy(key).orderBy(o, F.xxhash64(*df.columns))))


def split_duplicates(df: DataFrame, rule: Dedup | None) -> tuple[DataFrame, DataFrame]:
    """(one row per key, the other versions with their reason)"""
    if rule is None:
        return df, df.where(F.lit(False)).withColumn("reject_reason", F.lit(None).cast("string"))
    n = numbered(df, rule.key, rule.order_by, rule.keep)
    return n.where("_version = 1").drop("_version"), n.where("_version > 1").drop("_version").withColumn("reject_reason", F.lit(rule.reason))


def versioned(tagged: DataFrame, rule: Dedup | None) -> DataFrame:
    """Rows with reject_reason, where older versions of a valid row get the rule's reason: both verdicts in one pass.

    Rejected rows take no part; they are dealt by a hash, so that those without a key don't meet in one task."""
    if rule is None:
        return tagged
    ok = F.col("reject_reason").isNull()
    o = F.col(rule.order_by).desc_nulls_last() if rule.keep == "latest" else F.col(rule.order_by).asc_nulls_last()
    tie = F.xxhash64(*tagged.columns)
    w = Window.partitionBy(F.when(ok, F.col(rule.key)), F.when(~ok, tie)).orderBy(o, tie)
    return tagged.withColumn("_version", F.row_number().over(w)).withColumn("reject_reason", F.when(ok & (F.col("_version") > 1), F.lit(rule.reason)).otherwise(F.col("reject_reason"))).drop("_version")


def latest(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """The latest row per key, by an aggregation: versions of a hot key meet before they are shuffled."""
    cols = [c for c in df.columns if c not in (key, order_by)]
    best = df.groupBy(key).agg(F.max(F.struct(F.col(order_by), F.xxhash64(*df.columns).alias("_tie"), *cols)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.`{c}`").alias(c) for c in df.columns])
