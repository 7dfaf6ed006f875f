"""Merges as plain DataFrame algebra, for tables of any kind."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merge_insert_only(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target and the rows of source whose key it lacks. Null keys match nothing."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def merge_upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """source, and the rows of target whose key it lacks."""
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(source)


def not_yet_published(rows: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """The rows whose key has not been published: the incremental form of deduplication."""
    return rows.join(published.select(key), key, "left_anti")
