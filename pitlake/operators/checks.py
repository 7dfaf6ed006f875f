"""Batch checks: metrics of a whole load against bounds, and the gate that a critical failure closes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUALITY_CHECKS
from ..sources.rules import BatchCheck


class GateError(RuntimeError):
    """A critical check failed; nothing may be published."""


def ratio(x: Column, of: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.when(of > 0, x / F.when(of > 0, of)).otherwise(F.lit(0.0))


def null_rate(columns: Sequence[str]) -> Column:
    """The largest share of nulls among the columns."""
    n = F.count(F.lit(1))
    rates = [ratio(n - F.count(F.col(c)), n) for c in columns]
    return F.greatest(*rates) if len(rates) > 1 else rates[0]


def fraud_share(of_labelled: bool) -> Column:
    return ratio(F.count_if(F.col("is_fraud") == 1), F.count("is_fraud") if of_labelled else F.count(F.lit(1)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("value"))


def max_null_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The largest share of nulls among the columns, in one pass."""
    return df.agg(null_rate(columns).alias("value"))


def max_category_share(df: DataFrame, column: str) -> DataFrame:
    """The largest group's share; nulls are a group."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("value"))


def column_mean(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("value"))


def fraud_rate(valid: DataFrame, of_labelled: bool = False) -> DataFrame:
    """Fraud among all valid rows, or among labelled ones."""
    return valid.agg(fraud_share(of_labelled).alias("value"))


def quarantine_rate(bronze: DataFrame, quarantine: DataFrame) -> DataFrame:
    n, none = F.count(F.lit(1)), F.lit(0).cast("long")
    both = bronze.agg(n.alias("n"), none.alias("q")).unionAll(quarantine.agg(none.alias("n"), n.alias("q")))
    return both.agg(ratio(F.sum("q"), F.sum("n")).alias("value"))


def metrics(checks: Sequence[BatchCheck], bronze: DataFrame, valid: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(k, value) for check number k: one pass over the load, one over the valid rows, and one more for each category."""
    of_bronze, of_valid, parts = [], [], []
    for k, c in enumerate(checks):
        match c.metric:
            case "row_count":
                of_bronze.append((k, F.count(F.lit(1))))
            case "max_null_rate":
                of_bronze.append((k, null_rate(c.columns)))
            case "fraud_rate" | "labelled_fraud_rate":
                of_valid.append((k, fraud_share(c.metric != "fraud_rate")))
            case "column_mean":
                of_valid.append((k, F.coalesce(F.avg(c.column), F.lit(0.0))))
            case "max_category_share":
                parts.append(max_category_share(valid, c.column).select(F.lit(k).alias("k"), F.col("value").cast("double")))
            case "quarantine_rate":
                parts.append(quarantine_rate(bronze, quarantine).select(F.lit(k).alias("k"), F.col("value").cast("double")))
            case _:
                raise ValueError(f"check {c.name}: unknown metric {c.metric}")
    for df, some in ((bronze, of_bronze), (valid, of_valid)):
        if some:
            one = df.agg(F.array(*[F.struct(F.lit(k).alias("k"), x.cast("double").alias("value")) for k, x in some]).alias("all"))
            parts.append(one.select(F.explode("all").alias("x")).select("x.k", "x.value"))
    return reduce(DataFrame.unionAll, parts)


def metric(check: BatchCheck, bronze: DataFrame, valid: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The metric of one check as one row: value."""
    return metrics([check], bronze, valid, quarantine).select("value")


def passes(value: float, low: float | None, high: float | None) -> bool:
    """Bounds are inclusive and optional; a value that is no finite number fails."""
    return value is not None and math.isfinite(value) and (low is None or value >= low) and (high is None or value <= high)


def run_checks(spark: SparkSession, checks: Sequence[BatchCheck], bronze: DataFrame, valid: DataFrame, quarantine: DataFrame, run_at: datetime) -> tuple[DataFrame, list[str]]:
    """(verdicts, names of failed critical checks). All metrics are one query."""
    if not checks:
        return spark.createDataFrame([], QUALITY_CHECKS), []
    values = {r["k"]: r["value"] for r in metrics(checks, bronze, valid, quarantine).collect()}
    rows, failed = [], []
    for k, c in enumerate(checks):
        ok = passes(values[k], c.min, c.max)
        rows.append((run_at, c.name, c.severity, c.metric, values[k], None if c.min is None else float(c.min), None if c.max is None else float(c.max), ok, c.description))
        if not ok and c.severity == "critical":
            failed.append(c.name)
    return spark.createDataFrame(rows, QUALITY_CHECKS), failed


def gate(failed: list[str]) -> None:
    if failed:
        raise GateError(f"critical checks failed: {', '.join(failed)}")
