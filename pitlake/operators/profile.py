"""Column profiles, all columns in one pass."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def profile(df: DataFrame, run_at: datetime, exact: bool = False) -> DataFrame:
    """One row per column whose name doesn't begin with `_`: counts, null rate, distinct values (approximate unless
    exact), and for numbers minimum, maximum and mean. One aggregation, then one row is turned into many."""
    fields = [f for f in df.schema.fields if not f.name.startswith("_")]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, f in enumerate(fields):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NumericType)
        aggs += [F.count(c).alias(f"n{k}"), distinct(c).alias(f"d{k}")]
        aggs += [g(c).alias(f"{p}{k}") if number else F.lit(None).alias(f"{p}{k}") for p, g in (("lo", F.min), ("hi", F.max), ("avg", F.avg))]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("_n").cast("long").alias("row_count"), (F.col("_n") - F.col(f"n{k}")).cast("long").alias("null_count"),
            F.when(F.col("_n") > 0, F.round(1 - F.col(f"n{k}") / F.when(F.col("_n") > 0, F.col("_n")), 6)).otherwise(0.0).alias("null_rate"), F.col(f"d{k}").cast("long").alias("distinct_count"),
            F.col(f"lo{k}").cast("string").alias("min_value"), F.col(f"hi{k}").cast("string").alias("max_value"), F.col(f"avg{k}").cast("double").alias("mean_value"),
        )
        for k, f in enumerate(fields)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(run_at).cast("timestamp").alias("profiled_at"), "r.*")
