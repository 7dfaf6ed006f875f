"""The feature layer: base frame, shared and owners' tables, label maturity, registry snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contract import EVENT_TIME, REGISTRY, TIE_BREAK, FeatureDef, Registry, first_seen
from ..operators.labels import labels_as_of
from ..schemas import FEATURE_REGISTRY

KEYS = ("transaction_id", "customer_id", "event_timestamp", "event_date")
BASE = ("transaction_id", "event_timestamp", "event_date", "customer_id", "merchant_id", "amount", "channel", "country", "is_fraud", "fraud_type", "label_timestamp")


def build_base(txn: DataFrame, customers: DataFrame, merchants: DataFrame) -> DataFrame:
    """Transactions with their customer's and merchant's attributes, and the order key in whole seconds.

    Dimensions are made unique first, so no transaction is repeated; Spark broadcasts them if their size allows it. A
    customer table from before age bands has null ones."""
    band = F.col("age_band") if "age_band" in customers.columns else F.lit(None).cast("string").alias("age_band")
    c = customers.select("customer_id", "home_country", "signup_date", "account_tier", band).dropDuplicates(["customer_id"])
    m = merchants.select("merchant_id", F.col("category").alias("merchant_category"), "risk_band").dropDuplicates(["merchant_id"])
    return txn.join(c, "customer_id", "left").join(m, "merchant_id", "left").withColumn(EVENT_TIME, F.col("event_timestamp").cast("timestamp").cast("long"))


CELLS = 16  # a cell of time is so many windows long; the last of them is looked at from the next cell too


def cell_seconds(defs: Sequence[FeatureDef]) -> int | None:
    """How long cells of time are if all features look back over bounded windows alone, and none reads another; else None."""
    names = {d.name for d in defs}
    for d in defs:
        history, words = d.asks()
        if history or words & names or d.window_seconds is None or d.first_seen:
            return None
    if not defs:
        return None
    return CELLS * max(d.window_seconds for d in defs)


def apply_in_cells(df: DataFrame, defs: Sequence[FeatureDef], entity: str | None, seconds: int) -> DataFrame:
    """Features of bounded windows, with an entity's rows dealt by cells of time: a hot entity is split among tasks.

    A row also enters the next cell where rows of that cell can look back on it; it is dropped there afterwards."""
    t, reach = F.col(EVENT_TIME), seconds // CELLS
    own = F.floor(t / seconds)
    at = lambda cell, guest: F.struct(cell.alias("cell"), F.lit(guest).alias("guest"))
    cells = F.when(t >= (own + 1) * seconds - reach, F.array(at(own, False), at(own + 1, True))).otherwise(F.array(at(own, False)))
    dealt = df.withColumn("_at", F.explode(cells)).withColumn("_cell", F.col("_at.cell"))
    for d in defs:
        dealt = dealt.withColumn(d.name, d.column(entity, ("_cell",)))
    return dealt.where(~F.col("_at.guest")).drop("_at", "_cell")


def apply_features(df: DataFrame, defs: Sequence[FeatureDef], entity: str | None = None) -> tuple[DataFrame, list[str]]:
    """df with the features added one after the other (a later one can read an earlier one), and their names.

    The rows are dealt by entity once; helper columns and all windows over that entity then share the exchange. Where all
    features have bounded windows, rows are dealt by time as well."""
    if seconds := cell_seconds(defs):
        return apply_in_cells(df, defs, entity, seconds), [d.name for d in defs]
    helped: set[tuple[str, str]] = set()
    for d in defs:
        key = entity or d.entity
        for c in d.first_seen:
            if (key, c) not in helped:
                if not helped:
                    df = df.repartition(key)
                helped.add((key, c))
                w = Window.partitionBy(key, c).orderBy(EVENT_TIME, TIE_BREAK)
                df = df.withColumn(first_seen(c), F.col(c).isNotNull() & (F.row_number().over(w) == 1))
        df = df.withColumn(d.name, d.column(entity))
    return df.drop(*{first_seen(c) for _, c in helped}), [d.name for d in defs]


def shared_table(base: DataFrame, registry: Registry = REGISTRY, keys: Sequence[str] = KEYS) -> DataFrame:
    df, names = apply_features(base, registry.registered(tier="shared"))
    return df.select(*keys, *names)


def owner_table(base: DataFrame, shared: DataFrame, owner: str, as_of: datetime, registry: Registry = REGISTRY, columns: Sequence[str] = BASE, mask_all: bool = True) -> DataFrame:
    """An owner's features beside the shared ones, with the labels that were known at as_of."""
    own, names = apply_features(base, registry.registered(owner=owner))
    both = own.select(*columns, *names).join(shared.drop(*[k for k in KEYS if k != "transaction_id"]), "transaction_id", "inner")
    return labels_as_of(both, as_of, mask_all)


def registry_rows(spark: SparkSession, run_at: datetime, registry: Registry = REGISTRY) -> DataFrame:
    """The declarations as a table; appended once a run."""
    return spark.createDataFrame([(d.name, d.tier, d.owner, d.entity, d.window_seconds, d.description, run_at) for d in registry.registered()], FEATURE_REGISTRY)
