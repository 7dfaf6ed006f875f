"""bronze() -> silver() -> gold() over a TableStore, and a command line for them."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fraud, shared  # noqa: F401  registers the features
from ..functions.contract import REGISTRY, Registry
from ..operators.checks import gate, run_checks
from ..operators.dedup import versioned
from ..operators.labels import join_labels, parse_as_of
from ..operators.profile import profile
from ..operators.validate import InvariantError, check_partition, split, tagged
from ..sources.jsonl import read_jsonl
from ..sources.rules import Policy, load_policy
from ..sources.store import TableStore
from .gold import build_base, owner_table, registry_rows, shared_table

DIMENSIONS = {"customers": schemas.CUSTOMERS, "cards": schemas.CARDS, "merchants": schemas.MERCHANTS}


@dataclass(frozen=True)
class Published:
    """What a run reports."""

    counts: dict[str, int]
    table: str = ""


def now() -> datetime:
    return datetime.now(UTC).replace(microsecond=0)


def bronze(spark: SparkSession, store: TableStore, raw: str, run_at: datetime | None = None) -> Published:
    """Load the raw feeds: transactions by insert-only merge, labels by upsert, dimensions as snapshots."""
    run_at = run_at or now()
    store.create_namespace("bronze")
    txn = read_jsonl(spark, f"{raw}/transactions", schemas.TRANSACTIONS, run_at).withColumn("event_date", F.to_date("event_timestamp"))
    labels = read_jsonl(spark, f"{raw}/fraud_labels", schemas.FRAUD_LABELS, run_at).withColumn("label_date", F.to_date("label_timestamp"))
    store.merge_insert("bronze.transactions", txn, "transaction_id", "event_date")
    store.merge_upsert("bronze.fraud_labels", labels, "transaction_id", "label_date", latest_by="label_timestamp")
    for name, schema in DIMENSIONS.items():
        store.replace(f"bronze.{name}", read_jsonl(spark, f"{raw}/dimensions/{name}.jsonl", schema, run_at))
    return Published({t: store.records(t) for t in ("bronze.transactions", "bronze.fraud_labels", *(f"bronze.{d}" for d in DIMENSIONS))})


def validated(bronze_rows: DataFrame, policy: Policy, dims: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine with reject_reason) of a load."""
    return split(versioned(tagged(bronze_rows, policy, dims), policy.dedup))


def silver(spark: SparkSession, store: TableStore, policy: Policy | None = None, run_at: datetime | None = None) -> Published:
    """Validate, quarantine, deduplicate, join labels, check the batch, publish, profile.

    The verdicts are appended before the gate: a stopped run leaves its evidence, and nothing else."""
    run_at = run_at or now()
    policy = policy or load_policy(now=run_at)
    store.create_namespace("silver")
    rows = store.read("bronze.transactions")
    held: list[str] = []

    def frozen(df: DataFrame) -> DataFrame:
        """df, written once beside the tables: it is read several times, and lost executors cost no second validation."""
        out, path = store.stage("silver.transactions", df)
        held.append(path)
        return out

    try:
        tag = frozen(versioned(tagged(rows, policy, {t: store.read(f"bronze.{t}") for t in {k.table for k in policy.foreign_keys}}), policy.dedup))
        unique, rejected = split(tag)
        quarantine = rejected.withColumn("quarantined_at", F.lit(run_at).cast("timestamp"))
        valid = frozen(join_labels(unique, store.read("bronze.fraud_labels")))
        total, n_valid, n_bad = rows.count(), valid.count(), quarantine.count()
        check_partition(total, n_valid, n_bad)
        verdicts, failed = run_checks(spark, policy.checks, rows, valid, quarantine, run_at)
        store.append("silver.quality_checks", verdicts)
        gate(failed)
        store.replace("silver.transactions", valid, "event_date")
        store.replace("silver.quarantine", quarantine)
        store.append("silver.data_profile", profile(store.read("silver.transactions"), run_at))
        reasons = {r[0]: r[1] for r in quarantine.groupBy("reject_reason").count().collect()}
    finally:
        for path in held:
            store.unstage(path)
    return Published({"bronze": total, "valid": n_valid, "quarantine": n_bad, **dict(sorted(reasons.items(), key=lambda x: -x[1]))})


def dimension(store: TableStore, name: str, layers: tuple[str, ...] = ("silver", "bronze")) -> DataFrame:
    """The dimension from the first layer that has it."""
    for layer in layers:
        if store.exists(f"{layer}.{name}"):
            return store.read(f"{layer}.{name}")
    raise LookupError(f"no table {name} in {', '.join(layers)}")


def gold(spark: SparkSession, store: TableStore, as_of: str | None = None, run_at: datetime | None = None, registry: Registry = REGISTRY) -> Published:
    """Compute and publish the shared features, one table per owner, and a snapshot of the registry."""
    run_at = run_at or now()
    at = parse_as_of(as_of, run_at)
    store.create_namespace("gold")
    txn = store.read("silver.transactions")
    base = build_base(txn, dimension(store, "customers"), dimension(store, "merchants"))
    common = store.replace("gold.customer_features", shared_table(base, registry), "event_date")
    counts = {"base": store.records("silver.transactions"), "gold.customer_features": store.records("gold.customer_features")}
    for owner in registry.owners():
        table = store.replace(f"gold.{owner}_features", owner_table(base, common, owner, at, registry), "event_date")
        r = table.agg(F.count(F.lit(1)), F.count_if("is_trainable"), F.count_if(F.col("is_trainable") & (F.col("is_fraud") == 1))).first()
        counts |= {f"gold.{owner}_features": r[0], f"{owner} trainable": r[1], f"{owner} trainable fraud": r[2]}
        if r[0] != counts["base"]:
            raise InvariantError(f"{owner}: {r[0]} rows of {counts['base']}")
    store.append("gold.feature_registry", registry_rows(spark, run_at, registry))
    return Published(counts)


def main(argv: list[str] | None = None) -> None:
    from ..session import session, ship

    p = argparse.ArgumentParser(prog="pitlake", description="Run a layer, or all of them.")
    p.add_argument("layer", choices=["generate", "bronze", "silver", "gold", "all"])
    p.add_argument("--raw", required=True, help="folder of the raw feeds")
    p.add_argument("--store", help="folder of the tables")
    p.add_argument("--rules", type=Path, help="YAML quality policy")
    p.add_argument("--features", type=Path, action="append", default=[], help="package of further features: imported here, shipped to the executors")
    p.add_argument("--as-of", default="now", help="moment from which labels are looked at")
    p.add_argument("--customers", type=int, default=2000)
    p.add_argument("--merchants", type=int, default=300)
    p.add_argument("--days", type=int, default=60)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--dirty-rate", type=float, default=0.0)
    a = p.parse_args(argv)
    spark = session()
    ship(spark, *a.features)
    for folder in a.features:
        importlib.import_module(folder.resolve().name)
    if a.layer == "generate":
        from ..generate import generate

        print(generate(spark, a.raw, a.customers, a.merchants, a.days, a.seed, a.dirty_rate))
        return
    store = TableStore(spark, a.store or f"{a.raw}/tables")
    at = now()
    if a.layer in ("bronze", "all"):
        print("bronze", bronze(spark, store, a.raw, at).counts)
    if a.layer in ("silver", "all"):
        print("silver", silver(spark, store, load_policy(a.rules, at) if a.rules else None, at).counts)
    if a.layer in ("gold", "all"):
        print("gold", gold(spark, store, a.as_of, at).counts)


if __name__ == "__main__":
    main()
