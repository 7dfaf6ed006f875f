"""Schemas of the feeds and of the tables that a run appends to."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

KINDS = {"string": StringType, "timestamp": TimestampType, "date": DateType, "double": DoubleType, "int": IntegerType, "long": LongType, "boolean": BooleanType}


def _of(columns: str) -> StructType:
    """name kind, name kind, ...; all nullable. Unlike a DDL string it needs no session."""
    return StructType([StructField(name, KINDS[kind]()) for name, kind in (c.split() for c in columns.split(","))])


TRANSACTIONS = _of("transaction_id string, event_timestamp timestamp, customer_id string, card_id string, merchant_id string, amount double, currency string, channel string, country string, device_id string, ingestion_timestamp timestamp")
FRAUD_LABELS = _of("transaction_id string, is_fraud int, fraud_type string, label_timestamp timestamp")
CUSTOMERS = _of("customer_id string, signup_date date, home_country string, age_band string, account_tier string")
CARDS = _of("card_id string, customer_id string, issue_date date, card_type string, network string")
MERCHANTS = _of("merchant_id string, name string, category string, country string, risk_band string")

DATA_PROFILE = _of("profiled_at timestamp, column_name string, data_type string, row_count long, null_count long, null_rate double, distinct_count long, min_value string, max_value string, mean_value double")
QUALITY_CHECKS = _of("checked_at timestamp, check_name string, severity string, metric string, observed_value double, min_expected double, max_expected double, passed boolean, description string")
FEATURE_REGISTRY = _of("feature_name string, tier string, owner string, entity string, window_seconds long, description string, materialized_at timestamp")
