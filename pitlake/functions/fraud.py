"""Features of the fraud model."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contract import Ctx, feature

fraud = partial(feature, tier="model", owner="fraud")


def over_positive(x: Column, of: Column) -> Column:
    return F.when(of > 0, x / of)


@fraud()
def amount_zscore(f: Ctx) -> Column:
    """How far the amount lies from the customer's mean so far, in standard deviations."""
    return over_positive(F.col("amount") - F.avg("amount").over(f.history), F.stddev("amount").over(f.history))


@fraud()
def amount_vs_max_hist(f: Ctx) -> Column:
    """The amount against the largest so far."""
    return over_positive(F.col("amount"), F.max("amount").over(f.history))


@fraud(window=3600)
def small_amount_burst_1h(f: Ctx) -> Column:
    """The last hour's mean amount against the mean so far."""
    return over_positive(F.avg("amount").over(f.window), F.avg("amount").over(f.history))


@fraud(window=600)
def distinct_merchants_10min(f: Ctx) -> Column:
    """Merchants of the ten minutes before."""
    return F.size(F.collect_set("merchant_id").over(f.window))


@fraud(first_seen=["device_id"])
def is_new_device(f: Ctx) -> Column:
    """Whether the customer shows this device for the first time; null without a device."""
    return F.when(F.col("device_id").isNotNull(), f.is_first("device_id"))


@fraud()
def country_changed(f: Ctx) -> Column:
    """Whether the country differs from the last known one."""
    before = F.last("country", ignorenulls=True).over(f.history)
    return F.when(before.isNotNull(), F.col("country") != before)


@fraud()
def is_foreign(f: Ctx) -> Column:
    """Whether the country differs from the customer's own."""
    return F.col("country") != F.col("home_country")


@fraud()
def hour_of_day(f: Ctx) -> Column:
    """Hour of the transaction, UTC."""
    return F.hour("event_timestamp")


@fraud()
def merchant_is_high_risk(f: Ctx) -> Column:
    """Whether the merchant's risk band is high."""
    return F.col("risk_band") == "high"


@fraud()
def account_age_days(f: Ctx) -> Column:
    """Days since the customer signed up."""
    return F.datediff("event_timestamp", "signup_date")
