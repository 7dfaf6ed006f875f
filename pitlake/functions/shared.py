"""Features that every model gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contract import EVENT_TIME, Ctx, feature


@feature(tier="shared", windows=[300, 600, 3600, 86400])
def txn_count(f: Ctx) -> Column:
    """Transactions in the window."""
    return F.count("*").over(f.window)


@feature(tier="shared", windows=[300, 3600, 86400])
def amount_sum(f: Ctx) -> Column:
    """Amount spent in the window; 0 without transactions."""
    return F.coalesce(F.sum("amount").over(f.window), F.lit(0.0))


@feature(tier="shared", windows=[3600, 86400])
def amount_avg(f: Ctx) -> Column:
    """Mean amount in the window."""
    return F.avg("amount").over(f.window)


@feature(tier="shared")
def amount_avg_hist(f: Ctx) -> Column:
    """Mean amount so far."""
    return F.avg("amount").over(f.history)


@feature(tier="shared")
def amount_std_hist(f: Ctx) -> Column:
    """Sample standard deviation of the amounts so far."""
    return F.stddev("amount").over(f.history)


@feature(tier="shared")
def txn_count_hist(f: Ctx) -> Column:
    """Transactions so far."""
    return F.count("*").over(f.history)


@feature(tier="shared")
def minutes_since_prev_txn(f: Ctx) -> Column:
    """Minutes since the transaction before."""
    return (F.col(EVENT_TIME) - F.lag(EVENT_TIME, 1).over(f.ordered)) / 60.0


@feature(tier="shared")
def prev_country(f: Ctx) -> Column:
    """The last known country before this transaction."""
    return F.last("country", ignorenulls=True).over(f.history)


@feature(tier="shared", first_seen=["device_id"])
def distinct_devices_hist(f: Ctx) -> Column:
    """Devices seen so far: a running sum of first sightings, linear in the history."""
    return F.coalesce(F.sum(f.is_first("device_id").cast("long")).over(f.history), F.lit(0).cast("long"))
