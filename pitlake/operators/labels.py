"""Labels that arrive late: joined to events, and visible only from the moment they were known."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import latest

LABEL_COLUMNS = ("is_fraud", "fraud_type", "label_timestamp")


def parse_as_of(text: str | None, run_at: datetime) -> datetime:
    """`now` or nothing is the run's time; a time with an offset is converted, one without is UTC."""
    if not text or text == "now":
        return run_at
    at = datetime.fromisoformat(text)
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


def join_labels(events: DataFrame, labels: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Left join of the latest label per key: no event is repeated, whatever the label feed repeats."""
    slim = latest(labels.select(key, *LABEL_COLUMNS).where(F.col(key).isNotNull()), key, "label_timestamp")
    return events.join(slim, key, "left")


def known(as_of: datetime) -> Column:
    """Whether the label was known at as_of; never null."""
    return F.col("label_timestamp").isNotNull() & (F.col("label_timestamp") <= F.lit(as_of).cast("timestamp"))


def labels_as_of(df: DataFrame, as_of: datetime, mask_all: bool = True) -> DataFrame:
    """`label_known` and `is_trainable`; labels that were not known are null.

    With mask_all the fraud type and the label's time are hidden as well, since either gives the label away."""
    mask = LABEL_COLUMNS if mask_all else LABEL_COLUMNS[:1]
    df = df.withColumn("label_known", F.coalesce(known(as_of), F.lit(False)))
    return df.withColumns({c: F.when(F.col("label_known"), F.col(c)) for c in mask}).withColumn("is_trainable", F.col("label_known"))
