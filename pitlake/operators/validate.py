"""Row validation: every rejected row gets exactly one reason, and no row is lost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import ForeignKey, Policy, RowRule


class InvariantError(RuntimeError):
    """Valid and rejected rows don't add up to the input."""


def matched(fk: ForeignKey) -> str:
    return f"_matched_{fk.name}"


def with_dimension_keys(df: DataFrame, keys: tuple[ForeignKey, ...], dims: Mapping[str, DataFrame]) -> DataFrame:
    """Left-join each dimension's distinct keys.

    No side is forced to be broadcast: Spark broadcasts a dimension whose measured size allows it, and otherwise shuffles
    it and splits hot keys at run time."""
    for fk in keys:
        ref = dims[fk.table].select(F.col(fk.reference).alias(matched(fk))).where(F.col(matched(fk)).isNotNull()).distinct()
        df = df.join(ref, F.col(fk.column) == F.col(matched(fk)), "left")
    return df


def violates(rule: RowRule) -> Column:
    """A null verdict counts as a violation."""
    return ~F.coalesce(F.expr(rule.expr), F.lit(False))


def orphan(fk: ForeignKey) -> Column:
    """A null key is no orphan."""
    return F.col(fk.column).isNotNull() & F.col(matched(fk)).isNull()


def reject_reason(policy: Policy) -> Column:
    """The reason of the first broken rule, row rules before foreign keys; null for a valid row."""
    tests = [F.when(violates(r), F.lit(r.reason)) for r in policy.rows] + [F.when(orphan(k), F.lit(k.reason)) for k in policy.foreign_keys]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def tagged(df: DataFrame, policy: Policy, dims: Mapping[str, DataFrame]) -> DataFrame:
    """df and `reject_reason`, in one pass over the rows."""
    with_keys = with_dimension_keys(df, policy.foreign_keys, dims)
    return with_keys.withColumn("reject_reason", reject_reason(policy)).drop(*map(matched, policy.foreign_keys))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)"""
    return rows.where(F.col("reject_reason").isNull()).drop("reject_reason"), rows.where(F.col("reject_reason").isNotNull())


def check_partition(total: int, valid: int, rejected: int) -> None:
    if valid + rejected != total:
        raise InvariantError(f"{valid} valid and {rejected} rejected rows of {total}")
