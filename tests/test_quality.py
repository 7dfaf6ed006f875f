from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitlake.operators import checks
from pitlake.operators.dedup import latest, split_duplicates
from pitlake.operators.profile import profile
from pitlake.operators.validate import InvariantError, check_partition, split, tagged
from pitlake.sources.rules import BatchCheck, Dedup, Policy, load_policy

NOW = datetime(2026, 2, 1)
DDL = "transaction_id string, event_timestamp timestamp, amount double, customer_id string, merchant_id string, ingestion_timestamp timestamp"
T = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def dims(spark):
    return {"customers": spark.createDataFrame([("c",), ("c",), (None,)], "customer_id string"), "merchants": spark.createDataFrame([("m",)], "merchant_id string")}


def reasons(spark, dims, rows, policy=None):
    return [r[0] for r in tagged(spark.createDataFrame(rows, DDL), policy or load_policy(now=NOW), dims).select("reject_reason").collect()]


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (("a", T, 1.0, "c", "m", T), None), ((None, T, 1.0, "c", "m", T), "missing key"), (("", T, 1.0, "c", "m", T), "missing key"), (("a", None, 1.0, "c", "m", T), "null event_timestamp"),
        (("a", datetime(2026, 2, 1, 1), 1.0, "c", "m", T), None), (("a", datetime(2026, 2, 1, 1, 0, 1), 1.0, "c", "m", T), "future timestamp"),
        (("a", T, None, None, "m", T), "null amount"), (("a", T, -1.0, "c", "m", T), "negative amount"), (("a", T, 1.0, None, "m", T), "null customer_id"), (("a", T, 1.0, "c", None, T), "null merchant_id"),
        (("a", T, 1.0, "x", "m", T), "unknown customer"), (("a", T, 1.0, "c", "x", T), "unknown merchant"), ((None,) * 6, "missing key"),
    ],
)
def test_first_broken_rule(spark, dims, row, reason):
    assert reasons(spark, dims, [row]) == [reason]


def test_null_verdict_fails_and_no_rules_pass(spark, dims):
    only = load_policy({"row_validations": [{"name": "x", "expr": "amount >= 0", "reason": "bad"}]})
    assert reasons(spark, dims, [("a", T, None, "c", "m", T)], only) == ["bad"]
    assert reasons(spark, dims, [("a", T, None, "c", "m", T)], Policy()) == [None]


def test_keep_latest_and_earliest(spark):
    df = spark.createDataFrame([("a", datetime(2026, 1, 1, 10), 1), ("a", datetime(2026, 1, 1, 11), 2), ("a", None, 3), ("b", None, 4)], "k string, at timestamp, v int")
    kept, older = split_duplicates(df, Dedup("k", "at", "latest", "dup"))
    assert sorted(r.v for r in kept.collect()) == [2, 4] and {(r.v, r.reject_reason) for r in older.collect()} == {(1, "dup"), (3, "dup")}
    assert sorted(r.v for r in split_duplicates(df, Dedup("k", "at", "earliest", "dup"))[0].collect()) == [1, 4]
    assert sorted(r.v for r in latest(df, "k", "at").collect()) == [2, 4]
    assert split_duplicates(df, None)[0].count() == 4 and split_duplicates(df, None)[1].count() == 0


def test_partition_invariant():
    check_partition(3, 2, 1)
    with pytest.raises(InvariantError):
        check_partition(3, 2, 2)


@pytest.mark.parametrize(("v", "lo", "hi", "ok"), [(0.05, None, 0.05, True), (0.0501, None, 0.05, False), (1, 1, None, True), (0.5, 1, None, False), (float("nan"), None, 1, False), (5, None, None, True)])
def test_bounds(v, lo, hi, ok):
    assert checks.passes(v, lo, hi) is ok


def test_metrics_of_empty_tables(spark, dims):
    e = spark.createDataFrame([], DDL + ", is_fraud int, channel string")
    for m in ("row_count", "quarantine_rate", "max_null_rate", "fraud_rate", "labelled_fraud_rate", "max_category_share", "column_mean"):
        c = BatchCheck("x", m, "warn", column="channel" if m == "max_category_share" else "amount", columns=("amount", "customer_id"))
        assert checks.metric(c, e, e, e).first()[0] == 0.0
    with pytest.raises(ValueError):
        checks.metric(BatchCheck("x", "odd", "warn"), e, e, e)


def test_gate(spark):
    df = spark.createDataFrame([(1.0, "pos")], "amount double, channel string")
    rows, failed = checks.run_checks(spark, [BatchCheck("many", "row_count", "critical", min=2), BatchCheck("mean", "column_mean", "warn", max=0.5, column="amount")], df, df, df, NOW)
    assert failed == ["many"] and [r.passed for r in rows.collect()] == [False, False]
    with pytest.raises(checks.GateError, match="many"):
        checks.gate(failed)
    assert checks.run_checks(spark, [], df, df, df, NOW)[0].count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 2.5, "x"), (3, None, None, "x")], "i smallint, s string, d double, _hidden string")
    p = {r.column_name: r for r in profile(df, NOW, exact=True).collect()}
    assert set(p) == {"i", "s", "d"}
    assert (p["i"].min_value, p["i"].max_value, p["i"].mean_value, p["s"].null_rate, p["s"].min_value, p["d"].distinct_count) == ("1", "3", 2.0, 0.5, None, 1)
    assert profile(df.where(F.lit(False)), NOW).collect()[0].null_rate == 0.0


def test_policy_errors():
    with pytest.raises(ValueError):
        load_policy({"batch_checks": [{"name": "x", "metric": "row_count", "severity": "loud"}]})
    p = load_policy()
    assert len(p.rows) == 7 and len(p.foreign_keys) == 2 and len(p.checks) == 7 and load_policy({}).dedup is None


def test_split(spark):
    df = spark.createDataFrame([(1, None), (2, "bad")], "v int, reject_reason string")
    ok, bad = split(df)
    assert ok.columns == ["v"] and bad.count() == 1


def test_other_spelling_of_policy_keys(tmp_path):
    text = """
row_validations:
  - {name: amount_present, expr: "amount IS NOT NULL", reject_reason: "monto nulo"}
referential_checks:
  - {name: customer_exists, column: customer_id, ref_table: customers, ref_column: customer_id, reject_reason: "cliente inexistente"}
deduplication: {key: transaction_id, order_by: ingestion_timestamp, keep: latest, reject_reason: "duplicado"}
batch_checks:
  - {name: bronze_not_empty, severity: critical, metric: row_count, min: 1}
"""
    (tmp_path / "rules.yaml").write_text(text)
    from pitlake.sources.rules import load_policy

    p = load_policy(tmp_path / "rules.yaml")
    assert p.rows[0].reason == "monto nulo" and p.foreign_keys[0].table == "customers" and p.foreign_keys[0].reference == "customer_id" and p.foreign_keys[0].reason == "cliente inexistente"
    assert p.dedup.reason == "duplicado" and p.checks[0].name == "bronze_not_empty"
