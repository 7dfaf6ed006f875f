from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from pitlake.functions.contract import REGISTRY, Ctx, Registry, feature, registered, window_label
from pitlake.operators.labels import join_labels, labels_as_of, parse_as_of
from pitlake.plans.gold import apply_features, build_base, owner_table, registry_rows, shared_table
from pitlake.plans.queries import MODEL, SHARED

GOLDEN = [
    ("t1", "2026-01-01 10:00:00", 10.0, "d1", "MX", "m1"), ("t2", "2026-01-01 10:04:00", 20.0, None, "MX", "m2"), ("t3", "2026-01-01 10:04:00", 30.0, "d2", "US", "m1"),
    ("t4", "2026-01-01 10:59:59", 40.0, "d1", None, "m3"), ("t5", "2026-01-01 11:00:00", 50.0, "d1", "US", "m3"),
]
EXPECTED = {
    "txn_count_5min": [0, 1, 1, 0, 1], "txn_count_1h": [0, 1, 1, 3, 4], "amount_sum_5min": [0.0, 10.0, 10.0, 0.0, 40.0], "amount_avg_1h": [None, 10.0, 10.0, 20.0, 25.0], "amount_avg_hist": [None, 10.0, 15.0, 20.0, 25.0],
    "amount_std_hist": [None, None, 7.0710678118654755, 10.0, 12.909944487358056], "txn_count_hist": [0, 1, 2, 3, 4], "minutes_since_prev_txn": [None, 4.0, 0.0, 55.983333333333334, 0.016666666666666666],
    "prev_country": [None, "MX", "MX", "US", "US"], "distinct_devices_hist": [0, 1, 1, 2, 2], "is_new_device": [True, None, True, False, False], "distinct_merchants_10min": [0, 1, 1, 0, 1], "amount_vs_max_hist": [None, 2.0, 1.5, 1.3333333333333333, 1.25],
}


def base_of(spark, rows):
    df = spark.createDataFrame([(a, datetime.fromisoformat(b), c, d, e, f, "c1") for a, b, c, d, e, f in rows], "transaction_id string, event_timestamp timestamp, amount double, device_id string, country string, merchant_id string, customer_id string")
    df = df.withColumns({"event_date": F.to_date("event_timestamp"), "channel": F.lit("pos"), "is_fraud": F.lit(0), "fraud_type": F.lit(None).cast("string"), "label_timestamp": F.lit(None).cast("timestamp")})
    customers = spark.createDataFrame([("c1", "MX", date(2025, 12, 1), "gold"), ("c1", "MX", date(2025, 12, 1), "gold")], "customer_id string, home_country string, signup_date date, account_tier string")
    merchants = spark.createDataFrame([("m1", "luxury", "high"), ("m2", "fuel", "low")], "merchant_id string, category string, risk_band string")
    return build_base(df, customers, merchants)


def values(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["transaction_id"])]


@pytest.fixture(scope="module")
def golden(spark):
    return apply_features(base_of(spark, GOLDEN), registered())[0].cache()


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_golden(golden, name):
    assert values(golden, name) == EXPECTED[name]


def test_row_features(golden):
    assert values(golden, "is_foreign") == [False, False, True, None, True]
    assert values(golden, "merchant_is_high_risk") == [True, False, True, None, None]
    assert values(golden, "account_age_days") == [31] * 5
    assert values(golden, "hour_of_day") == [10, 10, 10, 10, 11]
    assert values(golden, "country_changed") == [None, False, True, None, False]


def test_duplicate_dimension_rows_repeat_nothing(golden):
    assert golden.count() == 5


def test_later_rows_change_nothing_before(spark, golden):
    names = [d.name for d in registered()]
    changed = GOLDEN[:3] + [("t4", "2026-01-01 10:59:59", 999.0, "d9", "BR", "m2"), ("t6", "2026-01-01 12:00:00", 1.0, "d3", "US", "m1")]
    again = apply_features(base_of(spark, changed), registered())[0]
    for n in names:
        assert values(again, n)[:3] == values(golden, n)[:3]


def test_order_and_partitions_of_input_change_nothing(spark, golden):
    again = apply_features(base_of(spark, GOLDEN[::-1]).repartition(3), registered())[0]
    assert all(values(again, d.name) == values(golden, d.name) for d in registered())


def test_catalogue():
    assert len(SHARED) == 15 and len(MODEL) == 10 and REGISTRY.owners() == ["fraud"]


def test_window_labels():
    assert [window_label(x) for x in (90, 300, 5400, 3600, 86400)] == ["90s", "5min", "90min", "1h", "24h"]


@pytest.mark.parametrize("kw", [{"tier": "shared", "window": 1, "windows": [1]}, {"tier": "model"}, {"tier": "odd"}, {"tier": "shared", "windows": []}, {"tier": "shared", "window": 0}, {"tier": "shared", "windows": [60, -1]}])
def test_refused_declarations(kw):
    with pytest.raises(ValueError):
        feature(**kw, registry=Registry())(lambda f: F.lit(1))


def test_names_are_unique_and_not_taken():
    r = Registry(reserved=frozenset({"amount"}))
    feature(tier="shared", name="a", registry=r)(lambda f: F.lit(1))

    def other(f):
        """Other.

        More."""

    with pytest.raises(ValueError):
        feature(tier="shared", name="a", registry=r)(other)
    with pytest.raises(ValueError):
        feature(tier="shared", name="amount", registry=r)(other)
    feature(tier="shared", windows=[60, 3600], registry=r)(other)
    assert [(d.name, d.description) for d in r.registered()][1:] == [("other_1min", "Other."), ("other_1h", "Other.")]


def test_later_feature_reads_an_earlier_one(spark):
    r = Registry()
    feature(tier="shared", name="twice", registry=r)(lambda f: f.col("amount") * 2)
    feature(tier="shared", name="thrice", registry=r)(lambda f: f.col("twice") * 1.5)
    assert values(apply_features(base_of(spark, GOLDEN), r.registered())[0], "thrice") == [30.0, 60.0, 90.0, 120.0, 150.0]


def test_another_entity(spark):
    df, _ = apply_features(base_of(spark, GOLDEN), [d for d in registered() if d.name == "txn_count_hist"], entity="merchant_id")
    assert values(df, "txn_count_hist") == [0, 0, 1, 0, 1]


def test_owner_table_and_maturity(spark):
    base = base_of(spark, GOLDEN).withColumns({"is_fraud": F.lit(1), "fraud_type": F.lit("x"), "label_timestamp": F.when(F.col("transaction_id") != "t5", F.lit(datetime(2026, 1, 20)))})
    shared = shared_table(base)
    early, late = (owner_table(base, shared, "fraud", at).collect() for at in (datetime(2026, 1, 15, tzinfo=UTC), datetime(2026, 2, 1, tzinfo=UTC)))
    assert len(early[0]) == 11 + 10 + 15 + 2
    assert not any(r.is_trainable or r.is_fraud or r.fraud_type or r.label_timestamp for r in early)
    assert sorted((r.transaction_id, r.is_trainable, r.is_fraud) for r in late) == [(f"t{k}", k < 5, 1 if k < 5 else None) for k in range(1, 6)]
    assert {r.label_known for r in early} == {False}


def test_masking_of_the_label_alone(spark):
    base = base_of(spark, GOLDEN).withColumns({"is_fraud": F.lit(1), "fraud_type": F.lit("x"), "label_timestamp": F.lit(datetime(2026, 1, 20))})
    r = labels_as_of(base, datetime(2026, 1, 1, tzinfo=UTC), mask_all=False).first()
    assert r.is_fraud is None and r.fraud_type == "x"


def test_repeated_labels_repeat_no_event(spark):
    ev = spark.createDataFrame([("a",), ("b",), (None,)], "transaction_id string")
    lab = spark.createDataFrame([("a", 0, None, datetime(2026, 1, 1)), ("a", 1, "x", datetime(2026, 1, 2)), (None, 1, "x", None)], "transaction_id string, is_fraud int, fraud_type string, label_timestamp timestamp")
    assert sorted(((r[0] or "", r[1]) for r in join_labels(ev, lab).collect())) == [("", None), ("a", 1), ("b", None)]


def test_as_of():
    now = datetime(2026, 3, 1, tzinfo=UTC)
    assert parse_as_of("now", now) == parse_as_of(None, now) == now
    assert parse_as_of("2026-02-15", now) == datetime(2026, 2, 15, tzinfo=UTC)
    assert parse_as_of("2026-02-15T00:00:00+02:00", now) == datetime(2026, 2, 14, 22, tzinfo=UTC)


def test_registry_rows(spark):
    assert registry_rows(spark, datetime(2026, 1, 1)).count() == 25


def test_context_without_window_is_history():
    assert repr(Ctx().window) is not None and Ctx("a", 60).window_seconds == 60


def test_bounded_windows_are_dealt_by_time(spark):
    """Cells of time change no value, and a hot entity's rows go to many tasks."""
    import random

    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from pitlake.functions.contract import EVENT_TIME
    from pitlake.plans.gold import apply_features, cell_seconds

    own = Registry()

    @feature(owner="o", entity="channel", windows=[60, 300], registry=own)
    def seen(f):
        return F.count("*").over(f.window)

    @feature(owner="o", entity="channel", window=300, registry=own)
    def spent(f):
        return F.sum(f.col("amount")).over(f.window)

    rng = random.Random(1)
    rows = [(k, "hot" if k % 9 else "cold", rng.choice([None, -5, 0, 4799, 4800, 4801]) if k % 50 == 0 else rng.randrange(-9000, 40_000), float(k % 7)) for k in range(3000)]
    df = spark.createDataFrame(rows, f"transaction_id long, channel string, {EVENT_TIME} long, amount double")
    defs = own.registered()
    assert cell_seconds(defs) == 4800
    got = {r.transaction_id: (r.seen_1min, r.seen_5min, r.spent) for r in apply_features(df, defs)[0].collect()}
    w = lambda s: Window.partitionBy("channel").orderBy(EVENT_TIME).rangeBetween(-s, -1)
    plain = df.select("transaction_id", F.count("*").over(w(60)), F.count("*").over(w(300)), F.sum("amount").over(w(300)))
    assert got == {r[0]: tuple(r[1:]) for r in plain.collect()}

    @feature(owner="o", entity="channel", window=300, registry=own)
    def against_history(f):
        return F.sum("amount").over(f.window) / F.count("*").over(f.history)

    @feature(owner="o", entity="channel", window=300, registry=own)
    def reads_another(f):
        return f.col("spent") + 1

    assert cell_seconds(own.registered()[:3]) and cell_seconds(own.registered()[:4]) is None
    assert cell_seconds([d for d in own.registered() if d.name in ("spent", "reads_another")]) is None
