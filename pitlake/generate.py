"""A deterministic source of raw feeds, made by Spark: every value is a hash of the seed and the row's number."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sources.jsonl import write_jsonl

# The domains of the feeds and their weights.
COUNTRIES = {"MX": 0.55, "US": 0.20, "CO": 0.08, "AR": 0.06, "CL": 0.05, "PE": 0.03, "BR": 0.03}
AGE_BANDS = {"18-25": 0.2, "26-35": 0.3, "36-45": 0.25, "46-60": 0.17, "60+": 0.08}
TIERS = {"standard": 0.70, "gold": 0.22, "platinum": 0.08}
RATES = {"standard": 0.8, "gold": 1.6, "platinum": 2.8}
CHANNELS = {"pos": 0.55, "online": 0.35, "atm": 0.10}
CATEGORIES = ["grocery", "fuel", "restaurant", "electronics", "travel", "pharmacy", "fashion", "services", "gambling", "luxury"]
DEFECTS = ["missing_key", "null_event_ts", "future_event_ts", "null_amount", "negative_amount", "null_customer", "null_merchant", "orphan_customer", "orphan_merchant", "duplicate"]
START = datetime(2026, 1, 1)


def uniform(seed: int, salt: str, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed, the salt and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 30)) / float(1 << 30)


def between(low: int, high: int, u: Column) -> Column:
    """An integer in [low, high]."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def weighted(weights: dict[str, float], u: Column) -> Column:
    cases, upto = None, 0.0
    for name, w in weights.items():
        upto = round(upto + w, 9)
        cases = F.when(u < upto, name) if cases is None else cases.when(u < upto, name)
    return cases.otherwise(list(weights)[-1])


def identifier(seed: int, prefix: str, *cols: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", F.lit(f"{seed}{prefix}"), *cols), 256), 1, 32))


def dimensions(spark: SparkSession, customers: int, merchants: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(customers, cards, merchants)"""
    u = lambda salt, *c: uniform(seed, salt, *(c or ("id",)))
    c = spark.range(customers).select("id", identifier(seed, "cust", "id").alias("customer_id"), F.date_sub(F.lit(START.date()), between(30, 1500, u("signup"))).alias("signup_date"), weighted(COUNTRIES, u("home")).alias("home_country"), weighted(AGE_BANDS, u("age")).alias("age_band"), weighted(TIERS, u("tier")).alias("account_tier"))
    cards = c.select("id", "customer_id", "signup_date", F.explode(F.sequence(F.lit(1), between(1, 3, u("cards")))).alias("k")).select(identifier(seed, "card", "id", "k").alias("card_id"), "customer_id", F.date_add("signup_date", between(0, 60, u("issued", "id", "k"))).alias("issue_date"), weighted({"debit": 0.6, "credit": 0.4}, u("type", "id", "k")).alias("card_type"), weighted({"visa": 0.5, "mastercard": 0.4, "amex": 0.1}, u("network", "id", "k")).alias("network"), "id", "k")
    m = spark.range(merchants).withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), between(1, len(CATEGORIES), u("category"))))
    m = m.select(F.col("id").alias("mid"), identifier(seed, "merch", "id").alias("merchant_id"), F.concat(F.lit("Merchant "), "id").alias("name"), "category", weighted(COUNTRIES, u("country")).alias("country"), F.when(F.col("category").isin("gambling", "luxury"), "high").otherwise(weighted({"low": 0.7, "medium": 0.25, "high": 0.05}, u("risk"))).alias("risk_band"))
    return c, cards, m


def poisson(rate: Column, u: Column, most: int = 16) -> Column:
    """Inverse distribution function, as a sum of thresholds passed."""
    n, upto = F.lit(0), F.lit(0.0)
    for k in range(most):
        upto = upto + F.exp(-rate) * F.pow(rate, F.lit(k)) / math.factorial(k)
        n = n + (u >= upto).cast("int")
    return n


def transactions(spark: SparkSession, customers: int, merchants: int, days: int, seed: int) -> DataFrame:
    """All transactions with their label columns: ordinary ones by a Poisson process per customer and day, and for one
    customer in twenty a fraud episode of one of three patterns."""
    c, _, m = dimensions(spark, customers, merchants, seed)
    at = F.lit(START).cast("timestamp")
    seconds = lambda t, s: F.timestamp_seconds(F.unix_seconds(t) + s)
    who = c.select("id", "customer_id", "home_country", "account_tier")
    rate = F.element_at(F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v))]), F.col("account_tier"))
    plain = who.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    plain = plain.withColumn("n", poisson(rate, uniform(seed, "arrivals", "id", "day"))).where("n > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    plain = plain.select("id", "customer_id", "home_country", F.col("day").alias("a"), F.col("k").alias("b"), F.lit(None).cast("string").alias("fraud_type"), seconds(at, F.col("day") * 86400 + between(0, 1439, uniform(seed, "minute", "id", "day", "k")) * 60).alias("event_timestamp"))
    kind = F.element_at(F.array(F.lit("card_testing"), F.lit("account_takeover"), F.lit("geo_impossible")), between(1, 3, uniform(seed, "pattern", "id")))
    bad = who.where(uniform(seed, "victim", "id") < 0.05).withColumn("fraud_type", kind)
    size = F.when(F.col("fraud_type") == "card_testing", between(6, 14, uniform(seed, "episode", "id"))).when(F.col("fraud_type") == "account_takeover", between(1, 3, uniform(seed, "episode", "id"))).otherwise(2)
    start = between(0, max(0, days * 1440 - 240), uniform(seed, "begins", "id")) * 60
    step = F.when(F.col("fraud_type") == "geo_impossible", between(5, 24, uniform(seed, "hop", "id"))).otherwise(2) * 60
    bad = bad.select("*", F.explode(F.sequence(F.lit(1), size)).alias("b")).select("id", "customer_id", "home_country", F.lit(-1).alias("a"), "b", "fraud_type", seconds(at, start + step * (F.col("b") - 1)).alias("event_timestamp"))
    t = plain.unionByName(bad)
    u = lambda salt: uniform(seed, salt, "id", "a", "b")
    normal = 120 + 60 * F.sqrt(-2 * F.log(u("g1") + 1e-9)) * F.cos(2 * math.pi * u("g2"))
    is_ = lambda k: F.col("fraud_type") == k
    t = t.withColumns({
        "amount": F.round(F.when(is_("card_testing"), 1 + 9 * u("amount")).when(is_("account_takeover"), 800 + 4200 * u("amount")).otherwise(F.greatest(F.lit(1.0), normal)), 2),
        "channel": F.when(F.col("fraud_type").isNotNull(), "online").otherwise(weighted(CHANNELS, u("channel"))),
        "country": F.when(is_("account_takeover") | is_("geo_impossible") & (F.col("b") == 2), F.when(F.col("home_country") == "US", "BR").otherwise("US")).otherwise(F.col("home_country")),
        "mid": between(0, merchants - 1, u("merchant")),
        "k": between(1, 3, u("card")),
    })
    t = t.withColumn("mid", F.col("mid").cast("long")).join(m.select("mid", "merchant_id"), "mid")
    known = F.concat(F.lit("dev_"), "id", F.lit("_"), between(0, 1, u("device")))
    return t.select(
        identifier(seed, "txn", "id", "a", "b").alias("transaction_id"), "event_timestamp", "customer_id", identifier(seed, "card", "id", F.lit(1)).alias("card_id"), "merchant_id", "amount",
        F.when(F.col("country") == "MX", "MXN").otherwise("USD").alias("currency"), "channel", "country",
        F.when(F.col("channel") == "atm", None).when(is_("account_takeover"), F.concat(F.lit("dev_new_"), "id")).otherwise(known).alias("device_id"),
        seconds(F.col("event_timestamp"), between(2, 89, u("lag"))).alias("ingestion_timestamp"), "fraud_type",
        seconds(F.col("event_timestamp"), F.when(F.col("fraud_type").isNotNull(), between(7, 34, u("delay"))).otherwise(between(1, 9, u("delay"))) * 86400 + between(0, 23, u("late")) * 3600).alias("label_timestamp"),
    )


def labels(txn: DataFrame) -> DataFrame:
    return txn.select("transaction_id", F.col("fraud_type").isNotNull().cast("int").alias("is_fraud"), "fraud_type", "label_timestamp")


def with_defects(txn: DataFrame, n: int, seed: int, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(txn and n more rows of one defect each, the manifest: defect, rows). Every class occurs if n is 10 or more."""
    cols = [c for c in txn.columns if c not in ("fraud_type", "label_timestamp")]
    order = F.xxhash64(F.lit(seed), F.lit("defect"), "transaction_id")
    chosen = txn.select(*cols).orderBy(order).limit(n)
    rows = chosen.select("*", (F.pmod(F.xxhash64(F.lit(seed), "transaction_id"), F.lit(1 << 30))).alias("h"))
    rows = rows.withColumn("d", F.element_at(F.array(*map(F.lit, DEFECTS)), (F.row_number().over(Window.orderBy("h", "transaction_id")) - 1) % len(DEFECTS) + 1))
    d = F.col("d")
    far = F.timestamp_seconds(F.unix_seconds(F.lit(at).cast("timestamp")) + between(2, 89, uniform(seed, "future", "transaction_id")) * 86400)
    new = {
        "transaction_id": F.when(d == "missing_key", None).when(d == "duplicate", F.col("transaction_id")).otherwise(identifier(seed, "bad", "transaction_id")),
        "event_timestamp": F.when(d == "null_event_ts", None).when(d == "future_event_ts", far).otherwise(F.col("event_timestamp")),
        "amount": F.when(d == "null_amount", None).when(d == "negative_amount", -F.round(5 + 495 * uniform(seed, "negative", "transaction_id"), 2)).otherwise(F.col("amount")),
        "customer_id": F.when(d == "null_customer", None).when(d == "orphan_customer", identifier(seed, "ghost", "transaction_id")).otherwise(F.col("customer_id")),
        "merchant_id": F.when(d == "null_merchant", None).when(d == "orphan_merchant", identifier(seed, "ghostm", "transaction_id")).otherwise(F.col("merchant_id")),
        "ingestion_timestamp": F.when(d == "duplicate", F.timestamp_seconds(F.unix_seconds("ingestion_timestamp") - between(1, 47, uniform(seed, "older", "transaction_id")) * 3600)).otherwise(F.col("ingestion_timestamp")),
    }
    bad = rows.select("d", *[new.get(c, F.col(c)).alias(c) for c in cols])
    return txn.select(*cols).unionByName(bad.select(*cols)), bad.groupBy(F.col("d").alias("defect")).agg(F.count("*").alias("rows"))


def generate(spark: SparkSession, out: str, customers: int = 2000, merchants: int = 300, days: int = 60, seed: int = 42, dirty_rate: float = 0.0, at: datetime | None = None) -> dict[str, int]:
    """Write the raw feeds below out; returns the rows of each defect class."""
    c, cards, m = dimensions(spark, customers, merchants, seed)
    write_jsonl(c.drop("id"), f"{out}/dimensions/customers.jsonl")
    write_jsonl(cards.drop("id", "k"), f"{out}/dimensions/cards.jsonl")
    write_jsonl(m.drop("mid"), f"{out}/dimensions/merchants.jsonl")
    txn = transactions(spark, customers, merchants, days, seed)
    feed, manifest = txn.drop("fraud_type", "label_timestamp"), {}
    if dirty_rate > 0:
        feed, counts = with_defects(txn, max(round(txn.count() * dirty_rate), len(DEFECTS)), seed, at or datetime.now())
        manifest = {r["defect"]: r["rows"] for r in counts.collect()}
    dt = lambda c: F.coalesce(F.to_date(c), F.lit(START.date()))
    write_jsonl(feed.withColumn("dt", dt("event_timestamp")), f"{out}/transactions", "dt")
    lab = labels(txn)
    write_jsonl(lab.withColumn("dt", dt("label_timestamp")), f"{out}/fraud_labels", "dt")
    return manifest
