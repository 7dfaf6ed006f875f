"""One query per operator over the shared star schema's `events`, and the same in SQL.

An adapter turns `events` into transactions with one injected defect a row, and into a delayed label feed; customers and
suppliers stand in for the dimensions. Times leave the queries as epoch seconds, counts as bigints, doubles rounded to
nine places (sums and deviations over frames differ in their last bits between engines).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fraud, shared  # noqa: F401  registers the features
from ..functions.contract import REGISTRY, Registry, feature
from ..operators import checks, merge
from ..operators.dedup import split_duplicates, versioned
from ..operators.labels import join_labels, labels_as_of
from ..operators.profile import profile
from ..operators.validate import split, tagged
from ..session import prepared, shared_path
from ..sources.rules import Policy, load_policy
from ..sources.store import TableStore
from .gold import apply_features, build_base, registry_rows

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2024, 2, 1)
AS_OF = datetime(2024, 1, 20, tzinfo=UTC)

# The adapters, in SQL that both engines read.
TXN = """
with b as (select *, case when event_id % 199 = 7 then 'k' when event_id % 211 = 5 then 't' when event_id % 223 = 3 then 'f' when event_id % 227 = 1 then 'c' when event_id % 229 = 2 then 'oc' when event_id % 233 = 4 then 'm' when event_id % 239 = 6 then 'om' when event_id % 241 = 8 then 'a' when event_id % 251 = 9 then 'n' else '' end d from {events}),
x as (select case when d = 'k' then null else concat('txn_', cast(event_id as string)) end transaction_id,
 case when d = 't' then null when d = 'f' then ts + interval '400' day else ts end event_timestamp,
 case when d = 'c' then null when d = 'oc' then concat('ghost_', cast(user_id as string)) else concat('cust_', cast(user_id as string)) end customer_id,
 case when d = 'm' then null when d = 'om' then 'ghost_m' else concat('merch_', cast((event_id * 7) % 10 as string)) end merchant_id,
 case when d = 'a' then null when d = 'n' then -value else value end amount,
 event_type channel,
 case when event_id % 13 = 0 then 'US' else concat('N', cast(user_id % 25 as string)) end country,
 case when event_type = 'error' then null else concat('dev_', cast(user_id as string), '_', cast(event_id % 3 as string)) end device_id,
 ts + (event_id % 88 + 2) * interval '1' second ingestion_timestamp, event_id, d from b)
select * from x union all select transaction_id, event_timestamp, customer_id, merchant_id, amount, channel, country, device_id, ingestion_timestamp - interval '1' hour, event_id, d from x where event_id % 257 = 11 and d = ''
"""
LAB = """
select concat('txn_', cast(event_id as string)) transaction_id, case when event_id % 40 = 0 then 1 else 0 end is_fraud, case when event_id % 40 = 0 then 'pattern_' || cast(event_id % 3 as string) end fraud_type,
 ts + (case when event_id % 40 = 0 then 7 + event_id % 28 else 1 + event_id % 9 end) * interval '1' day label_timestamp from {events} where event_id % 17 <> 0
"""
CUSTOMERS = "select concat('cust_', cast(c_custkey as string)) customer_id, concat('N', cast(c_nationkey as string)) home_country, c_mktsegment account_tier, case when c_custkey % 11 = 0 then null else concat('band_', cast(c_custkey % 4 as string)) end age_band, cast(date '2023-06-01' - cast(c_custkey % 1000 as int) * interval '1' day as date) signup_date from {customer}"
MERCHANTS = "select concat('merch_', cast(s_suppkey as string)) merchant_id, concat('category_', cast(s_suppkey % 10 as string)) category, case when s_suppkey % 5 = 0 then 'high' else 'low' end risk_band from {supplier}"


class Inputs:
    """The adapted tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepared(spark), sf_dir

    def _sql(self, text: str, table: str) -> DataFrame:
        return self.spark.sql(text, **{table: self.spark.read.parquet(f"{self.dir}/{table}.parquet")})

    @property
    def defects(self) -> DataFrame:
        df = self._sql(TXN, "events")
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ("event_timestamp", "ingestion_timestamp")})

    @property
    def txn(self) -> DataFrame:
        return self.defects.drop("event_id", "d").withColumn("event_date", F.to_date("event_timestamp"))

    @property
    def labels(self) -> DataFrame:
        return self._sql(LAB, "events").withColumn("label_timestamp", F.col("label_timestamp").cast("timestamp"))

    @property
    def customers(self) -> DataFrame:
        return self._sql(CUSTOMERS, "customer")

    @property
    def merchants(self) -> DataFrame:
        return self._sql(MERCHANTS, "supplier")

    @property
    def policy(self) -> Policy:
        return load_policy(now=NOW)

    def tagged(self) -> DataFrame:
        return tagged(self.txn, self.policy, {"customers": self.customers, "merchants": self.merchants})

    def deduped(self) -> tuple[DataFrame, DataFrame]:
        """(valid, older versions)"""
        return split_duplicates(split(self.tagged())[0], self.policy.dedup)

    def verdicts(self) -> DataFrame:
        """All rows, with their reason or none: one pass over the load."""
        return versioned(self.tagged(), self.policy.dedup)

    def quarantine(self) -> DataFrame:
        return split(self.verdicts())[1]

    def valid(self) -> DataFrame:
        """Spark keeps one version a key and task before it shuffles, as nobody asks for the others here."""
        return self.deduped()[0]

    def labelled(self) -> DataFrame:
        return join_labels(self.valid(), self.labels)

    def frozen(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once: what follows reads it several times."""
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def base(self) -> DataFrame:
        return build_base(self.labelled(), self.customers, self.merchants)


# The same tables in SQL, as one chain of common table expressions.
CTE = f"""
with txn0 as ({TXN.replace("{events}", "events").strip()}),
txn as (select * exclude (event_id, d), cast(event_timestamp as date) event_date from txn0),
lab as ({LAB.replace("{events}", "events").strip()}),
customers as ({CUSTOMERS.replace("{customer}", "customer")}),
merchants as ({MERCHANTS.replace("{supplier}", "supplier")}),
tagged as (select t.*, case
  when not coalesce(t.transaction_id is not null and t.transaction_id <> '', false) then 'missing key'
  when t.event_timestamp is null then 'null event_timestamp'
  when not coalesce(t.event_timestamp <= timestamp '2024-02-01 00:00:00' + interval 1 hour, false) then 'future timestamp'
  when t.amount is null then 'null amount'
  when not coalesce(t.amount >= 0, false) then 'negative amount'
  when t.customer_id is null then 'null customer_id'
  when t.merchant_id is null then 'null merchant_id'
  when c.customer_id is null then 'unknown customer'
  when m.merchant_id is null then 'unknown merchant' end reject_reason
  from txn t left join (select distinct customer_id from customers) c using (customer_id) left join (select distinct merchant_id from merchants) m using (merchant_id)),
numbered as (select * exclude (reject_reason), row_number() over (partition by transaction_id order by ingestion_timestamp desc) v from tagged where reject_reason is null),
valid as (select * exclude (v) from numbered where v = 1),
quarantine as (select * from tagged where reject_reason is not null union all select * exclude (v), 'duplicate (older version)' from numbered where v > 1),
labelled as (select v.*, l.is_fraud, l.fraud_type, l.label_timestamp from valid v left join lab l using (transaction_id)),
base as (select l.*, c.home_country, c.signup_date, c.account_tier, c.age_band, m.category merchant_category, m.risk_band, epoch_us(l.event_timestamp) // 1000000 u from labelled l left join customers c using (customer_id) left join merchants m using (merchant_id)),
known as (select *, coalesce(label_timestamp <= timestamp '2024-01-20 00:00:00', false) label_known from labelled)
"""
WINDOWS = """
window o as (partition by {e} order by u, transaction_id),
 h as (partition by {e} order by u, transaction_id rows between unbounded preceding and 1 preceding),
 w300 as (partition by {e} order by u range between 300 preceding and 1 preceding),
 w600 as (partition by {e} order by u range between 600 preceding and 1 preceding),
 w3600 as (partition by {e} order by u range between 3600 preceding and 1 preceding),
 w86400 as (partition by {e} order by u range between 86400 preceding and 1 preceding)
"""
#: Feature -> its SQL over `base`, before rounding.
FEATURES = {
    **{f"txn_count_{n}": f"count(*) over w{s}" for n, s in (("5min", 300), ("10min", 600), ("1h", 3600), ("24h", 86400))},
    **{f"amount_sum_{n}": f"round(coalesce(sum(amount) over w{s}, 0.0), 9)" for n, s in (("5min", 300), ("1h", 3600), ("24h", 86400))},
    **{f"amount_avg_{n}": f"round(avg(amount) over w{s}, 9)" for n, s in (("1h", 3600), ("24h", 86400))},
    "amount_avg_hist": "round(avg(amount) over h, 9)",
    "amount_std_hist": "round(stddev_samp(amount) over h, 9)",
    "txn_count_hist": "count(*) over h",
    "minutes_since_prev_txn": "round((u - lag(u, 1) over o) / 60.0, 9)",
    "prev_country": "last_value(country ignore nulls) over h",
    "distinct_devices_hist": "coalesce(len(list(distinct device_id) filter (where device_id is not null) over h), 0)",
    "amount_zscore": "round(case when stddev_samp(amount) over h > 0 then (amount - avg(amount) over h) / stddev_samp(amount) over h end, 9)",
    "amount_vs_max_hist": "round(case when max(amount) over h > 0 then amount / max(amount) over h end, 9)",
    "small_amount_burst_1h": "round(case when avg(amount) over h > 0 then avg(amount) over w3600 / avg(amount) over h end, 9)",
    "distinct_merchants_10min": "coalesce(len(list(distinct merchant_id) filter (where merchant_id is not null) over w600), 0)",
    "is_new_device": "case when device_id is not null then not coalesce(list_contains(list(device_id) over h, device_id), false) end",
    "country_changed": "case when last_value(country ignore nulls) over h is not null then country <> last_value(country ignore nulls) over h end",
    "is_foreign": "country <> home_country",
    "hour_of_day": "cast(hour(event_timestamp) as bigint)",
    "merchant_is_high_risk": "risk_band = 'high'",
    "account_age_days": "cast(date_diff('day', signup_date, cast(event_timestamp as date)) as bigint)",
}
ROUNDED = {k for k, v in FEATURES.items() if v.startswith("round(")}


def _out(name: str) -> Column:
    """A feature as the queries return it."""
    if name in ROUNDED:
        return F.round(F.col(name), 9).alias(name)
    d = REGISTRY.registered()
    whole = name in ("hour_of_day", "account_age_days", "distinct_merchants_10min") or name.startswith(("txn_count", "distinct_"))
    return F.col(name).cast("long").alias(name) if whole and any(x.name == name for x in d) else F.col(name)


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp")).alias(c)


def _feature_sql(names: list[str], entity: str = "customer_id", tail: str = "") -> str:
    return f"{CTE} select transaction_id, {', '.join(f'{FEATURES[n]} as {n}' for n in names)} from base {WINDOWS.format(e=entity)}{tail}"


ROW = ["transaction_id", "customer_id", "merchant_id", "amount", "channel", "country", "device_id"]
ROW_SQL = ", ".join(ROW)
TIMES_SQL = "epoch_us(event_timestamp) // 1000000 as event_timestamp, epoch_us(ingestion_timestamp) // 1000000 as ingestion_timestamp"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Callable[[Inputs], DataFrame]], Callable[[Inputs], DataFrame]]:
    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*ROW, _seconds("event_timestamp"), _seconds("ingestion_timestamp"), *more)


@query(f"{CTE} select transaction_id, epoch_us(event_timestamp) // 1000000 as event_unix, channel as kind, amount * 2 as amount_x2, 'run_1' as run_id from txn")
def q_scan_project(i: Inputs) -> DataFrame:
    return i.txn.drop("device_id").select("transaction_id", _seconds("event_timestamp").alias("event_unix"), F.col("channel").alias("kind"), (F.col("amount") * 2).alias("amount_x2"), F.lit("run_1").alias("run_id"))


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL} from tagged where reject_reason is null")
def q_filter_valid(i: Inputs) -> DataFrame:
    return _rows(split(i.tagged())[0])


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL}, reject_reason from tagged where reject_reason is not null")
def q_filter_rejected(i: Inputs) -> DataFrame:
    return _rows(split(i.tagged())[1], "reject_reason")


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL}, reject_reason from tagged")
def q_reject_reason(i: Inputs) -> DataFrame:
    return _rows(i.tagged(), "reject_reason")


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL}, reject_reason from tagged where reject_reason in ('unknown customer', 'unknown merchant')")
def q_fk_orphans(i: Inputs) -> DataFrame:
    return _rows(i.tagged().where(F.col("reject_reason").isin("unknown customer", "unknown merchant")), "reject_reason")


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL} from valid")
def q_dedup_latest(i: Inputs) -> DataFrame:
    return _rows(i.deduped()[0])


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL} from numbered where v > 1")
def q_dedup_dupes(i: Inputs) -> DataFrame:
    return _rows(i.deduped()[1])


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL}, reject_reason from quarantine")
def q_quarantine(i: Inputs) -> DataFrame:
    return _rows(i.quarantine(), "reject_reason")


@query(f"{CTE} select reject_reason, count(*) as n from quarantine group by reject_reason order by n desc")
def q_reject_histogram(i: Inputs) -> DataFrame:
    return i.quarantine().groupBy("reject_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"{CTE} select (select count(*) from txn) as n_bronze, (select count(*) from valid) as n_valid, (select count(*) from quarantine) as n_quarantine, (select count(*) from valid) + (select count(*) from quarantine) = (select count(*) from txn) as holds")
def q_invariant(i: Inputs) -> DataFrame:
    read = i.txn.agg(F.count(F.lit(1)).alias("n_bronze"))
    ok = F.col("reject_reason").isNull()
    told = i.verdicts().agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_quarantine"))
    return read.join(F.broadcast(told)).withColumn("holds", F.col("n_valid") + F.col("n_quarantine") == F.col("n_bronze"))  # one row each


@query("select source, n from (select 'events' source, count(*) n from events union all select 'customer', count(*) from customer union all select 'supplier', count(*) from supplier)")
def q_table_counts(i: Inputs) -> DataFrame:
    return reduce(DataFrame.unionAll, [i.spark.read.parquet(f"{i.dir}/{t}.parquet").agg(F.lit(t).alias("source"), F.count("*").alias("n")) for t in ("events", "customer", "supplier")]).select("source", "n")


@query(f"""{CTE}, ids as (select *, cast(substr(transaction_id, 5) as bigint) k from valid),
target as (select * from ids where k % 3 <> 0), source as (select * from ids where k % 2 = 0)
select transaction_id, amount, 'old' as origin from target union all select transaction_id, amount, 'new' from source where transaction_id not in (select transaction_id from target)""")
def q_merge_insert_only(i: Inputs) -> DataFrame:
    ids = i.frozen(i.valid().select("transaction_id", "amount"), "valid").withColumn("k", F.substring("transaction_id", 5, 20).cast("long"))
    target, source = ids.where("k % 3 <> 0").drop("k").withColumn("origin", F.lit("old")), ids.where("k % 2 = 0").drop("k").withColumn("origin", F.lit("new"))
    return merge.merge_insert_only(target, source, "transaction_id")


@query(f"""{CTE}, ids as (select *, cast(substr(transaction_id, 5) as bigint) k from lab),
target as (select transaction_id, is_fraud, fraud_type, 'old' as origin from ids where k % 3 <> 0), source as (select transaction_id, 1 - is_fraud as is_fraud, fraud_type, 'new' as origin from ids where k % 2 = 0)
select * from target where transaction_id not in (select transaction_id from source) union all select * from source""")
def q_merge_upsert(i: Inputs) -> DataFrame:
    ids = i.labels.select("transaction_id", "is_fraud", "fraud_type").withColumn("k", F.substring("transaction_id", 5, 20).cast("long"))
    target, source = ids.where("k % 3 <> 0").drop("k").withColumn("origin", F.lit("old")), ids.where("k % 2 = 0").drop("k").withColumn("is_fraud", 1 - F.col("is_fraud")).withColumn("origin", F.lit("new"))
    return merge.merge_upsert(target, source, "transaction_id")


@query(f"""{CTE} select {ROW_SQL}, {TIMES_SQL} from valid where cast(substr(transaction_id, 5) as bigint) % 3 <> 0""")
def q_incremental_antijoin(i: Inputs) -> DataFrame:
    v = i.frozen(i.valid(), "valid")
    return _rows(merge.not_yet_published(v, v.where(F.substring("transaction_id", 5, 20).cast("long") % 3 == 0), "transaction_id"))


@query(f"{CTE} select transaction_id, is_fraud, fraud_type, epoch_us(label_timestamp) // 1000000 as label_timestamp from labelled")
def q_label_join(i: Inputs) -> DataFrame:
    return i.labelled().select("transaction_id", "is_fraud", "fraud_type", _seconds("label_timestamp"))


@query(f"{CTE} select transaction_id, label_known, label_known as is_trainable, case when label_known then is_fraud end as is_fraud, case when label_known then fraud_type end as fraud_type, case when label_known then epoch_us(label_timestamp) // 1000000 end as label_timestamp from known")
def q_label_asof(i: Inputs) -> DataFrame:
    return labels_as_of(i.labelled(), AS_OF).select("transaction_id", "label_known", "is_trainable", "is_fraud", "fraud_type", _seconds("label_timestamp"))


@query(f"{CTE} select label_known as is_trainable, count(*) as n, cast(sum(case when label_known then is_fraud end) as bigint) as n_fraud from known group by label_known")
def q_trainable_split(i: Inputs) -> DataFrame:
    return labels_as_of(i.labelled(), AS_OF).groupBy("is_trainable").agg(F.count("*").alias("n"), F.sum("is_fraud").cast("long").alias("n_fraud"))


@query(f"{CTE} select fraud_type, count(*) as n from lab where is_fraud = 1 group by fraud_type")
def q_fraud_type_histogram(i: Inputs) -> DataFrame:
    return i.labels.where("is_fraud = 1").groupBy("fraud_type").agg(F.count("*").alias("n"))


@query(f"{CTE} select transaction_id, home_country, cast(signup_date as varchar) as signup_date, account_tier, merchant_category, risk_band, age_band, u as event_unix from base")
def q_dim_enrich(i: Inputs) -> DataFrame:
    return i.base().select("transaction_id", "home_country", F.col("signup_date").cast("string").alias("signup_date"), "account_tier", "merchant_category", "risk_band", "age_band", F.col("_event_unix").alias("event_unix"))


def _value(df: DataFrame) -> DataFrame:
    return df.select(F.round("value", 9).alias("value"))


@query(f"{CTE} select cast(count(*) as double) as value from txn")
def q_metric_row_count(i: Inputs) -> DataFrame:
    return _value(checks.row_count(i.txn))


@query(f"{CTE} select round((select count(*) from quarantine) / (select count(*) from txn), 9) as value")
def q_metric_quarantine_rate(i: Inputs) -> DataFrame:
    return _value(checks.quarantine_rate(i.txn, i.quarantine()))


@query(f"{CTE} select round(count(*) filter (where is_fraud = 1) / count(*), 9) as value from labelled")
def q_metric_fraud_rate(i: Inputs) -> DataFrame:
    return _value(checks.fraud_rate(i.labelled()))


@query(f"{CTE} select round(greatest(1 - count(transaction_id) / count(*), 1 - count(amount) / count(*), 1 - count(event_timestamp) / count(*)), 9) as value from txn")
def q_metric_max_null_rate(i: Inputs) -> DataFrame:
    return _value(checks.max_null_rate(i.txn, ("transaction_id", "amount", "event_timestamp")))


@query(f"{CTE} select round(max(n) / sum(n), 9) as value from (select channel, count(*) n from valid group by channel)")
def q_metric_max_category_share(i: Inputs) -> DataFrame:
    return _value(checks.max_category_share(i.valid(), "channel"))


@query(f"{CTE} select round(avg(amount), 9) as value from valid")
def q_metric_column_mean(i: Inputs) -> DataFrame:
    return _value(checks.column_mean(i.valid(), "amount"))


@query(f"""{CTE}, m as (select 'bronze_not_empty' check_name, 'critical' severity, cast((select count(*) from txn) as double) v, 1.0 lo, null hi
union all select 'quarantine_rate_acceptable', 'critical', (select count(*) from quarantine) / (select count(*) from txn), null, 0.05
union all select 'key_columns_not_mostly_null', 'critical', (select greatest(1 - count(transaction_id) / count(*), 1 - count(amount) / count(*), 1 - count(event_timestamp) / count(*)) from txn), null, 0.5
union all select 'fraud_rate_in_range', 'warn', (select count(*) filter (where is_fraud = 1) / count(*) from labelled), 0.0005, 0.02
union all select 'channel_mix_not_skewed', 'warn', (select max(n) / sum(n) from (select channel, count(*) n from valid group by channel)), null, 0.8
union all select 'country_mix_not_skewed', 'warn', (select max(n) / sum(n) from (select country, count(*) n from valid group by country)), null, 0.9
union all select 'amount_mean_plausible', 'warn', (select avg(amount) from valid), 1.0, 5000.0)
select check_name, severity, round(v, 9) as observed_value, coalesce(v >= lo, true) and coalesce(v <= hi, true) as passed from m""")
def q_batch_checks(i: Inputs) -> DataFrame:
    ok, bad = split(i.frozen(i.verdicts(), "verdicts"))
    rows, _ = checks.run_checks(i.spark, i.policy.checks, i.txn, join_labels(ok, i.labels), bad, NOW)
    return rows.select("check_name", "severity", F.round("observed_value", 9).alias("observed_value"), "passed")


PROFILED = ["transaction_id", "customer_id", "amount", "channel", "country", "device_id"]


@query(CTE + " union all ".join(f"select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, round(1 - count({c}) / count(*), 6) as null_rate, count(distinct {c}) as distinct_count, {f'cast(round(min({c}), 6) as double)' if c == 'amount' else 'null'} as min_value, {f'cast(round(max({c}), 6) as double)' if c == 'amount' else 'null'} as max_value, {f'round(avg({c}), 9)' if c == 'amount' else 'null'} as mean_value from txn" for c in sorted(PROFILED, key=lambda c: c != "amount")))
def q_profile_exact(i: Inputs) -> DataFrame:
    p = profile(i.txn.select(*PROFILED), NOW, exact=True)
    return p.select("column_name", "row_count", "null_count", "null_rate", "distinct_count", F.round(F.col("min_value").cast("double"), 6).alias("min_value"), F.round(F.col("max_value").cast("double"), 6).alias("max_value"), F.round("mean_value", 9).alias("mean_value"))


@query(None)
def q_profile_approx(i: Inputs) -> DataFrame:
    return profile(i.txn.select(*PROFILED), NOW).drop("profiled_at")


def _features(i: Inputs, names: list[str], entity: str | None = None) -> DataFrame:
    defs = [d for d in REGISTRY.registered() if d.name in names]
    df, _ = apply_features(i.base(), defs, entity)
    return df.select("transaction_id", *[_out(n) for n in names])


for _name in FEATURES:
    QUERIES[f"q_feat_{_name}"] = lambda spark, sf_dir, n=_name: _features(Inputs(spark, sf_dir), [n])
    ORACLES[f"q_feat_{_name}"] = _feature_sql([_name])

SHORT = ["txn_count_5min", "txn_count_10min", "amount_sum_5min", "distinct_merchants_10min"]
SHARED = [d.name for d in REGISTRY.registered(tier="shared")]
MODEL = [d.name for d in REGISTRY.registered(owner="fraud")]


@query(_feature_sql(SHORT, "channel"))
def q_feat_channel_5min(i: Inputs) -> DataFrame:
    return _features(i, SHORT, "channel")


@query(_feature_sql(SHARED))
def q_shared_features(i: Inputs) -> DataFrame:
    return _features(i, SHARED)


@query(f"{CTE}, f as (select transaction_id, {', '.join(f'{FEATURES[n]} as {n}' for n in MODEL + SHARED)} from base {WINDOWS.format(e='customer_id')}) select f.*, label_known, label_known as is_trainable, case when label_known then is_fraud end as is_fraud from f join known using (transaction_id)")
def q_owner_features(i: Inputs) -> DataFrame:
    """All features on one frame: the windows over an entity share its exchange."""
    both, _ = apply_features(i.base(), REGISTRY.registered(tier="shared") + REGISTRY.registered(owner="fraud"))
    return labels_as_of(both, AS_OF).select("transaction_id", *[_out(n) for n in MODEL + SHARED], "label_known", "is_trainable", "is_fraud")


OWN = Registry()


@feature(owner="queries", registry=OWN)
def same_band_count(f):  # noqa: ANN001, ANN201
    """Earlier transactions of a customer whose age band is known."""
    return F.when(f.col("age_band").isNotNull(), F.count("age_band").over(f.history)).otherwise(-1)


@query(f"{CTE} select transaction_id, age_band, case when age_band is not null then count(age_band) over (partition by customer_id order by u, transaction_id rows between unbounded preceding and 1 preceding) else -1 end as same_band_count from base")
def q_feat_age_band(i: Inputs) -> DataFrame:
    df, names = apply_features(i.base(), OWN.registered())
    return df.select("transaction_id", "age_band", *[F.col(n).cast("long").alias(n) for n in names])


@query("select * from (values " + ", ".join(f"('{d.name}', '{d.tier}', {repr(d.owner) if d.owner else 'null'}, '{d.entity}', cast({d.window_seconds or 'null'} as bigint))" for d in REGISTRY.registered()) + ") t(feature_name, tier, owner, entity, window_seconds)")
def q_feature_registry(i: Inputs) -> DataFrame:
    early, late = registry_rows(i.spark, datetime(2024, 1, 1)), registry_rows(i.spark, NOW)
    both = early.unionByName(late)
    last = both.agg(F.max("materialized_at").alias("at"))
    return both.join(F.broadcast(last), F.col("materialized_at") == F.col("at")).select("feature_name", "tier", "owner", "entity", "window_seconds")  # one row


@query(_feature_sql(["is_new_device", "distinct_devices_hist"]))
def q_new_device_linear(i: Inputs) -> DataFrame:
    return _features(i, ["is_new_device", "distinct_devices_hist"])


def _merge_sides(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(target, source) as in the queries of the merges' algebra."""
    ids = rows.select("transaction_id", *columns).withColumn("k", F.substring("transaction_id", 5, 20).cast("long"))
    return ids.where("k % 3 <> 0").drop("k").withColumn("origin", F.lit("old")), ids.where("k % 2 = 0").drop("k").withColumn("origin", F.lit("new"))


@query(ORACLES["q_merge_insert_only"])
def q_store_merge_insert(i: Inputs) -> DataFrame:
    """The same merge by the table store, made twice: the second time adds nothing."""
    store = TableStore(i.spark, shared_path(i.spark, "store"))
    target, source = _merge_sides(i.frozen(i.valid(), "valid"), "amount")
    store.replace("q.t", target)
    if store.merge_insert("q.t", source, "transaction_id") and store.merge_insert("q.t", source, "transaction_id"):
        raise RuntimeError("a merge that was made twice added rows")
    return store.read("q.t")


@query(ORACLES["q_merge_upsert"])
def q_store_merge_upsert(i: Inputs) -> DataFrame:
    """The same merge by the table store."""
    store = TableStore(i.spark, shared_path(i.spark, "store"))
    target, source = _merge_sides(i.labels, "is_fraud", "fraud_type")
    store.replace("q.t", target)
    store.merge_upsert("q.t", source.withColumn("is_fraud", 1 - F.col("is_fraud")), "transaction_id")
    return store.read("q.t")


@query("select 0 as version, 'replace' as operation, (select count(*) from events where event_id % 3 = 0) as added_records, (select count(*) from events where event_id % 3 = 0) as total_records union all select 1, 'append', (select count(*) from events where event_id % 3 = 1), (select count(*) from events where event_id % 3 < 2) union all select 2, 'merge_insert', (select count(*) from events where event_id % 3 = 2), (select count(*) from events) union all select 3, 'compact', 0, (select count(*) from events)")
def q_store_snapshots(i: Inputs) -> DataFrame:
    """The commit log of a table that was replaced, appended to, merged into and compacted."""
    store = TableStore(i.spark, shared_path(i.spark, "store"))
    rows = i.spark.read.parquet(f"{i.dir}/events.parquet").select("event_id", "user_id")
    store.replace("q.t", rows.where("event_id % 3 = 0"))
    store.append("q.t", rows.where("event_id % 3 = 1"))
    store.merge_insert("q.t", rows.where("event_id % 3 > 0"), "event_id")
    store.compact("q.t")
    return store.snapshots("q.t").select(F.col("version").cast("int").alias("version"), "operation", "added_records", "total_records")


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL}, true as has_source from txn")
def q_jsonl_roundtrip(i: Inputs) -> DataFrame:
    """Write the transactions as JSON Lines and read them back under their schema, with lineage."""
    from .. import schemas
    from ..sources.jsonl import read_jsonl, write_jsonl

    path = shared_path(i.spark, "jsonl")
    write_jsonl(i.txn.withColumn("dt", F.coalesce("event_date", F.lit("2024-01-01").cast("date"))).drop("event_date"), path, "dt")
    return read_jsonl(i.spark, path, schemas.TRANSACTIONS, NOW).select(*ROW, _seconds("event_timestamp"), _seconds("ingestion_timestamp"), F.col("_source_file").isNotNull().alias("has_source"))


@query(f"""{CTE}, near as (select column_name, true as is_near from (values {', '.join(f"('{c}')" for c in PROFILED)}) t(column_name)) select * from near""")
def q_profile_approx_is_near(i: Inputs) -> DataFrame:
    """Whether the approximate numbers of distinct values lie within a tenth of the exact ones."""
    rows = i.txn.select(*PROFILED)
    exact = profile(rows, NOW, exact=True).select("column_name", F.col("distinct_count").alias("n"))
    return profile(rows, NOW).join(exact, "column_name").select("column_name", (F.abs(F.col("distinct_count") - F.col("n")) * 10 <= F.col("n")).alias("is_near"))


def _feed(i: Inputs, rows: DataFrame, path: str) -> None:
    from ..sources.jsonl import write_jsonl

    write_jsonl(rows, path)


def _streamed(i: Inputs, rows: DataFrame, name: str) -> DataFrame:
    """What a stream appends until it has caught up."""
    path = shared_path(i.spark, name)
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(rows.schema).parquet(path)


@query(f"{CTE} select {ROW_SQL}, {TIMES_SQL} from valid")
def q_stream_incremental(i: Inputs) -> DataFrame:
    """Two loads of a growing feed, each of what is new, merged by key into a table."""
    from .. import schemas
    from ..streaming.incremental import load_new, stream_jsonl

    rows, raw = i.frozen(i.valid(), "valid"), shared_path(i.spark, "feed")
    store, parts = TableStore(i.spark, f"{raw}-tables"), F.pmod(F.xxhash64("transaction_id"), F.lit(2))
    for k in range(2):
        _feed(i, rows.where(parts == k), f"{raw}/part={k}")
        load_new(store, stream_jsonl(i.spark, raw, schemas.TRANSACTIONS, NOW), "bronze.t", "transaction_id", f"{raw}-state").awaitTermination()
    return _rows(store.read("bronze.t"))


@query(f"""{CTE}, times as (select epoch_us(event_timestamp) // 1000000 s, channel, amount from valid),
windows as (select s // 3600 * 3600 as window_start, channel, count(*) as txn_count, round(sum(amount), 6) as amount_sum from times group by 1, 2)
select window_start, window_start + 3600 as window_end, channel, txn_count, amount_sum from windows where window_start + 3600 <= (select max(s) from times) - 600""")
def q_stream_activity(i: Inputs) -> DataFrame:
    """Event-time windows that the watermark has closed."""
    from .. import schemas
    from ..streaming.incremental import activity, stream_jsonl

    raw = shared_path(i.spark, "feed")
    _feed(i, i.valid(), raw)
    out = _streamed(i, activity(stream_jsonl(i.spark, raw, schemas.TRANSACTIONS, NOW), "channel"), "activity")
    return out.select(_seconds("window_start"), _seconds("window_end"), "channel", "txn_count", F.round("amount_sum", 6).alias("amount_sum"))


@query(f"{CTE} select distinct transaction_id from txn where transaction_id is not null and event_timestamp is not null")
def q_stream_dedup(i: Inputs) -> DataFrame:
    """Keys of a feed that repeats some, each once."""
    from .. import schemas
    from ..streaming.incremental import dedup_stream, stream_jsonl

    raw = shared_path(i.spark, "feed")
    _feed(i, i.txn.where("transaction_id is not null and event_timestamp is not null"), raw)
    return _streamed(i, dedup_stream(stream_jsonl(i.spark, raw, schemas.TRANSACTIONS, NOW), "transaction_id", "event_timestamp", "1 hour").select("transaction_id"), "dedup")


@query(f"{CTE} select v.transaction_id, l.is_fraud from valid v join lab l on v.transaction_id = l.transaction_id and l.label_timestamp >= v.event_timestamp and l.label_timestamp <= v.event_timestamp + interval 36 day")
def q_stream_labels(i: Inputs) -> DataFrame:
    """Events joined with the labels that a second stream brings up to 36 days later."""
    from .. import schemas
    from ..streaming.incremental import events_with_labels, stream_jsonl

    raw = shared_path(i.spark, "feed")
    _feed(i, i.valid(), f"{raw}/t")
    _feed(i, i.labels, f"{raw}/l")
    events = stream_jsonl(i.spark, f"{raw}/t", schemas.TRANSACTIONS, NOW).select("transaction_id", "event_timestamp")
    labels = stream_jsonl(i.spark, f"{raw}/l", schemas.FRAUD_LABELS, NOW).select("transaction_id", "is_fraud", "label_timestamp")
    return _streamed(i, events_with_labels(events, labels), "labelled").where("is_fraud is not null").select("transaction_id", "is_fraud")
