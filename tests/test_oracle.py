"""Every query against its SQL on the small tables: same rows, same kinds of values."""

import duckdb
import pytest
from conftest import SMALL

from pitlake.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def kinds(rows, k):
    return {type(r[k]) for r in rows} - {type(None)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    ours = [tuple(r[c] for c in cols) for r in df.collect()]
    con.execute(ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    theirs = [tuple(r[names.index(c)] for c in cols) for r in con.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
    assert all(kinds(ours, k) == kinds(theirs, k) for k in range(len(cols)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_counts_of_defects(spark):
    got = {r[0]: r[1] for r in QUERIES["q_reject_histogram"](spark, SMALL).collect()}
    assert got == {"missing key": 5, "null event_timestamp": 5, "future timestamp": 5, "null amount": 5, "negative amount": 4, "null customer_id": 5, "null merchant_id": 5, "unknown customer": 5, "unknown merchant": 5, "duplicate (older version)": 4}


def test_profile_is_one_job_and_windows_share_an_exchange(spark):
    plan = QUERIES["q_shared_features"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(customer_id") <= 2  # the dimension join and the features' one deal


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
