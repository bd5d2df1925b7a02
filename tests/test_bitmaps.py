"""Users from stored bitmaps equal users from events."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import audience as A
from pulsegrid.operators import bitmaps as B
from pulsegrid.operators import funnels as U
from pulsegrid.operators import retention as R
from pulsegrid.session import work_dir

SCHEMA = "wallet_address string, event string, date date"
FIRST = date(2024, 1, 29)
STEPS = [("One", "e0"), ("Two", "e1"), ("None", "nothing")]


def events(seed, users=300, days=40):
    pick = random.Random(seed)
    rows = [(f"w{pick.randrange(users)}", f"e{pick.randrange(4)}", FIRST + timedelta(days=pick.randrange(days))) for _ in range(2500)]
    rows += [("hot", "e0", FIRST + timedelta(days=i % days)) for i in range(1500)]             # a wallet with a third of all rows
    return rows + [(None, "e0", FIRST), ("w1", None, FIRST), ("w2", "e0", None), ("", "e1", FIRST)]


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(events(1), SCHEMA).cache()


@pytest.fixture(scope="module")
def path(spark, ev):
    path = work_dir(spark, "t-bitmaps")
    B.write_user_bitmaps(ev, path)
    return path


def known(ev):
    return ev.where("wallet_address IS NOT NULL AND date IS NOT NULL")


def results(bits):
    return [B.bitmap_dau(bits).collect(), B.bitmap_wau_mau(bits, "2024-03-09").collect(), B.bitmap_users_per(bits, "week").collect(),
            B.bitmap_users_per(bits, "month").collect(), B.bitmap_retention(bits).collect(), B.bitmap_funnel(bits, STEPS).collect()]


def test_equal_to_the_results_from_events(spark, ev, path):
    own = known(ev)
    per = lambda unit: own.groupBy(F.trunc("date", unit).alias("start")).agg(F.count_distinct("wallet_address").alias("users")).orderBy("start").collect()
    assert results(B.read_user_bitmaps(spark, path)) == [
        A.dau(own).collect(), A.wau_mau(own, "2024-03-09").collect(), per("week"), per("month"), R.cohort_retention(own).collect(), U.funnel(own, STEPS).collect()]


def test_numbers_have_no_gaps(spark, ev, path):
    rows = B.user_numbers(spark, path).collect()
    wallets = {r["wallet_address"] for r in known(ev).select("wallet_address").distinct().collect()}
    assert {r["wallet_address"] for r in rows} == wallets and sorted(r["user_no"] for r in rows) == list(range(len(wallets)))


def test_days_in_any_order_and_again(spark, ev, path):
    """Numbers differ with the order of the days; results do not."""
    other = work_dir(spark, "t-bitmap-days")
    days = [(FIRST + timedelta(days=a), FIRST + timedelta(days=b)) for a, b in ((20, 29), (0, 9), (30, 39), (10, 19), (5, 25))]
    for start, end in days:
        B.write_user_bitmaps(ev, other, start, end)
    assert results(B.read_user_bitmaps(spark, other)) == results(B.read_user_bitmaps(spark, path))
    numbers = B.user_numbers(spark, other).collect()
    B.write_user_bitmaps(ev, other)
    assert sorted(B.user_numbers(spark, other).collect()) == sorted(numbers) and len({r["user_no"] for r in numbers}) == len(numbers)


def test_only_the_asked_events(spark, ev):
    path = work_dir(spark, "t-bitmap-events")
    B.write_user_bitmaps(ev, path, events=["e1"])
    bits = B.read_user_bitmaps(spark, path)
    assert {r["event"] for r in bits.select("event").distinct().collect()} == {None, "e1"}
    assert B.bitmap_dau(bits).collect() == A.dau(known(ev)).collect()


def test_several_buckets(spark):
    """More users than one bitmap holds."""
    ev = spark.range(100_000).selectExpr("concat('w', id) AS wallet_address", "'e0' AS event", "date_add(DATE '2024-01-29', cast(id % 3 AS int)) AS date")
    path = work_dir(spark, "t-bitmap-many")
    B.write_user_bitmaps(ev, path)
    bits = B.read_user_bitmaps(spark, path)
    assert bits.select("bucket").distinct().count() == 4 and bits.selectExpr("max(length(bits))").first()[0] == 4096
    assert B.bitmap_dau(bits).collect() == A.dau(ev).collect() and B.bitmap_users_per(bits, "year").first()["users"] == 100_000
    assert B.bitmap_retention(bits, [1]).collect() == R.cohort_retention(ev, [1]).collect()


def test_no_events(spark, ev):
    path = work_dir(spark, "t-bitmap-none")
    B.write_user_bitmaps(ev.limit(0), path)
    bits = B.read_user_bitmaps(spark, path)
    assert B.bitmap_dau(bits).count() == 0 and B.bitmap_retention(bits).count() == 0
    assert tuple(B.bitmap_wau_mau(bits, "2024-01-01").first()) == (0, 0) and [r["users"] for r in B.bitmap_funnel(bits, STEPS).collect()] == [0, 0, 0]


def test_recent_users_read_recent_days(spark, path):
    plan = B.bitmap_wau_mau(B.read_user_bitmaps(spark, path), "2024-03-09")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(date" in scan and "2024-02-08" in scan
