from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.session import work_dir
from pulsegrid.sources import (scan_alarms, scan_events, scan_logs, scan_points, scan_trades, scan_trades_by_timestamp, scan_users)


@pytest.fixture(scope="module")
def stored(spark):
    """Events and trades in the day layout."""
    base = work_dir(spark, "sources")
    days = spark.range(0, 240).select((F.lit("2024-01-01 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"),
                                      F.lit("a").alias("wallet_address"), F.lit("x").alias("event"))
    days.withColumn("date", F.date_format("timestamp", "yyyy-MM-dd")).repartition(1).write.partitionBy("date").parquet(base + "/events")
    trades = days.withColumn("amount_usd", F.lit(1.0))
    trades.withColumn("trade_date", F.to_date("timestamp")).repartition(1).write.partitionBy("trade_date").parquet(base + "/trades")
    trades.repartition(1).sortWithinPartitions("timestamp").write.parquet(base + "/flat")
    return base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_scan_reads_one_extra_day_and_prunes(stored):
    df = scan_events(stored + "/events", "2024-01-03", "2024-01-04")
    assert df.count() == 72
    text = plan(df)
    assert "PartitionFilters: [isnotnull(date" in text and "2024-01-05" in text
    narrow = plan(df.groupBy("event").count())
    assert "ReadSchema: struct<event:string>" in narrow


def test_trimmed_event_scan_keeps_local_days_only(stored):
    df = scan_events(stored + "/events", "2024-01-03", "2024-01-04", trim_local=True)
    got = df.agg(F.count("*"), F.min("timestamp"), F.max("timestamp")).collect()[0]
    assert tuple(got) == (48, datetime(2024, 1, 3, 5, 30), datetime(2024, 1, 5, 4, 30))


def test_trade_scan_prunes(stored):
    df = scan_trades(stored + "/trades", "2024-01-03", "2024-01-04")
    assert df.count() == 48 and "PartitionFilters: [isnotnull(trade_date" in plan(df)


def test_trade_scan_by_timestamp_pushes_bounds(stored):
    df = scan_trades_by_timestamp(stored + "/flat", "2024-01-03", "2024-01-04")
    assert df.count() == 48
    text = plan(df)
    pushed = text[text.index("PushedFilters"):]
    assert "GreaterThanOrEqual(timestamp,2024-01-03" in pushed and "LessThan(timestamp,2024-01-05" in pushed


def test_last_second_of_the_range_is_inside(frame):
    df = frame("timestamp string", [("2024-01-04T23:59:59.9",), ("2024-01-05T00:00:00",), ("2024-01-03T00:00:00",), ("2024-01-02T23:59:59",)])
    assert scan_trades_by_timestamp(df, "2024-01-03", "2024-01-04").count() == 2


def test_json_is_read_with_the_declared_schema(spark):
    base = work_dir(spark, "json")
    spark.sql("""select to_json(named_struct('id', 'u1', 'linked_accounts', array(named_struct('type', 'email', 'address', 'e@e')))) as value""").write.text(base)
    df = scan_users(base, fmt="json")
    row = df.collect()[0]
    assert df.columns == schemas.USERS.names and row["linked_accounts"][0]["address"] == "e@e" and row["ingest_order"] is None


def test_a_missing_path_is_an_error(spark):
    with pytest.raises(Exception):
        scan_alarms("/nowhere/at/all").count()


def test_conform_adds_typed_nulls_and_keeps_the_rest(frame):
    df = schemas.conform(frame("AlarmName string, extra int", [("a", 1)]), schemas.ALARMS)
    assert df.columns == ["AlarmName", "extra", "StateValue", "AlarmDescription"]
    assert scan_alarms(df).columns == schemas.ALARMS.names
    assert dict(scan_points(frame("metric_name string", [("m",)])).dtypes)["dims"] == "map<string,string>"


def test_log_scan_group_and_lookback(frame):
    df = frame("ts timestamp_ntz, log_group string, message string", [(datetime(2024, 1, 1, h), "g" if h % 2 else "k", "m") for h in range(10)])
    assert scan_logs(df).count() == 10 and scan_logs(df, "g").count() == 5
    assert scan_logs(df, "g", 2, "2024-01-01 07:00:00").count() == 1
