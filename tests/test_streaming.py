"""Streams over files, with their open windows added, equal their batch twins row for row."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import audience as A
from pulsegrid.operators import logs as L
from pulsegrid.operators import notifications as M
from pulsegrid.session import work_dir
from pulsegrid.sources import metric_series
from pulsegrid.streaming import (metric_rollup, run_available, stream_concurrent_users, stream_errors_per_hour, stream_metric_rollup,
                                 stream_time_to_trade, viewers_per_bucket, with_open_taps, with_open_windows)


@pytest.fixture(scope="module")
def many_files(spark):
    """The events table as several files, which a stream takes one at a time, in time order."""
    base = work_dir(spark, "stream-input")
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(3):
        (raw.where((F.dayofmonth("ts") > 10 * i) & ((F.dayofmonth("ts") <= 10 * (i + 1)) | F.lit(i == 2)))
         .coalesce(1).write.mode("append").parquet(base))
    return base, raw


def stream_of(spark, many_files):
    base, raw = many_files
    return spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(base)


def as_events(df):
    return df.select("ts", F.col("user_id").cast("string").alias("wallet_address"))


def as_points(df):
    """Two series of one metric: with and without a dimension."""
    dims = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("Environment"), F.lit("production"))).otherwise(F.lit(None).cast("map<string,string>"))
    return df.select("ts", F.lit("m").alias("metric_name"), F.lit("ns").alias("namespace"), "value", dims.alias("dims"))


def as_logs(df):
    return df.select("ts", F.concat(F.lit("<"), (F.col("event_id") % 7).cast("string"), F.lit(">1 x")).alias("message"))


def same(got, want):
    return sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_concurrent_users(spark, many_files):
    run = run_available(stream_concurrent_users(as_events(stream_of(spark, many_files))), work_dir(spark, "t-users"))
    batch = A.concurrent_users(as_events(many_files[1])).select("time_utc", "viewers")
    assert run.late_rows == 0 and 0 < run.table.count() < batch.count()
    assert same(with_open_windows(run.table, as_events(many_files[1]), "time_utc", 300, viewers_per_bucket), batch)


@pytest.mark.parametrize("dims", [None, {"Environment": "production"}])
def test_metric_rollup_is_of_one_series(spark, many_files, dims):
    run = run_available(stream_metric_rollup(as_points(stream_of(spark, many_files)), "m", dims=dims), work_dir(spark, "t-points"))
    got = with_open_windows(run.table, as_points(many_files[1]), "timestamp", 300, lambda p: metric_rollup(p, "m", dims=dims))
    for column, stat in (("maximum", "Maximum"), ("minimum", "Minimum")):
        assert same(got.select("timestamp", column), metric_series(as_points(many_files[1]), "m", stat, hours=None, period=300, dims=dims))


def test_errors_per_hour(spark, many_files):
    run = run_available(stream_errors_per_hour(as_logs(stream_of(spark, many_files))), work_dir(spark, "t-logs"))
    assert same(with_open_windows(run.table, as_logs(many_files[1]), "hour", 3600, L.errors_per_hour), L.errors_per_hour(as_logs(many_files[1])))


def test_late_rows_are_dropped_and_counted(spark):
    base = work_dir(spark, "late")
    t0 = datetime(2024, 1, 1)
    for i, minutes in enumerate([0, 600, 700, 1, 1200, 1300]):
        spark.createDataFrame([(t0 + timedelta(minutes=minutes), f"w{i}")], "ts timestamp_ntz, wallet_address string").coalesce(1).write.mode("append").parquet(base)
    schema = "ts timestamp_ntz, wallet_address string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
    run = run_available(stream_concurrent_users(stream), work_dir(spark, "t-late"))
    assert {r["time_utc"]: r["viewers"] for r in run.table.collect()} == {t0 + timedelta(minutes=m): 1 for m in (0, 600, 700, 1200)}
    assert run.late_rows == 1


def test_second_run_continues_with_new_files(spark):
    base, folder = work_dir(spark, "grows"), work_dir(spark, "t-grows")
    t0, schema = datetime(2024, 1, 1), "ts timestamp_ntz, wallet_address string"

    def add_and_run(*minutes):
        spark.createDataFrame([(t0 + timedelta(minutes=m), "w") for m in minutes], schema).coalesce(1).write.mode("append").parquet(base)
        run = run_available(stream_concurrent_users(spark.readStream.schema(schema).parquet(base)), folder)
        return sorted((r["time_utc"] - t0).seconds // 60 for r in run.table.collect())

    assert add_and_run(0, 60) == [0]
    assert add_and_run(61, 120) == [0, 60]          # the window at 60 was kept open in the state and is counted once


def test_work_dir_is_fresh_and_in_the_named_folder(spark):
    one, two = work_dir(spark, "x"), work_dir(spark, "x")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert one != two and (not named or one.startswith(named.rstrip("/") + "/x-"))


@pytest.mark.parametrize("url", ["spark://somewhere:7077", "local-cluster[2,1,1024]", "yarn"])
def test_work_dir_refuses_a_local_folder_on_a_cluster(url):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = url

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        work_dir(Session(), "x")


def as_taps(df):
    """Every event is a tap or a conversion of one of a few wallets; one wallet has a third of all rows."""
    wallet = F.when(F.col("event_id") % 3 == 0, F.lit("hot")).when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("w"), F.col("user_id") % 5))
    return df.select("ts", "event_id", wallet.cast("string").alias("wallet_address"),
                     F.when(F.col("event_id") % 2 == 0, "notification_tap").otherwise("trade_initiated").alias("event"))


def times_of(df):
    return M.time_to_trade(as_taps(df), window_seconds=7200)


def test_time_to_trade(spark, many_files):
    stream = stream_time_to_trade(as_taps(stream_of(spark, many_files)), window_seconds=7200)
    run = run_available(stream, work_dir(spark, "t-taps"))
    batch = times_of(many_files[1])
    assert run.late_rows == 0 and 0 < run.table.count() <= batch.count() and run.read_rows == 2 * many_files[1].count()     # each side reads
    for settled in ("2024-02-01", "2024-01-20 12:00:00", "2023-12-31"):
        closed = run.table.where(F.col("tap_ts") < settled)
        assert same(with_open_taps(closed, as_taps(many_files[1]), lambda ev: M.time_to_trade(ev, window_seconds=7200)), batch)


def test_time_to_trade_goes_on_where_it_stopped(spark):
    """Each file is a run of its own; taps wait in the state for trades that only the next run sees."""
    at = lambda text: datetime.fromisoformat(f"2024-01-01 {text}")
    files = [[(1, at("10:00:00"), "a", "notification_tap"), (2, at("10:10:00"), "a", "notification_tap"), (3, at("10:10:00"), "a", "notification_tap")],
             [(4, at("10:50:00"), "a", "trade_initiated"), (5, at("10:10:00"), "b", "trade_initiated"), (6, at("10:50:01"), "a", "trade_initiated")],
             [(7, at("15:00:00"), "c", "notification_tap")],
             [(8, at("19:00:00"), "c", "notification_tap"), (9, at("18:00:00"), "c", "trade_initiated")],
             [(10, at("10:20:00"), "a", "notification_tap"), (11, at("20:00:00"), "c", "notification_tap"), (12, at("20:30:00"), "c", "trade_initiated")]]   # 10 is late
    schema = "event_id bigint, ts timestamp_ntz, wallet_address string, event string"
    base, folder, late = work_dir(spark, "tap-input"), work_dir(spark, "t-restart"), []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
        run = run_available(stream_time_to_trade(spark.readStream.schema(schema).parquet(base)), folder)
        late.append(run.late_rows)
    got = sorted((r["tap_ts"], r["trade_ts"], r["seconds"]) for r in run.table.collect())
    assert got == [(at("10:00:00"), at("10:50:00"), 3000.0), (at("10:10:00"), at("10:50:00"), 2400.0), (at("10:10:00"), at("10:50:00"), 2400.0)]
    assert late[:4] == [0, 0, 0, 0] and late[4] > 0
    again = run_available(stream_time_to_trade(spark.readStream.schema(schema).parquet(base)), folder)
    assert again.table.count() == 3 and again.read_rows == 0


def test_late_rows_of_many_batches_are_counted(spark, monkeypatch):
    """More micro-batches than a query keeps figures of by default, with the late row in the first ones."""
    schema = "ts timestamp_ntz, message string"
    base = work_dir(spark, "log-input")
    hours = [0, 5, 6, 1] + [7 + i for i in range(101)]          # a row is late from the second batch after the watermark on
    for hour in hours:
        rows = [(datetime(2024, 1, 1) + timedelta(hours=hour), "<3>1 x")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
    stream = stream_errors_per_hour(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base))
    run = run_available(stream, work_dir(spark, "t-many"))
    assert run.read_rows == len(hours) and run.late_rows == 1


def test_missing_figures_are_an_error(spark, many_files, monkeypatch):
    from pulsegrid.streaming import rollups
    monkeypatch.setattr(rollups, "_counts", lambda progress: {0: (0, 1), 2: (0, 1)})
    with pytest.raises(RuntimeError, match="1 micro-batches"):
        run_available(stream_errors_per_hour(as_logs(stream_of(spark, many_files))), work_dir(spark, "t-gap"))
