"""Shredded metadata gives the results of JSON text, and only the asked fields are read."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import audience as A
from pulsegrid.operators import funnels as U
from pulsegrid.operators import notifications as M
from pulsegrid.operators.normalize import normalize_events
from pulsegrid.session import work_dir
from pulsegrid.sources import write_shredded_events

SCHEMA = "date string, timestamp string, event string, wallet_address string, platform string, session_id string, metadata string"
DAY = ("2024-01-05", "2024-01-05 12:00:00")


def row(event, metadata, i=0, day=DAY):
    return (*day, event, f"w{i}", "ios", f"s{i}", metadata)


ROWS = [
    row("session_end", '{"duration_ms": 1200, "provider": "a"}'), row("session_end", '{"duration_ms": 0.5}', 1), row("session_end", '{"duration_ms": "77"}', 2),
    row("session_end", '{"duration_ms": true}', 3), row("session_end", "no json", 4), row("session_end", None, 5), row("session_end", "[1]", 6),
    row("session_end", '{"duration_ms": null, "x": {"duration_ms": 9}}', 7, ("2024-01-06", "2024-01-06 23:59:59")),
    row("deposit_success", '{"provider": "moon"}'), row("deposit_success", '{"provider": ""}'), row("deposit_error", '{"provider": 5}'),
    row("notification_tap", '{"ticker": "T1"}'), row("notification_tap", '{"ticker": "T1", "deep": [1, 2]}', 1), row("notification_tap", "{}", 2),
    *[row("session_end", f'{{"duration_ms": {i}, "provider": "p{i % 3}", "other": "{"x" * 50}"}}', i, ("2024-01-07", f"2024-01-07 01:{i % 60:02}:00")) for i in range(300)],
]


@pytest.fixture(scope="module")
def both(spark):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    path = work_dir(spark, "t-shredded")
    write_shredded_events(raw, path)
    return normalize_events(raw), normalize_events(spark.read.parquet(path)), path


RESULTS = [A.session_durations, U.deposits_by_provider, M.top_tapped_tickers, M.notification_kpis]


@pytest.mark.parametrize("result", RESULTS)
def test_same_results_as_from_text(both, result):
    text, stored, _ = both
    assert sorted(map(tuple, result(stored).collect())) == sorted(map(tuple, result(text).collect()))


@pytest.mark.parametrize("result", RESULTS[:3])
def test_only_the_asked_field_is_read(both, result):
    plan = result(both[1])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans
    for line in scans:
        read = line.split("ReadSchema:")[1]
        assert "metadata:struct<" in read and "metadata:variant" not in read


def test_files_hold_the_field_as_a_column(both):
    import glob

    import pyarrow.parquet as pq
    schema = pq.read_schema(glob.glob(f"{both[2]}/date=2024-01-07/*.parquet")[0])
    fields = {f.name for f in schema.field("metadata").type.field("typed_value").type}
    assert {"duration_ms", "provider"} <= fields


def test_a_day_may_be_written_again(spark, both):
    text, _, path = both
    write_shredded_events(spark.createDataFrame(ROWS, SCHEMA).where("date = '2024-01-07'"), path)
    again = normalize_events(spark.read.parquet(path))
    assert again.count() == text.count() and again.where(F.col("metadata").isNull()).count() == 2
