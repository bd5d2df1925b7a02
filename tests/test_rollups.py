"""Stored rollups: the same results as from points, day by day, in any order, however often."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from pulsegrid.operators import health as H
from pulsegrid.session import work_dir
from pulsegrid.sources import metric_series, metric_series_by_dim, read_rollup, write_rollup

SCHEMA = "ts timestamp_ntz, namespace string, metric_name string, value double, dims map<string,string>"
START = datetime(2024, 1, 1)


def rows_of(days, seed=1):
    pick = random.Random(seed)
    out = []
    for _ in range(1500):
        dims = pick.choice([None, {}, {"Environment": "development"}, {"Environment": "development", "Venue": pick.choice(["ostium", "lighter"])}])
        ts = START + timedelta(days=pick.randrange(days), seconds=pick.randrange(86400), microseconds=pick.randrange(10**6))
        out.append((ts, pick.choice([None, "n"]), pick.choice(["a", "b"]), pick.choice([None, float(pick.randint(-9, 9))]), dims))
    return out + [(None, "n", "a", 1.0, None)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(rows_of(4), SCHEMA).cache()


@pytest.fixture(scope="module")
def stored(spark, points):
    path = work_dir(spark, "t-rollup")
    write_rollup(points, path)
    return path


def content(spark, path):
    return [sorted([tuple(map(str, r)) for r in read_rollup(spark, path, p).collect()]) for p in (300, 900, 3600)]


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("period", [300, 900, 1800, 3600, 86400])
@pytest.mark.parametrize("stat", ["Sum", "Average", "Minimum", "Maximum"])
def test_series_equal_those_of_the_points(spark, points, stored, period, stat):
    for dims, exact in (({}, True), ({"Environment": "development"}, True), ({"Environment": "development"}, False)):
        kwargs = dict(period=period, hours=None, dims=dims, exact_dims=exact)
        want = metric_series(points.where("ts IS NOT NULL"), "a", stat, **kwargs).collect()
        assert metric_series(read_rollup(spark, stored, period), "a", stat, **kwargs).collect() == want and want


def test_namespace_and_dimension(spark, points, stored):
    kwargs = dict(period=900, hours=None, dims={"Environment": "development"}, namespace="n")
    by = lambda p: metric_series_by_dim(p, "b", "Venue", ["ostium", "lighter"], "Sum", **kwargs).collect()
    assert by(read_rollup(spark, stored, 900)) == by(points) != []


def test_a_lookback_reads_its_days_only(spark, points, stored):
    kwargs = dict(hours=24, end="2024-01-04 00:00:00")
    read = read_rollup(spark, stored, 300, **kwargs)
    assert {r["day"] for r in read.select("day").distinct().collect()} == {"2024-01-03", "2024-01-04"}
    want = metric_series(points, "a", "Sum", period=300, exact_dims=False, **kwargs).collect()
    assert metric_series(read, "a", "Sum", period=300, exact_dims=False, **kwargs).collect() == want and want


def test_days_in_any_order_and_again(spark, points, stored):
    path = work_dir(spark, "t-days")
    for day in ("2024-01-03", "2024-01-01", "2024-01-04", "2024-01-02", "2024-01-03"):
        write_rollup(points, path, day, day)
    assert content(spark, path) == content(spark, stored)
    before = files(path)
    write_rollup(points, path, "2024-01-02", "2024-01-03")
    after = files(path)
    assert content(spark, path) == content(spark, stored)
    other = {f: t for f, t in before.items() if "day=2024-01-01" in f or "day=2024-01-04" in f}
    assert other and other.items() <= after.items()


def test_late_points_and_failures(spark, points, stored, monkeypatch):
    """A run that stops between the resolutions is made good by the next; late points come in when their day is run again."""
    from pulsegrid.sources import rollups
    path = work_dir(spark, "t-late")
    early = points.where("NOT (metric_name = 'b' AND ts >= '2024-01-02' AND ts < '2024-01-03')")
    write_rollup(early, path)
    write, done = rollups._write, []

    def stops(states, where, period):
        if done:
            raise RuntimeError("executor lost")
        done.append(write(states, where, period))

    monkeypatch.setattr(rollups, "_write", stops)
    with pytest.raises(RuntimeError):
        write_rollup(points, path, "2024-01-02", "2024-01-02")
    monkeypatch.setattr(rollups, "_write", write)
    assert content(spark, path) != content(spark, stored)
    write_rollup(points, path, "2024-01-02", "2024-01-02")
    assert content(spark, path) == content(spark, stored)


def test_health_takes_a_rollup(spark, frame):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    dims = {"Environment": "development"}
    points = frame(SCHEMA, [(at(1), None, "api_latency", 10.0, dims)])
    from pulsegrid import constants as C
    points = frame(SCHEMA, [(at(m), None, name, v, dims) for m, name, v in [
        (1, C.METRIC_API_LATENCY, 10.0), (2, C.METRIC_API_LATENCY, 30.0), (7, C.METRIC_API_LATENCY, 100.0), (3, C.METRIC_API_REQUEST, 5.0), (9, C.METRIC_API_REQUEST, 6.0)]])
    path = work_dir(spark, "t-health")
    write_rollup(points, path)
    got = H.api_health(read_rollup(spark, path, 300), period=300, hours=None).collect()
    assert got == H.api_health(points, period=300, hours=None).collect()
    assert got[0]["avg_latency_ms"] == 60.0 and got[0]["requests"] == 11       # the mean of the means of two periods


def test_nothing_to_write(spark, frame):
    path = work_dir(spark, "t-empty")
    write_rollup(frame(SCHEMA, []), path)
    assert read_rollup(spark, path, 3600).count() == 0
    with pytest.raises(ValueError):
        read_rollup(spark, path, 60)


def test_other_metrics_are_skipped(spark, stored):
    plan = metric_series(read_rollup(spark, stored, 300), "a", period=300, hours=None)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(metric_name,a)" in scan or "In(metric_name" in scan
