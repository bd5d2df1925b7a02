"""Stored rollups of metric points: mergeable states per series and bucket, at three resolutions.

A state is (sum, count, min, max) of the values of one series in one bucket. States of 300 seconds are made from points,
coarser ones from finer states, so points are read once. A day is rewritten as a whole: running it again, also after a failure
or with late points, gives the same table. A stored row is used like a point, with its bucket's start as `ts`, so every
metric result takes a rollup in place of the points.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import bucket
from .metrics import STATES, merged_states, point_states

PERIODS = (300, 900, 3600)
SPREAD = 16               # files a day has at most per resolution
SCHEMA = ("namespace string, metric_name string, dims map<string,string>, ts timestamp_ntz, "
          "sum double, count bigint, min double, max double, day string")


def _states(rows: DataFrame, period: int, states: dict[str, Column]) -> DataFrame:
    """One row per series and bucket; a series is its name and its exact dimensions."""
    series = F.array_sort(F.map_entries("dims"))
    grouped = rows.groupBy("namespace", "metric_name", series.alias("_dims"), bucket(F.col("ts"), period).alias("ts")).agg(
        *[column.alias(name) for name, column in states.items()])
    return grouped.select("namespace", "metric_name", F.map_from_entries("_dims").alias("dims"), "ts", *STATES,
                          F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _folder(path: str, period: int) -> str:
    return f"{path.rstrip('/')}/period={period}"


def _write(states: DataFrame, path: str, period: int) -> None:
    """Replaces the days that `states` has. Rows are sorted by metric within few files per day, so readers skip the others."""
    place = F.pmod(F.xxhash64("metric_name", F.array_sort(F.map_entries("dims"))), F.lit(SPREAD))
    (states.repartition("day", place).sortWithinPartitions("day", "metric_name", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(_folder(path, period)))


def _days(df: DataFrame, start: date | str | None, end: date | str | None) -> DataFrame:
    for value, low in ((start, True), (end, False)):
        if value is not None:
            df = df.where(F.col("day") >= str(value) if low else F.col("day") <= str(value))
    return df


def write_rollup(points: DataFrame, path: str, start: date | str | None = None, end: date | str | None = None) -> None:
    """Writes the states of the UTC days `start` .. `end` (of all points where unset) below `path`, for all `PERIODS`.

    `points` has to hold these days whole. Other days stay as they are, and so does a day without any point. Points without
    a time are left out.
    """
    rows = points.where(F.col("ts").isNotNull())
    at = lambda day, more: F.lit(f"{date.fromisoformat(str(day)) + timedelta(days=more)} 00:00:00").cast("timestamp_ntz")
    if start is not None:
        rows = rows.where(F.col("ts") >= at(start, 0))
    if end is not None:
        rows = rows.where(F.col("ts") < at(end, 1))
    _write(_states(rows, PERIODS[0], point_states()), path, PERIODS[0])
    for fine, coarse in zip(PERIODS, PERIODS[1:], strict=False):
        done = _days(points.sparkSession.read.schema(SCHEMA).parquet(_folder(path, fine)), start, end)
        _write(_states(done, coarse, merged_states()), path, coarse)


def read_rollup(spark: SparkSession, path: str, period: int, *, hours: int | None = None, end: str | None = None) -> DataFrame:
    """The stored states that results of `period` seconds need: the coarsest resolution that divides it.

    With a lookback only its day folders are read. A lookback takes whole buckets: those that start in it.
    """
    fitting = [p for p in PERIODS if period % p == 0]
    if not fitting:
        raise ValueError(f"a period has to be a multiple of {PERIODS[0]} seconds")
    states = spark.read.schema(SCHEMA).parquet(_folder(path, max(fitting)))
    if hours is None and end is None:
        return states
    last = datetime.fromisoformat(end) if end else datetime.now(UTC).replace(tzinfo=None)
    return _days(states, None if hours is None else (last - timedelta(hours=hours)).date(), last.date())
