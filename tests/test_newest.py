"""The newest rows come from the newest folders."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulsegrid.session import work_dir
from pulsegrid.sources import day_folders, newest_rows

SCHEMA = "ts timestamp_ntz, kind string, n int, day string"
START = date(2024, 1, 1)


def at(day, hour=12):
    return datetime(START.year, START.month, START.day, hour) + timedelta(days=day)


def written(spark, rows):
    path = work_dir(spark, "t-newest")
    df = spark.createDataFrame([(ts, kind, n, None if day is None else str(START + timedelta(days=day))) for ts, kind, n, day in rows], SCHEMA)
    df.repartition("day").write.partitionBy("day").parquet(path)
    return path, df


def read(spark, path, day="string"):
    return spark.read.schema(SCHEMA.replace("day string", f"day {day}")).parquet(path)


def latest(df, k, kind="a"):
    return [(r["ts"], r["n"]) for r in df.where(F.col("kind") == kind).orderBy(F.desc_nulls_last("ts"), "n").limit(k).collect()]


ROWS = [(at(d, h), "a" if (d + h) % 3 else "b", 100 * d + h, d) for d in (0, 1, 2, 5, 30, 31, 60) for h in (1, 2, 2, 9)]


@pytest.mark.parametrize("day", ["string", "date"])
@pytest.mark.parametrize("k", [1, 3, 4, 9, 18, 19, 1000])
def test_equal_to_all_rows(spark, k, day):
    """Sparse days, ties, and more rows asked for than there are."""
    path, df = written(spark, [*ROWS, (None, "a", 1, 60), (None, "a", 2, 0), (at(3), "a", 5, None)])
    for kind in ("a", "b", "none"):
        assert latest(newest_rows(read(spark, path, day), k, "day", F.col("kind") == kind, "ts"), k, kind) == latest(df, k, kind)


def test_older_folders_are_not_read(spark):
    """Files of the days before are garbage, which a reader would stumble over."""
    path, df = written(spark, ROWS)
    for file in Path(path).rglob("*.parquet"):
        if file.parent.name < "day=2024-01-31":
            file.write_bytes(b"garbage")
    assert latest(newest_rows(read(spark, path), 5, "day", F.col("kind") == "a", "ts"), 5) == latest(df, 5)
    with pytest.raises(Exception, match="garbage|Parquet|footer"):
        latest(newest_rows(read(spark, path), 12, "day", F.col("kind") == "a", "ts"), 12)


def test_rows_off_their_day(spark):
    """A day of slack finds rows that lie one folder early."""
    path, df = written(spark, [(at(5), "a", 1, 5), (at(5, 13), "a", 2, 4), (at(1), "a", 3, 1)])
    one = lambda slack: latest(newest_rows(read(spark, path), 1, "day", F.col("kind") == "a", "ts", slack_days=slack), 1)
    assert one(1) == latest(df, 1) == [(at(5, 13), 2)] and one(0) == [(at(5), 1)]


def test_days_come_from_the_paths(spark):
    path, _ = written(spark, [*ROWS, (at(3), "a", 5, None)])
    assert day_folders(read(spark, path), "day") == [START + timedelta(days=d) for d in (60, 31, 30, 5, 2, 1, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert newest_rows(empty, 5, "day", ts="ts").count() == 0
