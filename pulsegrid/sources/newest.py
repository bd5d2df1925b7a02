"""The newest rows of a table laid out by day, without its older folders."""

from __future__ import annotations

import re
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import _between_days


def day_folders(df: DataFrame, day_column: str) -> list[date]:
    """The days that a table read from day folders has, latest first; taken from its paths, no file is opened.

    Rows without a day lie in a folder of their own, which is not among them.
    """
    folder = re.compile(rf"/{re.escape(day_column)}=([^/]+)/")
    found = {unquote(match[1]) for path in df.inputFiles() if (match := folder.search(path))}
    return sorted((date.fromisoformat(day) for day in found if not day.startswith("__")), reverse=True)


def newest_rows(df: DataFrame, k: int, day_column: str, wanted: Column | None = None, ts: str = "timestamp", slack_days: int = 0) -> DataFrame:
    """Rows of `df` among which its `k` latest `wanted` ones by `ts` are for sure, read from as few day folders as that takes.

    `df` is read from folders by day (`partitionBy(day_column)`), and a row lies in the folder of its UTC day, or `slack_days` off it. From
    the latest day on, 1, 2, 4, ... folders are looked at until they hold `k` wanted rows with a time, at most `k` rows each
    time; so a table with sparse days costs few rounds. Days before the last one looked at cannot hold a later row. Rows without
    a day are always read, and all rows are where there are not `k`. The lookups run right away, which is what saves the reading.
    """
    wanted = F.coalesce(wanted if wanted is not None else F.lit(True), F.lit(False)) & F.col(ts).isNotNull()
    days, found, at, step = day_folders(df, day_column), 0, 0, 1
    while found < k and at < len(days):
        some = days[at:at + step]
        found += df.where(_between_days(df, day_column, some[-1], some[0]) & wanted).limit(k - found).count()
        at, step = at + len(some), 2 * step
    if found < k:
        return df
    since = days[at - 1] - timedelta(days=slack_days)
    return df.where(F.col(day_column).isNull() | _between_days(df, day_column, since, date.max))
