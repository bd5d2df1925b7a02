"""Scans. A source is a table folder (Parquet, or JSON lines) or a DataFrame already read.

Events are laid out with `partitionBy("date")` and trades with `partitionBy("trade_date")` (UTC
days), so the range predicates below prune folders before any file is opened.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..constants import DEFAULT_TZ
from ..functions.timestamps import to_local, to_utc


def _day(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def read_table(source: DataFrame | str, schema: T.StructType | None = None,
               fmt: str = "parquet", spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is; a path through the reader of `fmt`.

    Parquet carries its own types; JSON is read with the declared schema, never inferred.
    """
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.active()
    reader = spark.read.format(fmt)
    if fmt == "json" and schema is not None:
        reader = reader.schema(schema)
    return reader.load(source)


def _between_days(df: DataFrame, name: str, start: date, end: date) -> Column:
    """Day range on a partition column, in the type the layout has (text or date)."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return col.between(start.isoformat(), end.isoformat())
    return col.between(F.lit(start), F.lit(end))


def scan_events(source: DataFrame | str, start: date | str, end: date | str, *,
                trim_local: bool = False, tz: str = DEFAULT_TZ, fmt: str = "parquet") -> DataFrame:
    """Events of the UTC partitions `start` .. `end` + 1 day.

    The extra day holds late local-evening events. Events of other local days that these
    partitions also hold are kept unless `trim_local` is set.
    """
    start, end = _day(start), _day(end)
    df = read_table(source, schemas.EVENTS, fmt)
    df = df.where(_between_days(df, "date", start, end + timedelta(days=1)))
    if trim_local:
        local = F.to_date(to_local(to_utc(df, "timestamp"), tz))
        df = df.where(local.between(F.lit(start), F.lit(end)))
    return df


def scan_trades(source: DataFrame | str, start: date | str, end: date | str, *,
                fmt: str = "parquet") -> DataFrame:
    """Trades of the UTC partitions `start` .. `end`."""
    df = read_table(source, schemas.TRADES, fmt)
    return df.where(_between_days(df, "trade_date", _day(start), _day(end)))


def scan_trades_by_timestamp(source: DataFrame | str, start: date | str, end: date | str, *,
                             fmt: str = "parquet") -> DataFrame:
    """Trades with `start` <= timestamp < `end` + 1 day, for tables without the day layout.

    On a typed timestamp column the bounds are plain literals that reach the Parquet reader.
    """
    df = read_table(source, schemas.TRADES, fmt)
    low = F.lit(_day(start).isoformat() + " 00:00:00").cast("timestamp_ntz")
    high = F.lit((_day(end) + timedelta(days=1)).isoformat() + " 00:00:00").cast("timestamp_ntz")
    ts = to_utc(df, "timestamp")
    return df.where((ts >= low) & (ts < high))


def scan_users(source: DataFrame | str, *, fmt: str = "parquet") -> DataFrame:
    """All user profiles with their linked accounts."""
    return schemas.conform(read_table(source, schemas.USERS, fmt), schemas.USERS)


def lookback_end(end: str | None) -> Column:
    """The given end of a lookback as UTC wall clock, or now."""
    return F.lit(end or datetime.now(UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def within_hours(df: DataFrame, hours: int | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Rows of the `hours` before `end` (exclusive), which is now unless given; with `hours=None` there is no lower bound."""
    if end is None and hours is None:
        return df
    high = lookback_end(end)
    df = df.where(F.col(ts) < high)
    return df if hours is None else df.where(F.col(ts) >= high - F.make_dt_interval(hours=F.lit(hours)))


def scan_points(source: DataFrame | str, *, fmt: str = "parquet") -> DataFrame:
    """Raw metric points."""
    return schemas.conform(read_table(source, schemas.METRIC_POINTS, fmt), schemas.METRIC_POINTS)


def scan_logs(source: DataFrame | str, group: str | None = None, hours: int | None = None,
              end: str | None = None, *, fmt: str = "parquet") -> DataFrame:
    """Log lines of one group within the lookback."""
    df = schemas.conform(read_table(source, schemas.LOGS, fmt), schemas.LOGS)
    if group is not None:
        df = df.where(F.col("log_group") == group)
    return within_hours(df, hours, end)


def scan_alarms(source: DataFrame | str, *, fmt: str = "parquet") -> DataFrame:
    """All alarm records."""
    df = schemas.conform(read_table(source, schemas.ALARMS, fmt), schemas.ALARMS)
    return df.select(*schemas.ALARMS.names)
