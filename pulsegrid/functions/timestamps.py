"""UTC and local time.

Instants are kept as TIMESTAMP_NTZ in UTC, and local time is derived from them once. Where the
session time zone is UTC (as `session.SETTINGS` has it) the conversions go through TIMESTAMP,
where casts are free and a zone shift costs a fraction of convert_timezone. In any other session
zone they use expressions that do not depend on it. The results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OFFSET = r"(?i)(Z|[+-]\d{2}(:?\d{2})?)$"
_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def _utc_session() -> bool:
    return SparkSession.active().conf.get("spark.sql.session.timeZone") in _UTC_NAMES


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def from_micros(us: Column) -> Column:
    """UTC wall clock of microseconds since the epoch."""
    if _utc_session():
        return F.timestamp_micros(us).cast("timestamp_ntz")
    return _epoch() + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)"))


def micros(utc: Column) -> Column:
    """Microseconds since the epoch of a UTC wall clock."""
    if _utc_session():
        return F.unix_micros(utc.cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", _epoch(), utc)


def instant_to_utc(instant: Column) -> Column:
    """TIMESTAMP (an instant) to its UTC wall clock."""
    return instant.cast("timestamp_ntz") if _utc_session() else from_micros(F.unix_micros(instant))


def to_utc(df: DataFrame, name: str) -> Column:
    """Column `name` of `df` as UTC wall clock: naive values are UTC, bad text is null."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, T.TimestampType):
        return instant_to_utc(col)
    text = F.trim(col.cast("string"))
    has_offset = text.rlike(r"\d{1,2}:\d{2}") & text.rlike(_OFFSET)
    return F.when(has_offset, instant_to_utc(text.try_cast("timestamp"))).otherwise(
        text.try_cast("timestamp_ntz"))


def to_local(utc: Column, tz: str) -> Column:
    """Wall clock in `tz` of a UTC wall clock."""
    if _utc_session():
        return F.from_utc_timestamp(utc.cast("timestamp"), tz).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned tumbling bucket that holds `ts`."""
    return F.window(ts, f"{int(seconds)} seconds")["start"]
