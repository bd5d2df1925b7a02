"""How a registered query is put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.identity import wallet_identity
from ..operators.normalize import normalize_events, normalize_trades, real_users
from . import fixtures


class Inputs:
    """The frames the analyses take, built on first use. Nothing runs until a result is read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return fixtures.events(self.spark, self.sf_dir)

    @cached_property
    def evall(self) -> DataFrame:
        return normalize_events(self.events)

    @cached_property
    def ev(self) -> DataFrame:
        return real_users(self.evall)

    @cached_property
    def cohort_ev(self) -> DataFrame:
        return real_users(normalize_events(fixtures.cohort_events(self.spark, self.sf_dir)))

    @cached_property
    def trades(self) -> DataFrame:
        return fixtures.trades(self.spark, self.sf_dir)

    @cached_property
    def tr(self) -> DataFrame:
        return normalize_trades(self.trades)

    @cached_property
    def users(self) -> DataFrame:
        return fixtures.users(self.spark, self.sf_dir)

    @cached_property
    def identity(self) -> DataFrame:
        return wallet_identity(self.users)

    @cached_property
    def points(self) -> DataFrame:
        return fixtures.points(self.spark, self.sf_dir)

    @cached_property
    def logs(self) -> DataFrame:
        return fixtures.logs(self.spark, self.sf_dir)

    @cached_property
    def alarms(self) -> DataFrame:
        return fixtures.alarms(self.spark, self.sf_dir)


@dataclass(frozen=True)
class Query:
    """A Spark result and its SQL twin.

    `digits` names double columns that are compared after rounding, on both sides: sums and means
    of doubles depend on the order of addition in their last bits.
    """

    build: Callable[[Inputs], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(Inputs(spark, sf_dir)), self.digits)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sql = self.sql
        if self.digits:
            rounded = ", ".join(f'round("{c}", {d}) AS "{c}"' for c, d in self.digits.items())
            sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
        return fixtures.with_inputs(sql)


def present(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Days and times (to the microsecond) as text, whole numbers as bigint, the named doubles rounded."""
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            text = col.cast("timestamp_ntz").cast("string")
            col = F.concat(F.substring(text, 1, 19), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif f.name in digits:
            col = F.round(col, digits[f.name])
        out.append(col.alias(f.name))
    return df.select(*out)


def day(expr: str) -> str:
    """SQL text of a day."""
    return f"strftime({expr}, '%Y-%m-%d')"


def moment(expr: str) -> str:
    """SQL text of a time."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def short(expr: str) -> str:
    return f"CASE WHEN length({expr}) < 8 THEN {expr} ELSE left({expr}, 4) || '...' || right({expr}, 4) END"


def enriched(sql: str, columns: str = "b.*") -> str:
    return f"""SELECT {columns}, coalesce(i.label, {short('b.wallet_address')}) AS user_label,
        coalesce(i.contact, '') AS user_contact,
        CASE i.login WHEN 'google' THEN 'Google' WHEN 'email' THEN 'Email' WHEN 'apple' THEN 'Apple'
            WHEN 'twitter' THEN 'Twitter' WHEN 'phone' THEN 'Phone' WHEN 'wallet_only' THEN 'Wallet' ELSE '—' END AS login_type
        FROM ({sql}) b LEFT JOIN ident i ON lower(b.wallet_address) = i.wallet"""
