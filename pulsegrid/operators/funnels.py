"""Funnels, deposit providers, feature engagement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (DEPOSIT_EVENTS, ENGAGEMENT_EVENTS, FUNNEL_DEPOSIT, FUNNEL_NOTIFICATION_TRADE,
                         FUNNEL_TRADE)
from ..functions import metadata


def funnel(ev: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct users per (label, event) step and their share of the step before.

    Steps are counted on their own: users need not pass them in order. One pass with a single
    distinct count serves all steps.
    """
    wanted = [event for _, event in steps]
    return funnel_of(ev.where(F.col("event").isin(wanted)).groupBy("event")
                     .agg(F.count_distinct("wallet_address").alias("users")), steps)


def funnel_of(users: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """The steps with the users (event, users) that each has, and their share of the step before."""
    spine = users.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.lit(event).alias("event"))
        for i, (label, event) in enumerate(steps, 1)])))
    counted = spine.join(users, "event", "left").withColumn("users", F.coalesce("users", F.lit(0)))
    before = F.lag("users").over(Window.orderBy("step"))
    return counted.select("step", "label", "event", "users",
                          (F.try_divide("users", before) * 100).alias("pct_of_previous")).orderBy("step")


def funnel_notification_trade(ev: DataFrame) -> DataFrame:
    return funnel(ev, FUNNEL_NOTIFICATION_TRADE)


def funnel_trade(ev: DataFrame) -> DataFrame:
    return funnel(ev, FUNNEL_TRADE)


def funnel_deposit(ev: DataFrame) -> DataFrame:
    return funnel(ev, FUNNEL_DEPOSIT)


def deposits_by_provider(ev: DataFrame) -> DataFrame:
    """Deposit events by metadata provider and event name."""
    deposits = ev.where(F.col("event").isin(DEPOSIT_EVENTS))
    named = deposits.where(metadata.truthy(deposits, "provider"))
    return (named.groupBy(metadata.text(named, "provider").alias("provider"), "event")
            .agg(F.count("*").alias("count")).orderBy("provider", "event"))


def feature_engagement(ev: DataFrame, events: Sequence[str] = ENGAGEMENT_EVENTS) -> DataFrame:
    """Rows and distinct users of the feature events that occur."""
    return (ev.where(F.col("event").isin(list(events))).groupBy("event")
            .agg(F.count("*").alias("total"), F.count_distinct("wallet_address").alias("users"))
            .orderBy(F.desc("total"), "event"))
