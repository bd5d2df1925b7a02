"""Audience and activity of real users. `ev` is real_users(normalize_events(...)); `evall`
also holds the server rows. Distinct counts are exact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (APP_PLATFORMS, DEFAULT_TZ, DOW_SUNDAY_FIRST, SESSION_END, SESSION_START)
from ..functions import metadata
from ..functions.frames import count_if, fill_spine, fixed_list, top, top_per, whole_range
from ..functions.numbers import half_even, percent, ratio
from ..functions.timestamps import bucket, to_local
from ..functions.wallets import short_wallet
from .identity import enrich_identity, enrich_top
from .normalize import is_real_user

WALLET = "wallet_address"


def _lit_day(day: date | str) -> Column:
    return F.lit(day if isinstance(day, date) else date.fromisoformat(day))


def event_totals(evall: DataFrame) -> DataFrame:
    """All events, server rows included, and distinct real users."""
    return evall.agg(F.count("*").alias("total_events"),
                     F.count_distinct(F.when(is_real_user(), F.col(WALLET))).alias("unique_users"))


def dau(ev: DataFrame) -> DataFrame:
    """Distinct users per local day."""
    return (ev.where(F.col("date").isNotNull())
            .groupBy("date").agg(F.count_distinct(WALLET).alias("users")).orderBy("date"))


def _timed_session(df: DataFrame) -> Column:
    """Duration of a session_end row that carries a positive number, else null."""
    duration = metadata.numeric(df, "duration_ms")
    return F.when((F.col("event") == SESSION_END) & (duration > 0), duration)


def session_durations(ev: DataFrame) -> DataFrame:
    """One row per ended session with a positive numeric duration."""
    ends = ev.where(F.col("event") == SESSION_END)
    return (ends.select(WALLET, "session_id", metadata.numeric(ends, "duration_ms").alias("duration_ms"), "date")
            .where(F.col("duration_ms") > 0))


def overview_kpis(ev: DataFrame) -> DataFrame:
    """Mean daily users, unique users, sessions started, mean session length.

    Events are first reduced to one row per user and day, so the two distinct counts run on that
    small frame and a hot user or day is combined before the shuffle.
    """
    per_user_day = (ev.withColumn("_ms", _timed_session(ev)).groupBy("date", WALLET)
                    .agg(count_if(F.col("event") == SESSION_START).alias("sessions"),
                         F.sum("_ms").alias("ms"), F.count("_ms").alias("timed")))
    user_days = F.count(F.when(F.col("date").isNotNull(), F.col(WALLET)))
    return per_user_day.agg(
        ratio(user_days, F.count_distinct("date")).alias("avg_dau"),
        F.count_distinct(WALLET).alias("unique_users"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"),
        ratio(F.sum("ms"), F.sum("timed")).alias("avg_session_ms"))


def _activity(ev: DataFrame) -> DataFrame:
    return (ev.where(F.col(WALLET).isNotNull()).groupBy(WALLET)
            .agg(F.count("event").alias("events"), F.count_distinct("date").alias("days_active"),
                 F.min("date").alias("first_seen"), F.max("date").alias("last_seen")))


def user_activity(ev: DataFrame, identity: DataFrame) -> DataFrame:
    """Events, active days, first and last day of every user; latest first."""
    users = enrich_identity(_activity(ev), identity, hot=False)
    return users.withColumn("wallet_short", short_wallet(F.col(WALLET))).orderBy(F.desc("last_seen"), WALLET)


def most_active_users(ev: DataFrame, people: DataFrame, *, k: int = 20) -> DataFrame:
    users = enrich_top(top(_activity(ev), k, "events", WALLET), people)
    return users.withColumn("wallet_short", short_wallet(F.col(WALLET))).orderBy(F.desc("events"), WALLET)


def concurrent_users(ev: DataFrame, *, minutes: int = 5, tz: str = DEFAULT_TZ) -> DataFrame:
    """Distinct users per bucket and the mean with the neighbouring buckets that exist.

    Buckets are cut in UTC and shown in local time. The frame that runs over one partition is
    the bucket list (288 rows a day), not the events.
    """
    per_bucket = (ev.where(F.col("ts").isNotNull())
                  .groupBy(bucket(F.col("ts"), minutes * 60).alias("time_utc"))
                  .agg(F.count_distinct(WALLET).alias("viewers")))
    neighbours = Window.orderBy("time_utc").rowsBetween(-1, 1)
    return per_bucket.select(
        "time_utc", to_local(F.col("time_utc"), tz).alias("time"), "viewers",
        F.avg("viewers").over(neighbours).alias("viewers_smooth")).orderBy("time_utc")


def wau_mau(ev: DataFrame, today: date | str) -> DataFrame:
    """Users seen on or after today - 7 and today - 30: decided by each user's last day."""
    last = (ev.where(F.col(WALLET).isNotNull()).groupBy(WALLET).agg(F.max("date").alias("last")))
    since = lambda days: F.col("last") >= F.date_sub(_lit_day(today), days)
    return last.agg(count_if(since(7)).alias("wau"), count_if(since(30)).alias("mau"))


def new_vs_returning(ev: DataFrame, start: date | str) -> DataFrame:
    """Users first seen on or after `start`, and the rest."""
    first = ev.where(F.col(WALLET).isNotNull()).groupBy(WALLET).agg(F.min("date").alias("first"))
    return (first.agg(count_if(F.col("first") >= _lit_day(start)).alias("new_users"),
                      F.count("*").alias("unique_users"))
            .select("new_users", (F.col("unique_users") - F.col("new_users")).alias("returning_users"),
                    percent(F.col("new_users"), F.col("unique_users")).alias("new_pct")))


def events_per_user(ev: DataFrame) -> DataFrame:
    return (ev.agg(F.count("*").alias("events"), F.count_distinct(WALLET).alias("unique_users"))
            .withColumn("events_per_user", ratio(F.col("events"), F.col("unique_users"))))


# --- by platform --------------------------------------------------------------

def app_events(ev: DataFrame) -> DataFrame:
    """Events of the two apps; `platform` is lower case."""
    return ev.withColumn("platform", F.lower("platform")).where(F.col("platform").isin(APP_PLATFORMS))


def platform_kpis(ev: DataFrame) -> DataFrame:
    """Users, mean session, events per user and timed sessions of each app."""
    apps = app_events(ev)
    per_user = (apps.withColumn("_ms", _timed_session(apps)).groupBy("platform", WALLET)
                .agg(F.count("*").alias("events"), F.sum("_ms").alias("ms"), F.count("_ms").alias("timed")))
    per_app = (per_user.groupBy("platform")
               .agg(F.count(WALLET).alias("users"), F.sum("events").alias("events"),
                    F.sum("ms").alias("ms"), F.sum("timed").alias("timed"))
               .select("platform", "users", (ratio(F.col("ms"), F.col("timed")) / 1000).alias("avg_session_s"),
                       ratio(F.col("events"), F.col("users")).alias("events_per_user"),
                       F.col("timed").alias("timed_sessions")))
    spine = fixed_list(ev.sparkSession, "platform", APP_PLATFORMS).drop("step")
    return fill_spine(spine, per_app, "platform", users=0, avg_session_s=0.0, events_per_user=0.0,
                      timed_sessions=0).orderBy("platform")


def dau_by_platform(ev: DataFrame) -> DataFrame:
    """Distinct users per day and app, 0 where one app has none."""
    daily = (app_events(ev).where(F.col("date").isNotNull())
             .groupBy("date").pivot("platform", APP_PLATFORMS).agg(F.count_distinct(WALLET)))
    return daily.fillna(0, APP_PLATFORMS).orderBy("date")


def top_events_by_platform(ev: DataFrame, *, k: int = 10) -> DataFrame:
    counts = (app_events(ev).where(F.col("event").isNotNull())
              .groupBy("platform", "event").agg(F.count("*").alias("count")))
    return top_per(counts, "platform", k, "count", "event").orderBy("platform", F.desc("count"), "event")


# --- event counts -------------------------------------------------------------

def _count_by(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def events_by_day(ev: DataFrame) -> DataFrame:
    return _count_by(ev, "date").orderBy("date")


def top_events(ev: DataFrame, *, k: int = 12) -> DataFrame:
    return top(_count_by(ev, "event"), k, "count", "event")


def events_by_hour(ev: DataFrame) -> DataFrame:
    """Events per local hour, all 24 hours."""
    return fill_spine(whole_range(ev.sparkSession, "hour", 24), _count_by(ev, "hour", "events"),
                      "hour", events=0).orderBy("hour")


def events_by_dow(ev: DataFrame) -> DataFrame:
    """Events per weekday, all seven, 0 = Sunday."""
    counts = _count_by(ev.withColumnRenamed("day_of_week", "dow"), "dow", "events")
    days = fill_spine(whole_range(ev.sparkSession, "dow", 7), counts, "dow", events=0)
    return days.withColumn("day", day_name(F.col("dow"), DOW_SUNDAY_FIRST)).orderBy("dow")


def day_name(dow: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), dow)


def activity_heatmap(ev: DataFrame) -> DataFrame:
    """Events by weekday (rows, 0 = Sunday) and hour (columns h0 .. h23), 0 filled."""
    hours = list(range(24))
    counts = (ev.where(F.col("day_of_week").isNotNull() & F.col("hour").isNotNull())
              .groupBy(F.col("day_of_week").alias("dow")).pivot("hour", hours).count())
    counts = counts.select("dow", *[F.col(str(h)).alias(f"h{h}") for h in hours])
    grid = whole_range(ev.sparkSession, "dow", 7).join(counts, "dow", "left").fillna(0)
    return grid.select(day_name(F.col("dow"), DOW_SUNDAY_FIRST).alias("day"), "*").orderBy("dow")


# --- leaderboards and one user --------------------------------------------------

def time_spent_leaderboard(ev: DataFrame, people: DataFrame, *, k: int = 20,
                           digits: int | None = 1) -> DataFrame:
    """Users by minutes in the app; ranked by the rounded total."""
    per_user = (session_durations(ev).where(F.col(WALLET).isNotNull()).groupBy(WALLET)
                .agg(half_even(F.sum("duration_ms") / 60000, digits).alias("total_time_min"),
                     F.count("session_id").alias("sessions"),
                     half_even(F.avg("duration_ms") / 60000, digits).alias("avg_session_min")))
    best = enrich_top(top(per_user, k, "total_time_min", WALLET), people)
    return (best.withColumn("wallet_short", short_wallet(F.col(WALLET)))
            .orderBy(F.desc("total_time_min"), WALLET))


def user_list(ev: DataFrame, identity: DataFrame) -> DataFrame:
    """All users by wallet, with label and short form."""
    wallets = ev.where(F.col(WALLET).isNotNull()).select(WALLET).distinct()
    return (enrich_identity(wallets, identity, hot=False)
            .select(WALLET, "user_label", short_wallet(F.col(WALLET)).alias("wallet_short")).orderBy(WALLET))


def user_profile(ev: DataFrame, people: DataFrame, wallet: str) -> DataFrame:
    """One user: identity, events, active days, minutes in the app."""
    one = ev.where(F.col(WALLET) == wallet)
    per_day = (one.withColumn("_ms", _timed_session(one)).groupBy(WALLET, "date")
               .agg(F.count("*").alias("events"), F.sum("_ms").alias("ms")))
    facts = per_day.groupBy(WALLET).agg(
        F.sum("events").alias("events"), F.count("date").alias("days_active"),
        (F.coalesce(F.sum("ms"), F.lit(0.0)) / 60000).alias("total_min"))
    return enrich_top(facts, people)


def user_event_breakdown(ev: DataFrame, wallet: str, *, k: int = 10) -> DataFrame:
    return top(_count_by(ev.where(F.col(WALLET) == wallet), "event"), k, "count", "event")


def user_daily_activity(ev: DataFrame, wallet: str) -> DataFrame:
    return _count_by(ev.where(F.col(WALLET) == wallet), "date", "events").orderBy("date")
