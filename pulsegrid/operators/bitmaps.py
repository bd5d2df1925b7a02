"""Distinct users from stored bitmaps: one bit per user, day and event; exact, and mergeable over any days.

Users get numbers without gaps, once and for all. A day's users are then bitmaps of 32,768 users each (4 KiB), whatever the number
of events. Users of a week or month, retention and funnel steps are unions of bitmaps; no event is read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import RETENTION_DAYS
from ..functions.numbers import percent
from .funnels import funnel_of

WALLET = "wallet_address"
PARTS = 1024              # parts in which new users are numbered
NUMBERS = "wallet_address string, user_no bigint"
BITMAPS = "event string, bucket bigint, bits binary, date date"


def _no_bits() -> Column:
    return F.lit(bytearray(4096))


def user_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(wallet_address, user_no) of all users so far."""
    return spark.read.schema(NUMBERS).parquet(f"{path.rstrip('/')}/numbers")


def number_users(wallets: DataFrame, first: int = 0) -> DataFrame:
    """(wallet_address, user_no): distinct wallets, numbered without gaps from `first` on.

    Numbers within a part follow the wallet, parts follow each other; so no task ranks more than one part.
    """
    part = F.pmod(F.xxhash64(WALLET), F.lit(PARTS))
    new = wallets.where(F.col(WALLET).isNotNull()).select(WALLET).distinct().withColumn("part", part)
    sizes = new.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))     # one row per part
    here = F.row_number().over(Window.partitionBy("part").orderBy(WALLET)) - 1
    return (new.withColumn("here", here).join(before, "part")
            .select(WALLET, (F.lit(first) + F.col("before") + F.col("here")).cast("bigint").alias("user_no")))


def write_user_bitmaps(ev: DataFrame, path: str, start: date | str | None = None, end: date | str | None = None,
                       events: Sequence[str] | None = None) -> None:
    """Writes the users of the local days `start` .. `end` (of all where unset) below `path`: numbers of new users, and bitmaps.

    `ev` has to hold these days whole. Users keep the number they have; new ones follow. A day's bitmaps are replaced, so
    a day may be run again, also after a failure or with late events. Bitmaps are kept for any event (`event` is null) and for
    each of `events`, or each event there is. Rows without wallet or day count nowhere.
    """
    spark, folder = ev.sparkSession, path.rstrip("/")
    seen = ev.where(F.col(WALLET).isNotNull() & F.col("date").isNotNull())
    if start is not None:
        seen = seen.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        seen = seen.where(F.col("date") <= F.lit(str(end)).cast("date"))
    kept = F.lit(True) if events is None else F.col("event").isin(list(events))
    active = seen.select("date", F.when(kept, F.col("event")).alias("event"), WALLET).distinct()
    # An append without rows makes the table on the first run.
    spark.createDataFrame([], NUMBERS).write.mode("append").parquet(f"{folder}/numbers")
    known = user_numbers(spark, folder)
    last = known.agg(F.max("user_no")).first()[0]
    new = active.select(WALLET).join(known, WALLET, "left_anti")
    number_users(new, 0 if last is None else last + 1).write.mode("append").parquet(f"{folder}/numbers")
    numbered = active.join(user_numbers(spark, folder), WALLET).withColumn("place", F.col("user_no") + 1)
    sets = numbered.groupBy("date", "event", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    every = sets.groupBy("date", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    rows = sets.where("event IS NOT NULL").unionByName(every.withColumn("event", F.lit(None).cast("string")))
    (rows.select("event", "bucket", "bits", "date").repartition("date", F.pmod(F.xxhash64("event", "bucket"), F.lit(16)))
     .sortWithinPartitions("date", "event", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{folder}/bitmaps"))


def read_user_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """(event, bucket, bits, date); a null event stands for any."""
    return spark.read.schema(BITMAPS).parquet(f"{path.rstrip('/')}/bitmaps")


def _any(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.where(F.col("event").isNull())


def _users(bits: Column | str) -> Column:
    return F.coalesce(F.sum(F.bitmap_count(bits)), F.lit(0))


def bitmap_dau(bitmaps: DataFrame) -> DataFrame:
    """Distinct users per local day; equal to `audience.dau` on days with a known user."""
    return _any(bitmaps).groupBy("date").agg(_users("bits").alias("users")).orderBy("date")


def bitmap_users_per(bitmaps: DataFrame, unit: str) -> DataFrame:
    """Distinct users per calendar `unit` ("week", from Monday on, "month", ...): first day and users."""
    merged = _any(bitmaps).groupBy(F.trunc("date", unit).alias("start"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("start").agg(_users("bits").alias("users")).orderBy("start")


def bitmap_wau_mau(bitmaps: DataFrame, today: date | str) -> DataFrame:
    """Users seen on or after today - 7 and today - 30; equal to `audience.wau_mau`. Only these day folders are read."""
    since = lambda days: F.date_sub(F.lit(str(today)).cast("date"), days)
    recent = F.when(F.col("date") >= since(7), F.col("bits")).otherwise(_no_bits())
    merged = _any(bitmaps).where(F.col("date") >= since(30)).groupBy("bucket").agg(
        F.bitmap_or_agg(recent).alias("week"), F.bitmap_or_agg("bits").alias("month"))
    return merged.agg(_users("week").alias("wau"), _users("month").alias("mau"))


def bitmap_retention(bitmaps: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """Per first-seen day: cohort size and the share active exactly D days later; equal to `retention.cohort_retention`.

    With S the users up to a day and P those up to the day before, the cohort is S without P. Of any set X it holds
    |S| - |P| - |S or X| + |P or X| users, so unions and counts suffice.
    """
    daily = _any(bitmaps).select("date", "bucket", "bits")
    by_day = Window.partitionBy("bucket").orderBy("date")       # one row per day
    grown = daily.withColumn("upto", F.bitmap_or_agg("bits").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    grown = grown.select("bucket", F.col("date").alias("cohort"), "upto", F.coalesce(F.lag("upto").over(by_day), _no_bits()).alias("before"))
    sizes = grown.groupBy("cohort").agg(F.sum(F.bitmap_count("upto") - F.bitmap_count("before")).alias("users")).where("users > 0")
    asked = grown.withColumn("d", F.explode(F.array(*[F.lit(d) for d in days]))).withColumn("day", F.date_add("cohort", F.col("d")))
    met = asked.join(daily.withColumnsRenamed({"date": "day", "bits": "x"}), ["bucket", "day"])
    side = lambda sign, bits: [F.struct(F.lit(sign).alias("sign"), b.alias("bits"), F.bitmap_count(bits).alias("own")) for b in (F.col(bits), F.col("x"))]
    sides = met.select("cohort", "d", "bucket", F.inline(F.array(*side(1, "upto"), *side(-1, "before"))))
    united = sides.groupBy("cohort", "d", "bucket", "sign", "own").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("all"))
    back = united.groupBy("cohort").agg(*[F.sum(F.when(F.col("d") == d, F.col("sign") * (F.col("own") - F.col("all")))).alias(f"_{d}") for d in days])
    found = sizes.join(back, "cohort", "left")
    return found.select("cohort", "users", *[percent(F.coalesce(f"_{d}", F.lit(0)), F.col("users")).alias(f"D{d}") for d in days]).orderBy("cohort")


def bitmap_funnel(bitmaps: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct users per (label, event) step; equal to `funnels.funnel`."""
    merged = bitmaps.where(F.col("event").isin([event for _, event in steps])).groupBy("event", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return funnel_of(merged.groupBy("event").agg(_users("bits").alias("users")), steps)
