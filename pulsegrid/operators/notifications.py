"""Notification sends, receipts, taps, and what taps lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BROADCAST_LABEL, NOTIFICATION_BROADCAST, NOTIFICATION_RECEIVED, NOTIFICATION_SENT,
                         NOTIFICATION_TAP, TARGETED_LABELS, TRADE_INITIATED)
from ..functions import metadata
from ..functions.frames import count_if, equal_width_bins, top
from ..functions.numbers import percent
from ..functions.timestamps import from_micros, micros
from .identity import enrich_top
from .normalize import is_real_user

WALLET = "wallet_address"


def notification_kpis(evall: DataFrame) -> DataFrame:
    """Sends (all rows), receipts and taps (real users only), tap rates. One pass."""
    event = F.col("event")
    df = evall.where(event.isin(NOTIFICATION_BROADCAST, NOTIFICATION_SENT, NOTIFICATION_RECEIVED, NOTIFICATION_TAP))
    tapped = (event == NOTIFICATION_TAP) & is_real_user()
    sums = df.agg(
        F.coalesce(F.sum(F.when(event == NOTIFICATION_BROADCAST, metadata.whole_number(df, "sent_count"))),
                   F.lit(0)).alias("broadcast_sent"),
        count_if((event == NOTIFICATION_SENT) & metadata.truthy(df, "success")).alias("targeted_sent"),
        count_if((event == NOTIFICATION_RECEIVED) & is_real_user()).alias("received"),
        count_if(tapped).alias("tapped"),
        F.count_distinct(F.when(tapped, F.col(WALLET))).alias("unique_tappers"))
    return (sums.withColumn("total_sent", F.col("broadcast_sent") + F.col("targeted_sent"))
            .withColumn("tap_rate_server", percent(F.col("tapped"), F.col("total_sent")))
            .withColumn("tap_rate_client", percent(F.col("tapped"), F.col("received"))))


def sends_by_type(evall: DataFrame) -> DataFrame:
    """Sends and recipients of broadcasts and of the targeted kinds that occur."""
    df = evall.where(F.col("event").isin(NOTIFICATION_BROADCAST, NOTIFICATION_SENT))
    broadcast = F.col("event") == NOTIFICATION_BROADCAST
    kind = metadata.text(df, "type")
    label = F.when(broadcast, F.lit(BROADCAST_LABEL))
    for code, name in TARGETED_LABELS.items():
        label = label.when(kind == code, F.lit(name))
    recipients = F.when(broadcast, metadata.whole_number(df, "sent_count")).otherwise(F.lit(1))
    return (df.select(label.alias("type"), recipients.alias("recipients")).where(F.col("type").isNotNull())
            .groupBy("type").agg(F.count("*").alias("sends"), F.sum("recipients").alias("recipients"))
            .orderBy(F.desc(F.col("type") == BROADCAST_LABEL), F.desc("type")))


def tap_rate_by_day(ev: DataFrame) -> DataFrame:
    """Taps per 100 receipts on every day that has either; 0 where one side is missing."""
    event = F.col("event")
    daily = (ev.where(event.isin(NOTIFICATION_RECEIVED, NOTIFICATION_TAP) & F.col("date").isNotNull())
             .groupBy("date").agg(count_if(event == NOTIFICATION_TAP).alias("_taps"),
                                  count_if(event == NOTIFICATION_RECEIVED).alias("_received")))
    return daily.select("date", percent(F.col("_taps"), F.col("_received")).alias("rate")).orderBy("date")


def time_to_trade(ev: DataFrame, *, tap: str = NOTIFICATION_TAP, conversion: str = TRADE_INITIATED,
                  window_seconds: int = 3600, bucket_seconds: int = 60) -> DataFrame:
    """Per tap the first conversion of the same wallet strictly after it and within the window.

    The search never pairs taps with conversions. The few rows that matter are shuffled once into
    short (wallet, bucket) groups. A single ordered pass over a group finds the next conversion
    inside it; where there is none, the first conversion of a later bucket is looked up, from one
    row per group. Even a wallet that owns a third of all rows is spread over as many groups as it
    has buckets, and the work stays linear.
    """
    us, group = F.col("us"), [WALLET, "bucket"]
    rows = (ev.where(F.col("event").isin(tap, conversion) & F.col(WALLET).isNotNull() & F.col("ts").isNotNull())
            .select(WALLET, micros(F.col("ts")).alias("us"), (F.col("event") == tap).alias("is_tap"),
                    (F.col("event") == conversion).alias("converts"))
            .withColumn("bucket", F.floor(us / (bucket_seconds * 1_000_000)))
            .repartition(*group))  # both uses below read this one shuffle
    converted_us = F.when(F.col("converts"), us)
    heads = rows.groupBy(*group).agg(F.min(converted_us).alias("first_us"), F.bool_or("is_tap").alias("has_tap"))
    later = Window.partitionBy(WALLET).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    followers = (heads.withColumn("later_us", F.min("first_us").over(later))
                 .where(F.col("has_tap") & F.col("later_us").isNotNull()).select(*group, "later_us"))
    # Descending order makes "strictly after" a frame that only grows.
    after = Window.partitionBy(*group).orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)
    taps = rows.withColumn("next_us", F.min(converted_us).over(after)).where("is_tap")
    hits = (taps.join(followers, group, "left")
            .withColumn("next_us", F.coalesce("next_us", "later_us"))
            .where(F.col("next_us") - us < window_seconds * 1_000_000))
    return hits.select(WALLET, from_micros(us).alias("tap_ts"), from_micros(F.col("next_us")).alias("trade_ts"),
                       ((F.col("next_us") - us) / 1_000_000).alias("seconds"))


def time_to_trade_stats(times: DataFrame) -> DataFrame:
    """Mean, upper median and number of converting taps of a time_to_trade frame; mean and number come from sums per second.

    The median is found by counting: first per whole second (bounded by the window length), then
    per microsecond inside the one second that holds it. No task sees all values.
    """
    second = F.floor("seconds")
    order = Window.orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    per_second = times.groupBy(second.alias("second")).agg(F.count("*").alias("n"), F.sum("seconds").alias("sum"))
    placed = per_second.select(
        "second", (F.sum("n").over(order) - F.col("n")).alias("below"), "n",
        F.floor(F.sum("n").over(Window.partitionBy()) / 2).alias("rank"))
    home = (placed.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
            .select(F.struct("second", (F.col("rank") - F.col("below")).alias("offset"))).scalar())
    fine = times.where(second == home["second"]).groupBy("seconds").agg(F.count("*").alias("n"))
    fine_order = Window.orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    median = (fine.withColumn("upto", F.sum("n").over(fine_order)).where(F.col("upto") > home["offset"])
              .agg(F.min("seconds").alias("median")))
    return (per_second.agg((F.sum("sum") / F.sum("n")).alias("avg_seconds"), F.coalesce(F.sum("n"), F.lit(0)).alias("conversions"))
            .select("avg_seconds", median.scalar().alias("median_seconds"), "conversions"))


def time_to_trade_histogram(times: DataFrame, *, bins: int = 20) -> DataFrame:
    return equal_width_bins(times, "seconds", bins)


def top_tapped_tickers(ev: DataFrame, *, k: int = 10) -> DataFrame:
    taps = ev.where(F.col("event") == NOTIFICATION_TAP)
    named = taps.where(metadata.truthy(taps, "ticker"))
    counts = named.groupBy(metadata.text(named, "ticker").alias("ticker")).agg(F.count("*").alias("taps"))
    return top(counts, k, "taps", "ticker")


def top_tappers(ev: DataFrame, people: DataFrame, *, k: int = 10) -> DataFrame:
    taps = ev.where((F.col("event") == NOTIFICATION_TAP) & F.col(WALLET).isNotNull())
    best = top(taps.groupBy(WALLET).agg(F.count("*").alias("taps")), k, "taps", WALLET)
    return enrich_top(best, people).orderBy(F.desc("taps"), WALLET)
