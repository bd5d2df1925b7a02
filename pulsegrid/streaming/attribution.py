"""Time to trade as trades arrive: taps and conversions as two streams, joined within a range of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NOTIFICATION_TAP, TRADE_INITIATED
from ..functions.timestamps import instant_to_utc
from .rollups import WALLET, instant


def stream_time_to_trade(events: DataFrame, *, tap: str = NOTIFICATION_TAP, conversion: str = TRADE_INITIATED, window_seconds: int = 3600,
                         delay: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """The streaming twin of `notifications.time_to_trade`: per tap the first conversion after it and within the window.

    Both sides wait in the state for no longer than the window and the watermark's `delay`. Rows meet by wallet and by slice of
    time, each as long as the window: a tap looks into its own slice and the next. So a wallet with very many rows is
    spread over as many groups as it has slices. `key` tells taps apart; a tap whose conversions are all late has no row.
    """
    seen = events.where(F.col("ts").isNotNull() & F.col(WALLET).isNotNull())
    at = lambda event, name: seen.where(F.col("event") == event).withColumn(name, instant(events)).withWatermark(name, delay)
    slot = lambda name: F.floor(F.unix_micros(F.col(name)) / (window_seconds * 1_000_000))
    taps = at(tap, "tap_at").select(WALLET, F.col(key).alias("tap"), "tap_at", F.explode(F.array(slot("tap_at"), slot("tap_at") + 1)).alias("slice"))
    trades = at(conversion, "trade_at").select(F.col(WALLET).alias("trader"), "trade_at", slot("trade_at").alias("traded"))
    near = (F.col("trade_at") > F.col("tap_at")) & (F.col("trade_at") < F.col("tap_at") + F.make_dt_interval(secs=F.lit(window_seconds)))
    pairs = taps.join(trades, (F.col(WALLET) == F.col("trader")) & (F.col("slice") == F.col("traded")) & near)
    first = pairs.groupBy(WALLET, "tap", "tap_at").agg(F.min("trade_at").alias("trade_at"))
    return first.select(WALLET, instant_to_utc(F.col("tap_at")).alias("tap_ts"), instant_to_utc(F.col("trade_at")).alias("trade_ts"),
                        ((F.unix_micros("trade_at") - F.unix_micros("tap_at")) / 1_000_000).alias("seconds"))


def with_open_taps(closed: DataFrame, rows: DataFrame, batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Settled taps of a stream, and those still open from a batch over the newest rows.

    Taps leave the stream in order of time, so all up to the last one are settled, and `batch` reads only rows (by `ts`) after it.
    """
    end = closed.agg(F.max("tap_ts").alias("end")).first()["end"]
    fresh = rows if end is None else rows.where(F.col("ts") > F.lit(end).cast("timestamp_ntz"))
    return closed.unionByName(batch(fresh).select(*closed.columns))
