"""Trades by app platform. A wallet seen on both apps counts in both.

Trades are summed per wallet (map-side first) before they meet the platform list, so a wallet
with very many trades is one row in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import APP_PLATFORMS
from ..functions.frames import fill_spine, fixed_list, top_per
from ..functions.numbers import half_even, ratio, total
from .audience import app_events
from .trades import VOLUME, WALLET, perps, swaps_and_perps


def platform_wallets(ev: DataFrame) -> DataFrame:
    """Distinct (wallet, platform): at most two rows per wallet."""
    return app_events(ev).where(F.col(WALLET).isNotNull()).select(WALLET, "platform").distinct()


def _spine(ev: DataFrame) -> DataFrame:
    return fixed_list(ev.sparkSession, "platform", APP_PLATFORMS).drop("step")


def platform_trades(tr: DataFrame, ev: DataFrame) -> DataFrame:
    """Swaps and perps of wallets seen on an app, once per app they were seen on."""
    trades = swaps_and_perps(tr)
    if "platform" in trades.columns:
        trades = trades.drop("platform")
    return trades.join(platform_wallets(ev), WALLET)


def platform_trade_kpis(tr: DataFrame, ev: DataFrame) -> DataFrame:
    per_wallet = (swaps_and_perps(tr).groupBy(WALLET)
                  .agg(total(F.col(VOLUME)).alias("volume"), F.count("*").alias("trades")))
    sums = (per_wallet.join(platform_wallets(ev), WALLET).groupBy("platform")
            .agg(F.sum("volume").alias("volume"), F.sum("trades").alias("trades")))
    return fill_spine(_spine(ev), sums, "platform", volume=0.0, trades=0).orderBy("platform")


def platform_perps_kpis(tr: DataFrame, ev: DataFrame) -> DataFrame:
    """Volume, orders, traders, mean order and mean leverage per app."""
    per_wallet = (perps(tr).groupBy(WALLET)
                  .agg(total(F.col(VOLUME)).alias("volume"), F.count("*").alias("orders"),
                       F.sum("leverage").alias("lev_sum"), F.count("leverage").alias("lev_n")))
    sums = (per_wallet.join(platform_wallets(ev), WALLET).groupBy("platform")
            .agg(F.sum("volume").alias("volume"), F.sum("orders").alias("orders"), F.count("*").alias("traders"),
                 F.try_divide(F.sum("lev_sum"), F.sum("lev_n")).alias("avg_leverage")))
    filled = fill_spine(_spine(ev), sums, "platform", volume=0.0, orders=0, traders=0)
    return (filled.withColumn("avg_order", ratio(F.col("volume"), F.col("orders")))
            .select("platform", "volume", "orders", "traders", "avg_order", "avg_leverage").orderBy("platform"))


def platform_perps_sides(tr: DataFrame, ev: DataFrame) -> DataFrame:
    per_wallet = (perps(tr).where(F.col("side").isNotNull()).groupBy(WALLET, "side")
                  .agg(F.count("*").alias("count")))
    return (per_wallet.join(platform_wallets(ev), WALLET).groupBy("platform", "side")
            .agg(F.sum("count").alias("count")).orderBy("platform", "side"))


def platform_top_assets(tr: DataFrame, ev: DataFrame, *, k: int = 10, digits: int | None = 0) -> DataFrame:
    per_wallet = (perps(tr).where(F.col("asset").isNotNull()).groupBy(WALLET, "asset")
                  .agg(total(F.col(VOLUME)).alias("volume")))
    sums = (per_wallet.join(platform_wallets(ev), WALLET).groupBy("platform", "asset")
            .agg(F.sum("volume").alias("volume")))
    return (top_per(sums, "platform", k, "volume", "asset").orderBy("platform", F.desc("volume"), "asset")
            .withColumn("volume", half_even(F.col("volume"), digits)))
