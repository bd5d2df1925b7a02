"""Trading results. `tr` is normalize_trades(...). Sums are sums of doubles, as amounts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_TZ, DEPOSIT, DOW_MONDAY_FIRST, PERPS, SWAP
from ..functions.frames import equal_width_bins, fill_spine, fixed_list, top, whole_range
from ..functions.numbers import half_even, percent, ratio, total
from ..functions.wallets import short_wallet
from .audience import day_name
from .identity import enrich_top

WALLET = "wallet_address"
VOLUME = "_volume_usd"


def swaps(tr: DataFrame) -> DataFrame:
    return tr.where(F.col("type") == SWAP)


def perps(tr: DataFrame) -> DataFrame:
    return tr.where(F.col("type") == PERPS)


def deposits(tr: DataFrame) -> DataFrame:
    return tr.where(F.col("type") == DEPOSIT)


def swaps_and_perps(tr: DataFrame) -> DataFrame:
    return tr.where(F.col("type").isin(SWAP, PERPS))


def not_deposits(tr: DataFrame) -> DataFrame:
    """Everything but deposits; trades of unknown type stay."""
    return tr.where(F.col("type").isNull() | (F.col("type") != DEPOSIT))


def trading_snapshot(tr: DataFrame, ev: DataFrame) -> DataFrame:
    """Swap and perps volume, deposit volume, traders, and traders per 100 users."""
    is_trade, is_deposit = F.col("type").isin(SWAP, PERPS), F.col("type") == DEPOSIT
    facts = tr.where(is_trade | is_deposit).agg(
        total(F.when(is_trade, F.col(VOLUME))).alias("trade_volume"),
        total(F.when(is_deposit, F.col(VOLUME))).alias("deposit_volume"),
        F.count_distinct(F.when(is_trade, F.col(WALLET))).alias("active_traders"))
    users = ev.agg(F.count_distinct(WALLET).alias("n")).scalar()
    return facts.withColumn("trader_pct", percent(F.col("active_traders"), users))


def _kpis(df: DataFrame, volume: str, amount: str, rows: str, people: str, mean: str) -> DataFrame:
    return (df.agg(total(F.col(amount)).alias(volume), F.count("*").alias(rows),
                   F.count_distinct(WALLET).alias(people))
            .withColumn(mean, ratio(F.col(volume), F.col(rows))))


def trade_kpis(tr: DataFrame) -> DataFrame:
    return _kpis(swaps_and_perps(tr), "volume", VOLUME, "trades", "traders", "avg_trade")


def perps_kpis(tr: DataFrame) -> DataFrame:
    return _kpis(perps(tr), "volume", VOLUME, "orders", "traders", "avg_order")


def deposit_kpis(tr: DataFrame) -> DataFrame:
    return _kpis(deposits(tr), "volume", "amount_usd", "deposits", "depositors", "avg_deposit")


def trade_type_breakdown(tr: DataFrame) -> DataFrame:
    """Volume and rows of swaps, perps and deposits."""
    types = [SWAP, PERPS, DEPOSIT]
    sums = (tr.where(F.col("type").isin(types)).groupBy("type")
            .agg(total(F.col(VOLUME)).alias("volume"), F.count("*").alias("trades")))
    spine = fixed_list(tr.sparkSession, "type", types)
    return (fill_spine(spine, sums, "type", volume=0.0, trades=0).orderBy("step")
            .select("type", "volume", "trades"))


def _daily(df: DataFrame) -> DataFrame:
    return df.where(F.col("trade_date").isNotNull()).groupBy(F.col("trade_date").alias("date"))


def daily_trades(tr: DataFrame) -> DataFrame:
    return (_daily(swaps_and_perps(tr))
            .agg(F.count("*").alias("trades"), total(F.col(VOLUME)).alias("volume")).orderBy("date"))


def daily_swap_volume(tr: DataFrame) -> DataFrame:
    return _daily(swaps(tr)).agg(total(F.col("amount_usd")).alias("volume")).orderBy("date")


def daily_perps_volume(tr: DataFrame) -> DataFrame:
    return _daily(perps(tr)).agg(total(F.col(VOLUME)).alias("volume")).orderBy("date")


def daily_deposit_volume(tr: DataFrame) -> DataFrame:
    return _daily(deposits(tr)).agg(total(F.col("amount_usd")).alias("volume")).orderBy("date")


def _top_volume(df: DataFrame, key: str, name: str, amount: str, k: int, digits: int | None) -> DataFrame:
    """The k groups with the largest sum; rounding comes after ranking."""
    sums = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(total(F.col(amount)).alias("volume"))
    return (top(sums, k, "volume", name).withColumn("_exact", F.col("volume"))
            .withColumn("volume", half_even(F.col("volume"), digits))
            .orderBy(F.desc("_exact"), name).drop("_exact"))


def _count_by(df: DataFrame, key: str, name: str, count: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.count("*").alias(count))


def swap_volume_by_token(tr: DataFrame, *, k: int = 15, digits: int | None = 0) -> DataFrame:
    return _top_volume(swaps(tr), "to_token", "token", "amount_usd", k, digits)


def swap_count_by_token(tr: DataFrame, *, k: int = 15) -> DataFrame:
    return top(_count_by(swaps(tr), "to_token", "token", "trades"), k, "trades", "token")


def swaps_by_hour(tr: DataFrame) -> DataFrame:
    counts = _count_by(swaps(tr), "hour", "hour", "trades")
    return fill_spine(whole_range(tr.sparkSession, "hour", 24), counts, "hour", trades=0).orderBy("hour")


def swaps_by_dow(tr: DataFrame) -> DataFrame:
    """Swaps per weekday, 0 = Monday."""
    counts = _count_by(swaps(tr), "dow", "dow", "trades")
    days = fill_spine(whole_range(tr.sparkSession, "dow", 7), counts, "dow", trades=0)
    return days.withColumn("day", day_name(F.col("dow"), DOW_MONDAY_FIRST)).orderBy("dow")


def swap_sources(tr: DataFrame) -> DataFrame:
    return _count_by(swaps(tr), "source", "source", "count").orderBy(F.desc("count"), "source")


def perps_volume_by_asset(tr: DataFrame, *, k: int = 15, digits: int | None = 0) -> DataFrame:
    return _top_volume(perps(tr), "asset", "asset", VOLUME, k, digits)


def perps_orders_by_asset(tr: DataFrame, *, k: int = 15) -> DataFrame:
    return top(_count_by(perps(tr), "asset", "asset", "orders"), k, "orders", "asset")


def perps_sides(tr: DataFrame) -> DataFrame:
    """Orders per side, upper and lower case kept apart as stored."""
    return _count_by(perps(tr), "side", "side", "count").orderBy(F.desc("count"), "side")


def leverage_histogram(tr: DataFrame, *, bins: int = 20) -> DataFrame:
    return equal_width_bins(perps(tr), "leverage", bins)


def perps_open_close(tr: DataFrame, *, missing_is_close: bool = True) -> DataFrame:
    """Volume and rows of opens and closes."""
    closing = F.coalesce(F.col("is_close").try_cast("boolean"), F.lit(missing_is_close))
    return (perps(tr).groupBy(F.when(closing, "Close").otherwise("Open").alias("type"))
            .agg(total(F.col(VOLUME)).alias("volume"), F.count("*").alias("count")).orderBy("type"))


def deposits_by_source(tr: DataFrame) -> DataFrame:
    return _count_by(deposits(tr), "source", "provider", "count").orderBy(F.desc("count"), "provider")


# --- leaderboards and lists -----------------------------------------------------

def top_traders_by_volume(tr: DataFrame, people: DataFrame, *, k: int = 15,
                          digits: int | None = 0) -> DataFrame:
    per_wallet = (not_deposits(tr).where(F.col(WALLET).isNotNull()).groupBy(WALLET)
                  .agg(total(F.col(VOLUME)).alias("_exact"), F.count(VOLUME).alias("trades")))
    best = enrich_top(top(per_wallet, k, "_exact", WALLET), people)
    return (best.withColumn("volume", half_even(F.col("_exact"), digits))
            .orderBy(F.desc("_exact"), WALLET)
            .select(WALLET, "volume", "trades", "user_label", "user_contact", "login_type"))


def top_traders_by_count(tr: DataFrame, people: DataFrame, *, k: int = 15) -> DataFrame:
    counts = _count_by(not_deposits(tr), WALLET, WALLET, "trades")
    return enrich_top(top(counts, k, "trades", WALLET), people).orderBy(F.desc("trades"), WALLET)


def local_time_text(col: str = "ts_local") -> Column:
    """Short text of a wall clock, e.g. "Mar 10, 02:30 AM", from its fields: no session zone can shift it."""
    hour = F.hour(col)
    clock = F.lpad(F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string"), 2, "0")
    minute = F.lpad(F.minute(col).cast("string"), 2, "0")
    half = F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM"))
    return F.concat(F.date_format(F.to_date(col), "MMM dd"), F.lit(", "), clock, F.lit(":"), minute, half)


def user_trade_totals(tr: DataFrame, wallet: str) -> DataFrame:
    return tr.where(F.col(WALLET) == wallet).agg(F.count("*").alias("trades"), total(F.col(VOLUME)).alias("volume"))


def user_trades(tr: DataFrame, wallet: str) -> DataFrame:
    """All trades of one user, newest first, with local time as text."""
    columns = ["from_token", "to_token", "amount_usd", "status", "source"]
    return (tr.where(F.col(WALLET) == wallet).orderBy(F.desc_nulls_last("ts"), *columns)
            .select(local_time_text().alias("time"), *columns))


def _recent(df: DataFrame, people: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k latest rows with identity. Ties at the cut are settled by the shown columns."""
    order = [F.desc_nulls_last("ts"), F.asc_nulls_last(WALLET), *[F.asc_nulls_last(c) for c in columns]]
    latest = df.select("ts", "ts_local", WALLET, *columns).orderBy(*order).limit(k)
    return (enrich_top(latest, people).orderBy(*order)
            .select(local_time_text().alias("time"), "user_label", "login_type",
                    short_wallet(F.col(WALLET)).alias("wallet"), *columns))


def recent_swaps(tr: DataFrame, people: DataFrame, *, k: int = 50) -> DataFrame:
    return _recent(swaps(tr), people, ["from_token", "to_token", "amount_usd", "status", "source"], k)


def recent_perps(tr: DataFrame, people: DataFrame, *, k: int = 50) -> DataFrame:
    return _recent(perps(tr), people, ["asset", "side", "size", "price", "leverage", "amount_usd",
                                         "order_type", "is_close"], k)


def recent_deposits(tr: DataFrame, people: DataFrame, *, k: int = 50) -> DataFrame:
    return _recent(deposits(tr), people, ["amount_usd", "source"], k)
