"""From stored events and trades to the frames all analyses start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..constants import DEFAULT_TZ, NOTIONAL_VENUE, PERPS, SERVER_PLATFORM, SYSTEM_WALLETS
from ..functions.numbers import number
from ..functions.timestamps import to_local, to_utc


def normalize_events(df: DataFrame, *, tz: str = DEFAULT_TZ) -> DataFrame:
    """Adds `ts` (UTC), `ts_local`, `date`, `hour` and `day_of_week` (0 = Sunday), local.

    Unreadable timestamps give nulls. Only where the input has no `timestamp` column at all, the
    stored date, hour and weekday are used.
    """
    timed = "timestamp" in df.columns
    df = schemas.conform(df, schemas.EVENTS)
    if not timed:
        null_ts = F.lit(None).cast("timestamp_ntz")
        return df.withColumns({
            "ts": null_ts,
            "ts_local": null_ts,
            "date": F.col("date").try_cast("date"),
            "hour": number(F.col("hour")).cast("int"),
            "day_of_week": number(F.col("day_of_week")).cast("int"),
        })
    df = df.withColumn("ts", to_utc(df, "timestamp")).withColumn("ts_local", to_local(F.col("ts"), tz))
    local = F.col("ts_local")
    return df.withColumns({
        "date": F.to_date(local),
        "hour": F.hour(local),
        "day_of_week": F.dayofweek(local) - 1,
    })


def is_real_user() -> Column:
    """Not a system wallet and not a server-side event; unknown wallets and platforms pass."""
    wallet, platform = F.col("wallet_address"), F.col("platform")
    return ((wallet.isNull() | ~wallet.isin(SYSTEM_WALLETS))
            & (platform.isNull() | (platform != SERVER_PLATFORM)))


def real_users(df: DataFrame) -> DataFrame:
    return df.where(is_real_user())


def perps_notional(df: DataFrame, *, missing_is_close: bool = True,
                   has_is_close: bool | None = None) -> DataFrame:
    """Position notional of perps in `amount_usd`, and `_volume_usd` (closes count twice).

    Opens are worth collateral x leverage, closes |size| x price. At the venue that reports
    notional itself, opens keep their amount and closes are worth |size|. `missing_is_close`
    says what a null `is_close` means. `has_is_close=False` makes every order an open, which is
    also the rule where the input has no such column.
    """
    have = set(df.columns)
    if not {"type", "amount_usd"} <= have:
        return df
    close_known = "is_close" in have if has_is_close is None else has_is_close
    df = schemas.conform(df, schemas.TRADES)
    reports_notional = " OR ".join(f"lower({name}) <=> '{NOTIONAL_VENUE}'" for name in ("category", "source", "venue"))
    amount = opened = closed = "try_cast(amount_usd AS double)"
    leverage, size, price = (f"try_cast({name} AS double)" for name in ("leverage", "size", "price"))
    if "leverage" in have:
        leverage = f"coalesce({leverage}, 1D)"
        opened = f"CASE WHEN {reports_notional} THEN {amount} ELSE {amount} * {leverage} END"
    if {"size", "price"} <= have:
        size, price = f"coalesce({size}, 0D)", f"coalesce({price}, 0D)"
        closed = f"abs({size}) * CASE WHEN {reports_notional} THEN 1D ELSE {price} END"
    perps, closing = f"type = '{PERPS}'", f"coalesce(try_cast(is_close AS boolean), {str(missing_is_close).lower()})"
    close = f"{perps} AND {closing}" if close_known else "false"
    # Volume is worth times 1 or 2, so that the nested conditions are evaluated once for both.
    return (df.withColumns({
        "amount_usd": F.expr(f"CASE WHEN {close} THEN {closed} WHEN {perps} THEN {opened} ELSE {amount} END"),
        "_factor": F.expr(f"CASE WHEN {close} THEN 2D ELSE 1D END"),
        "leverage": F.expr(leverage), "size": F.expr(size), "price": F.expr(price)})
        .withColumn("_volume_usd", F.expr("amount_usd * _factor")).drop("_factor"))


def normalize_trades(df: DataFrame, *, tz: str = DEFAULT_TZ, missing_is_close: bool = True,
                     has_is_close: bool | None = None) -> DataFrame:
    """Adds `ts` (UTC), `ts_local`, local `trade_date`, `hour` and `dow` (0 = Monday), and volumes."""
    timed = "timestamp" in df.columns
    if "amount_usd" not in df.columns:
        df = df.withColumn("amount_usd", F.lit(None).cast("double"))
    df = perps_notional(df, missing_is_close=missing_is_close, has_is_close=has_is_close)
    df = schemas.conform(df, schemas.TRADES)
    if "_volume_usd" not in df.columns:
        df = df.withColumn("amount_usd", number(F.col("amount_usd")))
        df = df.withColumn("_volume_usd", F.col("amount_usd"))
    if not timed:
        null_ts = F.lit(None).cast("timestamp_ntz")
        null_int = F.lit(None).cast("int")
        return df.withColumns({"ts": null_ts, "ts_local": null_ts, "hour": null_int, "dow": null_int,
                               "trade_date": F.col("trade_date").try_cast("date")})
    df = df.withColumn("ts", to_utc(df, "timestamp")).withColumn("ts_local", to_local(F.col("ts"), tz))
    local = F.col("ts_local")
    return df.withColumns({"trade_date": F.to_date(local), "hour": F.hour(local), "dow": F.weekday(local)})
