"""Registered queries that read stored rollups and user bitmaps instead of points and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import audience as A
from ..operators import bitmaps as B
from ..operators import funnels as U
from ..operators import health as H
from ..operators import identity_store as S
from ..operators import logs as L
from ..operators import notifications as M
from ..operators import trades as T
from ..operators.normalize import normalize_events, normalize_trades, real_users
from ..session import work_dir
from ..sources import metric_series, metric_series_by_service, newest_rows, read_rollup, write_rollup, write_shredded_events
from .audience_queries import QUERIES as AUDIENCE
from .audience_queries import TODAY
from .base import Inputs, Query, day, moment
from .operations_queries import BACKEND, VALUE, _bucket, _series
from .operations_queries import QUERIES as OPERATIONS
from .trading_queries import QUERIES as TRADING


def _table(x: Inputs, name: str, write: Callable[[str], None]) -> str:
    """Path of a stored table, written once per session and input folder."""
    done = x.spark.__dict__.setdefault("_stored_tables", {})
    if (name, x.sf_dir) not in done:
        path = work_dir(x.spark, name)
        write(path)
        done[name, x.sf_dir] = path
    return done[name, x.sf_dir]


def _rollup(x: Inputs, period: int):
    return read_rollup(x.spark, _table(x, "rollup", lambda path: write_rollup(x.points, path)), period)


def _bitmaps(x: Inputs):
    return B.read_user_bitmaps(x.spark, _table(x, "user-bitmaps", lambda path: B.write_user_bitmaps(x.ev, path)))


def _cohorts(x: Inputs):
    return B.read_user_bitmaps(x.spark, _table(x, "cohort-bitmaps", lambda path: B.write_user_bitmaps(x.cohort_ev, path, events=[])))


def _numbers(x: Inputs):
    path = _table(x, "user-bitmaps", lambda path: B.write_user_bitmaps(x.ev, path))
    return B.user_numbers(x.spark, path).agg(F.count_distinct("wallet_address").alias("users"), F.count_distinct("user_no").alias("numbers"),
                                             F.min("user_no").alias("first"), F.max("user_no").alias("last"))


def _owners(x: Inputs):
    def write(path: str) -> None:
        part = F.pmod("ingest_order", F.lit(3))            # three deliveries, the middle one twice
        for n in (2, 0, 1, 0):
            S.fold_owners(x.users.where(part == n), path)

    return S.current_owners(x.spark, _table(x, "owners", write))


def _bucketed(x: Inputs):
    def write(path: str) -> None:
        names = [f"{kind}_{path.rsplit('-', 1)[-1]}" for kind in ("facts", "people")]
        S.write_bucketed(x.ev.select("session_id", "wallet_address"), x.identity, tuple(names), path)

    path = _table(x, "bucketed", write)
    return S.enrich_bucketed(x.spark, tuple(f"{kind}_{path.rsplit('-', 1)[-1]}" for kind in ("facts", "people")))


def _by_day(x: Inputs, name: str, rows: Callable, column: str):
    return x.spark.read.parquet(_table(x, f"{name}-by-day", lambda path: rows().repartition(column).write.partitionBy(column).parquet(path)))


def _shredded(x: Inputs):
    path = _table(x, "shredded", lambda path: write_shredded_events(x.events, path))
    return real_users(normalize_events(x.spark.read.parquet(path)))


def _newest_trades(x: Inputs, kind: str, k: int = 50):
    trades = _by_day(x, "trades", lambda: x.trades, "trade_date")
    return normalize_trades(newest_rows(trades, k, "trade_date", F.col("type") == kind))


def _newest_errors(x: Inputs, k: int = 30):
    logs = _by_day(x, "logs", lambda: x.logs.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")
    return newest_rows(logs, k, "day", L.priority(F.col("message")) <= C.ERROR_PRIORITY, "ts")


def _as(name: str, build: Callable) -> Query:
    """A second way to a registered result, with its SQL twin."""
    known = {**AUDIENCE, **TRADING, **OPERATIONS}[name]
    return Query(build, known.sql, known.digits)


def _from_rollup(name: str, build: Callable) -> Query:
    """A metric result from the states of 300 seconds; its SQL twin reads the points."""
    known = OPERATIONS[name]
    return Query(lambda x: build(_rollup(x, 300)), known.sql, known.digits)


_WHOLE = dict(period=300, hours=None)


def _per(unit: str) -> str:
    return f"SELECT {day('b')} AS start, users FROM (SELECT date_trunc('{unit}', date) AS b, count(DISTINCT wallet_address) AS users FROM ev GROUP BY 1)"


QUERIES: dict[str, Query] = {
    # --- rollup table ---
    "rollup_states": Query(
        lambda x: _rollup(x, 3600).select("metric_name", F.coalesce(F.size("dims"), F.lit(0)).alias("dimensions"), "ts", "sum", "count", "min", "max"),
        f"""SELECT metric_name, dimensions, {moment('b')} AS ts, sum, count, min, max FROM (
            SELECT metric_name, environment, venue, service, distribution, region, {_bucket(3600)} AS b, sum(value) AS sum, count(value) AS count,
                min(value) AS min, max(value) AS max, CAST(CAST(environment IS NOT NULL AS INT) + CAST(venue IS NOT NULL AS INT)
                + CAST(service IS NOT NULL AS INT) + CAST(distribution IS NOT NULL AS INT) + CAST(region IS NOT NULL AS INT) AS BIGINT) AS dimensions
            FROM points GROUP BY ALL)""", {"sum": 4}),
    "rollup_metric_series": _from_rollup("metric_series", lambda p: metric_series(p, C.METRIC_API_LATENCY, "Average", dims=BACKEND, **_WHOLE)),
    "rollup_metric_series_sum": Query(
        lambda x: metric_series(_rollup(x, 86400), C.METRIC_API_REQUEST, "Sum", dims=BACKEND, period=86400, hours=None),
        OPERATIONS["metric_series_sum"].sql, {"value": 2}),
    "rollup_metric_series_max": Query(
        lambda x: metric_series(_rollup(x, 900), C.METRIC_WS_CONNECTIONS, "Maximum", dims=BACKEND, period=900, hours=None),
        OPERATIONS["metric_series_max"].sql, OPERATIONS["metric_series_max"].digits),
    "rollup_series_by_service": Query(
        lambda x: metric_series_by_service(_rollup(x, 3600), C.METRIC_MEMORY, "Average", period=3600, hours=None),
        _series(C.METRIC_MEMORY, "avg", "service IS NOT NULL", 3600, keys="service"), VALUE),
    "rollup_api_health": _from_rollup("api_health", lambda p: H.api_health(p, **_WHOLE)),
    "rollup_venue_health": _from_rollup("venue_health", lambda p: H.venue_health(p, **_WHOLE)),
    "rollup_service_health": _from_rollup("service_health", lambda p: H.service_health(p, **_WHOLE)),
    "rollup_service_series": _from_rollup("service_series", lambda p: H.service_series(p, **_WHOLE)),
    "rollup_cdn_health": _from_rollup("cdn_health", lambda p: H.cdn_health(p, **_WHOLE)),
    # --- user bitmaps ---
    "bitmap_user_numbers": Query(
        _numbers, "SELECT count(DISTINCT wallet_address) AS users, count(DISTINCT wallet_address) AS numbers, CAST(0 AS BIGINT) AS first, "
                  "count(DISTINCT wallet_address) - 1 AS last FROM ev"),
    "bitmap_dau": Query(lambda x: B.bitmap_dau(_bitmaps(x)), AUDIENCE["dau"].sql),
    "bitmap_wau_mau": Query(lambda x: B.bitmap_wau_mau(_bitmaps(x), TODAY), AUDIENCE["wau_mau"].sql),
    "bitmap_weekly_users": Query(lambda x: B.bitmap_users_per(_bitmaps(x), "week"), _per("week")),
    "bitmap_monthly_users": Query(lambda x: B.bitmap_users_per(_bitmaps(x), "month"), _per("month")),
    "bitmap_cohort_retention": Query(lambda x: B.bitmap_retention(_cohorts(x)), TRADING["cohort_retention"].sql, TRADING["cohort_retention"].digits),
    "bitmap_funnel_trade": Query(lambda x: B.bitmap_funnel(_bitmaps(x), C.FUNNEL_TRADE), TRADING["funnel_trade"].sql, TRADING["funnel_trade"].digits),
    "bitmap_funnel_notification_trade": Query(
        lambda x: B.bitmap_funnel(_bitmaps(x), C.FUNNEL_NOTIFICATION_TRADE), TRADING["funnel_notification_trade"].sql,
        TRADING["funnel_notification_trade"].digits),
    # --- stored identities ---
    "owners_folded": _as("wallet_identity", _owners),
    "enrich_identity_bucketed": _as("enrich_identity", _bucketed),
    # --- newest folders first ---
    "newest_swaps": _as("recent_swaps", lambda x: T.recent_swaps(_newest_trades(x, C.SWAP), x.users)),
    "newest_perps": _as("recent_perps", lambda x: T.recent_perps(_newest_trades(x, C.PERPS), x.users)),
    "newest_deposits": _as("recent_deposits", lambda x: T.recent_deposits(_newest_trades(x, C.DEPOSIT), x.users)),
    "newest_errors": _as("recent_errors", lambda x: L.recent_errors(_newest_errors(x))),
    # --- shredded metadata ---
    "shredded_session_durations": _as("session_durations", lambda x: A.session_durations(_shredded(x))),
    "shredded_deposits_by_provider": _as("deposits_by_provider", lambda x: U.deposits_by_provider(_shredded(x))),
    "shredded_top_tapped_tickers": _as("top_tapped_tickers", lambda x: M.top_tapped_tickers(_shredded(x))),
}
