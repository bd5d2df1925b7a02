"""Registered queries: retention, funnels, trades, platforms, notifications."""

from __future__ import annotations

from ..operators import funnels as U
from ..operators import notifications as M
from ..operators import platforms as P
from ..operators import retention as R
from ..operators import trades as T
from .base import Inputs, Query, day, enriched, moment, short

WALLET = "0xAB00000001"
HALF_DAY = 12 * 3600
DAYS = [0, 1, 3, 7, 14, 30]
MONEY = {"volume": 2}

_COHORTS = ("SELECT c.cohort, count(DISTINCT c.wallet_address) AS users, "
            + ", ".join(f"count(DISTINCT CASE WHEN e.date = c.cohort + {d} THEN c.wallet_address END) "
                        f"/ count(DISTINCT c.wallet_address) * 100 AS D{d}" for d in DAYS)
            + " FROM (SELECT wallet_address, min(date) AS cohort FROM cohort_ev GROUP BY 1) c"
              " JOIN cohort_ev e ON e.wallet_address = c.wallet_address GROUP BY c.cohort")


def _funnel_sql(steps: list[tuple[str, str]]) -> str:
    spine = " UNION ALL ".join(f"SELECT {i} AS step, '{label}' AS label, '{event}' AS event"
                               for i, (label, event) in enumerate(steps, 1))
    return f"""SELECT step, label, event, users, users / nullif(lag(users) OVER (ORDER BY step), 0) * 100 AS pct_of_previous FROM (
        SELECT s.step, s.label, s.event, count(DISTINCT e.wallet_address) AS users
        FROM ({spine}) s LEFT JOIN ev e ON e.event = s.event GROUP BY ALL)"""


_TTT = f"""SELECT t.wallet_address, t.ts AS tap_ts, min(c.ts) AS trade_ts, date_diff('microsecond', t.ts, min(c.ts)) / 1000000 AS seconds
    FROM ev t JOIN ev c ON c.wallet_address = t.wallet_address AND c.ts > t.ts AND c.ts < t.ts + INTERVAL '{HALF_DAY} seconds'
    WHERE t.event = 'notification_tap' AND c.event = 'trade_initiated' GROUP BY t.event_id, t.wallet_address, t.ts"""


def _times(x: Inputs):
    return M.time_to_trade(x.ev, window_seconds=HALF_DAY)


def _histogram_sql(source: str, value: str) -> str:
    return f"""SELECT bin, lo + (bin - 1) * (hi - lo) / 20 AS bin_start, lo + bin * (hi - lo) / 20 AS bin_end, count(*) AS count FROM (
        SELECT lo, hi, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / ((hi - lo) / 20)) AS BIGINT) + 1, 20) ELSE 1 END AS bin FROM (
        SELECT {value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi FROM ({source}) WHERE {value} IS NOT NULL))
        GROUP BY bin, lo, hi"""


def _kpis(where: str, amount: str, rows: str, people: str, mean: str) -> str:
    return f"""SELECT coalesce(sum({amount}), 0) AS volume, count(*) AS {rows}, count(DISTINCT wallet_address) AS {people},
        coalesce(sum({amount}) / nullif(count(*), 0), 0) AS {mean} FROM tr WHERE {where}"""


def _daily(where: str, columns: str) -> str:
    return f"SELECT {day('trade_date')} AS date, {columns} FROM tr WHERE {where} GROUP BY trade_date"


def _top(where: str, key: str, name: str, value: str, out: str, k: int | None) -> str:
    limit = f" ORDER BY 2 DESC, 1 LIMIT {k}" if k else ""
    return f"SELECT {key} AS {name}, {value} AS {out} FROM tr WHERE {where} AND {key} IS NOT NULL GROUP BY {key}{limit}"


_TRADE = "type IN ('swap', 'perps')"
_SWAP, _PERPS, _DEPOSIT = "type = 'swap'", "type = 'perps'", "type = 'deposit'"
_APPS = "(SELECT DISTINCT wallet_address, lower(platform) AS platform FROM ev WHERE lower(platform) IN ('ios', 'android'))"


def _by_app(where: str) -> str:
    return f"{_APPS} a JOIN tr t ON t.wallet_address = a.wallet_address WHERE {where}"


def _recent(where: str, columns: list[str], k: int = 50) -> str:
    order = ", ".join(["ts DESC NULLS LAST", "wallet_address", *columns])
    names = ", ".join(columns)
    inner = enriched(f"SELECT ts_local, wallet_address, {names} FROM tr WHERE {where} ORDER BY {order} LIMIT {k}")
    return (f"SELECT strftime(ts_local, '%b %d, %I:%M %p') AS time, user_label, login_type, "
            f"{short('wallet_address')} AS wallet, {names} FROM ({inner})")


_SWAP_COLUMNS = ["from_token", "to_token", "amount_usd", "status", "source"]
_PERPS_COLUMNS = ["asset", "side", "size", "price", "leverage", "amount_usd", "order_type", "is_close"]

QUERIES: dict[str, Query] = {
    # --- retention ---
    "cohort_retention": Query(lambda x: R.cohort_retention(x.cohort_ev),
                              f"SELECT * REPLACE ({day('cohort')} AS cohort) FROM ({_COHORTS})", {f"D{d}": 6 for d in DAYS}),
    "retention_curve": Query(
        lambda x: R.retention_curve(x.cohort_ev),
        f"SELECT CAST(replace(d, 'D', '') AS BIGINT) AS day, r AS retention_pct FROM (UNPIVOT (SELECT "
        + ", ".join(f"avg(D{d}) AS D{d}" for d in DAYS) + f" FROM ({_COHORTS})) ON * INTO NAME d VALUE r)",
        {"retention_pct": 6}),
    "retention_matrix": Query(
        lambda x: R.retention_matrix(x.cohort_ev),
        f"SELECT * EXCLUDE (users) REPLACE ({day('cohort')} AS cohort) FROM ({_COHORTS}) "
        f"WHERE (SELECT count(DISTINCT date) FROM cohort_ev) > 1", {f"D{d}": 6 for d in DAYS}),
    # --- funnels ---
    "funnel_notification_trade": Query(lambda x: U.funnel_notification_trade(x.ev),
                                       _funnel_sql(U.FUNNEL_NOTIFICATION_TRADE), {"pct_of_previous": 6}),
    "funnel_trade": Query(lambda x: U.funnel_trade(x.ev), _funnel_sql(U.FUNNEL_TRADE), {"pct_of_previous": 6}),
    "funnel_deposit": Query(lambda x: U.funnel_deposit(x.ev), _funnel_sql(U.FUNNEL_DEPOSIT), {"pct_of_previous": 6}),
    "funnel": Query(lambda x: U.funnel(x.ev, [("Start", "session_start"), ("Detail", "token_detail_view"), ("Missing", "none_such")]),
                    _funnel_sql([("Start", "session_start"), ("Detail", "token_detail_view"), ("Missing", "none_such")]),
                    {"pct_of_previous": 6}),
    "deposits_by_provider": Query(
        lambda x: U.deposits_by_provider(x.ev),
        """SELECT m_provider AS provider, event, count(*) AS count FROM ev
            WHERE event IN ('deposit_initiated', 'deposit_success', 'deposit_error') AND m_provider <> '' GROUP BY 1, 2"""),
    "feature_engagement": Query(
        lambda x: U.feature_engagement(x.ev),
        "SELECT event, count(*) AS total, count(DISTINCT wallet_address) AS users FROM ev WHERE event IN ("
        + ", ".join(f"'{e}'" for e in U.ENGAGEMENT_EVENTS) + ") GROUP BY 1"),
    # --- trades ---
    "trading_snapshot": Query(
        lambda x: T.trading_snapshot(x.tr, x.ev),
        f"""SELECT sum(CASE WHEN {_TRADE} THEN vol END) AS trade_volume, sum(CASE WHEN {_DEPOSIT} THEN vol END) AS deposit_volume,
            count(DISTINCT CASE WHEN {_TRADE} THEN wallet_address END) AS active_traders,
            count(DISTINCT CASE WHEN {_TRADE} THEN wallet_address END) / (SELECT count(DISTINCT wallet_address) FROM ev) * 100
            AS trader_pct FROM tr""", {"trade_volume": 2, "deposit_volume": 2, "trader_pct": 6}),
    "trade_kpis": Query(lambda x: T.trade_kpis(x.tr), _kpis(_TRADE, "vol", "trades", "traders", "avg_trade"),
                        {"volume": 2, "avg_trade": 4}),
    "trade_type_breakdown": Query(
        lambda x: T.trade_type_breakdown(x.tr),
        "SELECT type, sum(vol) AS volume, count(*) AS trades FROM tr WHERE type IN ('swap', 'perps', 'deposit') GROUP BY 1", MONEY),
    "daily_trades": Query(lambda x: T.daily_trades(x.tr), _daily(_TRADE, "count(*) AS trades, sum(vol) AS volume"), MONEY),
    "daily_swap_volume": Query(lambda x: T.daily_swap_volume(x.tr), _daily(_SWAP, "sum(amount_usd) AS volume"), MONEY),
    "daily_perps_volume": Query(lambda x: T.daily_perps_volume(x.tr), _daily(_PERPS, "sum(vol) AS volume"), MONEY),
    "daily_deposit_volume": Query(lambda x: T.daily_deposit_volume(x.tr), _daily(_DEPOSIT, "sum(amount_usd) AS volume"), MONEY),
    "swap_volume_by_token": Query(lambda x: T.swap_volume_by_token(x.tr, digits=None),
                                  _top(_SWAP, "to_token", "token", "sum(amount_usd)", "volume", 15), MONEY),
    "swap_count_by_token": Query(lambda x: T.swap_count_by_token(x.tr), _top(_SWAP, "to_token", "token", "count(*)", "trades", 15)),
    "swaps_by_hour": Query(
        lambda x: T.swaps_by_hour(x.tr),
        f"""SELECT h AS hour, count(s.hour) AS trades FROM (SELECT unnest(range(24)) AS h)
            LEFT JOIN (SELECT hour FROM tr WHERE {_SWAP}) s ON s.hour = h GROUP BY 1"""),
    "swaps_by_dow": Query(
        lambda x: T.swaps_by_dow(x.tr),
        f"""SELECT d AS dow, count(s.dow) AS trades, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d + 1] AS day
            FROM (SELECT unnest(range(7)) AS d) LEFT JOIN (SELECT dow FROM tr WHERE {_SWAP}) s ON s.dow = d GROUP BY 1"""),
    "swap_sources": Query(lambda x: T.swap_sources(x.tr), _top(_SWAP, "source", "source", "count(*)", "count", None)),
    "perps_kpis": Query(lambda x: T.perps_kpis(x.tr), _kpis(_PERPS, "vol", "orders", "traders", "avg_order"),
                        {"volume": 2, "avg_order": 4}),
    "perps_volume_by_asset": Query(lambda x: T.perps_volume_by_asset(x.tr, digits=None),
                                   _top(_PERPS, "asset", "asset", "sum(vol)", "volume", 15), MONEY),
    "perps_orders_by_asset": Query(lambda x: T.perps_orders_by_asset(x.tr),
                                   _top(_PERPS, "asset", "asset", "count(*)", "orders", 15)),
    "perps_sides": Query(lambda x: T.perps_sides(x.tr), _top(_PERPS, "side", "side", "count(*)", "count", None)),
    "leverage_histogram": Query(lambda x: T.leverage_histogram(x.tr),
                                _histogram_sql(f"SELECT leverage FROM tr WHERE {_PERPS}", "leverage"), {"bin_start": 6, "bin_end": 6}),
    "perps_open_close": Query(
        lambda x: T.perps_open_close(x.tr),
        f"""SELECT CASE WHEN is_close THEN 'Close' ELSE 'Open' END AS type, sum(vol) AS volume, count(*) AS count
            FROM tr WHERE {_PERPS} GROUP BY 1""", MONEY),
    "deposit_kpis": Query(lambda x: T.deposit_kpis(x.tr), _kpis(_DEPOSIT, "amount_usd", "deposits", "depositors", "avg_deposit"),
                          {"volume": 2, "avg_deposit": 4}),
    "deposits_by_source": Query(lambda x: T.deposits_by_source(x.tr), _top(_DEPOSIT, "source", "provider", "count(*)", "count", None)),
    "top_traders_by_volume": Query(
        lambda x: T.top_traders_by_volume(x.tr, x.users, digits=None),
        enriched("""SELECT wallet_address, sum(vol) AS volume, count(vol) AS trades FROM tr WHERE type <> 'deposit'
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""), MONEY),
    "top_traders_by_count": Query(
        lambda x: T.top_traders_by_count(x.tr, x.users),
        enriched("""SELECT wallet_address, count(*) AS trades FROM tr WHERE type <> 'deposit'
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")),
    "user_trade_totals": Query(
        lambda x: T.user_trade_totals(x.tr, WALLET),
        f"SELECT count(*) AS trades, coalesce(sum(vol), 0) AS volume FROM tr WHERE wallet_address = '{WALLET}'", MONEY),
    "user_trades": Query(
        lambda x: T.user_trades(x.tr, WALLET),
        f"""SELECT strftime(ts_local, '%b %d, %I:%M %p') AS time, from_token, to_token, amount_usd, status, source
            FROM tr WHERE wallet_address = '{WALLET}'""", {"amount_usd": 2}),
    "recent_swaps": Query(lambda x: T.recent_swaps(x.tr, x.users), _recent(_SWAP, _SWAP_COLUMNS), {"amount_usd": 2}),
    "recent_perps": Query(lambda x: T.recent_perps(x.tr, x.users), _recent(_PERPS, _PERPS_COLUMNS), {"amount_usd": 2}),
    "recent_deposits": Query(lambda x: T.recent_deposits(x.tr, x.users), _recent(_DEPOSIT, ["amount_usd", "source"]),
                             {"amount_usd": 2}),
    # --- trades by app platform ---
    "platform_wallets": Query(lambda x: P.platform_wallets(x.ev), f"SELECT * FROM {_APPS}"),
    "platform_trades": Query(
        lambda x: P.platform_trades(x.tr, x.ev).select("wallet_address", "platform", "type", "ts", "_volume_usd"),
        f"""SELECT t.wallet_address, a.platform, t.type, {moment('t.ts')} AS ts, t.vol AS "_volume_usd" FROM {_by_app(_TRADE)}""",
        {"_volume_usd": 2}),
    "platform_trade_kpis": Query(
        lambda x: P.platform_trade_kpis(x.tr, x.ev),
        f"SELECT platform, sum(vol) AS volume, count(*) AS trades FROM {_by_app(_TRADE)} GROUP BY 1", MONEY),
    "platform_perps_kpis": Query(
        lambda x: P.platform_perps_kpis(x.tr, x.ev),
        f"""SELECT platform, sum(vol) AS volume, count(*) AS orders, count(DISTINCT t.wallet_address) AS traders,
            sum(vol) / count(*) AS avg_order, avg(leverage) AS avg_leverage FROM {_by_app(_PERPS)} GROUP BY 1""",
        {"volume": 2, "avg_order": 4, "avg_leverage": 6}),
    "platform_perps_sides": Query(
        lambda x: P.platform_perps_sides(x.tr, x.ev),
        f"SELECT platform, side, count(*) AS count FROM {_by_app(_PERPS)} GROUP BY 1, 2"),
    "platform_top_assets": Query(
        lambda x: P.platform_top_assets(x.tr, x.ev, digits=None),
        f"""SELECT platform, asset, volume FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY volume DESC, asset) AS rn
            FROM (SELECT platform, asset, sum(vol) AS volume FROM {_by_app(_PERPS)} GROUP BY 1, 2)) WHERE rn <= 10""", MONEY),
    # --- notifications ---
    "notification_kpis": Query(
        lambda x: M.notification_kpis(x.evall),
        """SELECT *, broadcast_sent + targeted_sent AS total_sent, tapped / (broadcast_sent + targeted_sent) * 100 AS tap_rate_server,
            tapped / received * 100 AS tap_rate_client FROM (
            SELECT (SELECT CAST(sum(CAST(json_extract_string(metadata, '$.sent_count') AS BIGINT)) AS BIGINT) FROM evall
                    WHERE event = 'notification_sent_broadcast') AS broadcast_sent,
                (SELECT count(*) FROM evall WHERE event = 'notification_sent'
                    AND json_extract_string(metadata, '$.success') = 'true') AS targeted_sent,
                (SELECT count(*) FROM ev WHERE event = 'notification_received') AS received,
                (SELECT count(*) FROM ev WHERE event = 'notification_tap') AS tapped,
                (SELECT count(DISTINCT wallet_address) FROM ev WHERE event = 'notification_tap') AS unique_tappers)""",
        {"tap_rate_server": 6, "tap_rate_client": 6}),
    "sends_by_type": Query(
        lambda x: M.sends_by_type(x.evall),
        """SELECT 'Trade Alerts (broadcast)' AS type, count(*) AS sends,
                CAST(sum(CAST(json_extract_string(metadata, '$.sent_count') AS BIGINT)) AS BIGINT) AS recipients
            FROM evall WHERE event = 'notification_sent_broadcast'
            UNION ALL SELECT CASE k WHEN 'price_alert' THEN 'Price Alert' ELSE 'Lifecycle' END, count(*), count(*) FROM (
                SELECT json_extract_string(metadata, '$.type') AS k FROM evall WHERE event = 'notification_sent')
            WHERE k IN ('price_alert', 'lifecycle') GROUP BY k"""),
    "tap_rate_by_day": Query(
        lambda x: M.tap_rate_by_day(x.ev),
        f"""SELECT {day('coalesce(t.date, r.date)')} AS date, coalesce(t.n / r.n * 100, 0) AS rate
            FROM (SELECT date, count(*) AS n FROM ev WHERE event = 'notification_tap' GROUP BY 1) t
            FULL JOIN (SELECT date, count(*) AS n FROM ev WHERE event = 'notification_received' GROUP BY 1) r ON r.date = t.date""",
        {"rate": 6}),
    "time_to_trade": Query(_times, f"SELECT * REPLACE ({moment('tap_ts')} AS tap_ts, {moment('trade_ts')} AS trade_ts) FROM ({_TTT})",
                           {"seconds": 6}),
    "time_to_trade_stats": Query(
        lambda x: M.time_to_trade_stats(_times(x)),
        f"""SELECT avg(seconds) AS avg_seconds, list_sort(list(seconds))[count(*) // 2 + 1] AS median_seconds,
            count(*) AS conversions FROM ({_TTT})""", {"avg_seconds": 4, "median_seconds": 6}),
    "time_to_trade_histogram": Query(lambda x: M.time_to_trade_histogram(_times(x)), _histogram_sql(_TTT, "seconds"),
                                     {"bin_start": 4, "bin_end": 4}),
    "top_tapped_tickers": Query(
        lambda x: M.top_tapped_tickers(x.ev),
        """SELECT m_ticker AS ticker, count(*) AS taps FROM ev WHERE event = 'notification_tap' AND m_ticker <> ''
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "top_tappers": Query(
        lambda x: M.top_tappers(x.ev, x.users),
        enriched("""SELECT wallet_address, count(*) AS taps FROM ev WHERE event = 'notification_tap'
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")),
}
