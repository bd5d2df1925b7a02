"""Registered queries: scans, normalisation, identity, audience."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wallets import short_token, short_wallet
from ..operators import audience as A
from ..operators import identity as I
from ..operators import normalize as N
from ..session import work_dir
from ..sources import scan_events, scan_trades, scan_trades_by_timestamp, scan_users
from .base import Inputs, Query, day, enriched, moment, short

START, TODAY = "2024-01-08", "2024-01-30"
WALLET = "0xAB00000001"
SPAN = ("1996-03-01", "1998-09-30")


def _stored(x: Inputs, name: str, df: DataFrame, day_column: str) -> str:
    """Path of `df` in the day layout that the scans are made for, written once per session and input folder."""
    done = x.spark.__dict__.setdefault("_day_layouts", {})
    if (name, x.sf_dir) not in done:
        path = work_dir(x.spark, name)
        df.repartition(day_column).write.partitionBy(day_column).parquet(path)
        done[name, x.sf_dir] = path
    return done[name, x.sf_dir]


def _scan_events(x: Inputs, trim: bool):
    df = scan_events(_stored(x, "events", x.events, "date"), START, "2024-01-20", trim_local=trim)
    return df.groupBy("date", "event").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"))


def _scan_events_sql(condition: str) -> str:
    return f"""SELECT date, event, count(*) AS rows, {moment('min(ts)')} AS first FROM (
        SELECT e.* EXCLUDE (date), strftime(ts, '%Y-%m-%d') AS date, date AS local_date FROM evall e)
        WHERE date BETWEEN '2024-01-08' AND '2024-01-21' AND {condition} GROUP BY date, event"""


def _trade_totals(df):
    return df.groupBy("type").agg(F.count("*").alias("rows"), F.sum("amount_usd").alias("amount"),
                                  F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def _trade_totals_sql(condition: str) -> str:
    return f"""SELECT type, count(*) AS rows, sum(amount_usd) AS amount, {moment('min("timestamp")')} AS first,
        {moment('max("timestamp")')} AS last FROM trades_raw WHERE {condition} GROUP BY type"""


def _text_events(x: Inputs):
    """Timestamps as ISO text, to pass through the text parser."""
    raw = x.events.withColumn("timestamp", F.replace(F.col("timestamp").cast("string"), F.lit(" "), F.lit("T")))
    return N.normalize_events(raw)


def _per_wallet(sql_columns: str, table: str = "ev") -> str:
    return f"SELECT wallet_address, {sql_columns} FROM {table} WHERE wallet_address IS NOT NULL GROUP BY wallet_address"


_ACTIVITY = _per_wallet(f"count(event) AS events, count(DISTINCT date) AS days_active, {day('min(date)')} AS first_seen, "
                        f"{day('max(date)')} AS last_seen")
_SESSION_MS = "avg(CASE WHEN event = 'session_end' AND CAST(m_duration AS DOUBLE) > 0 THEN CAST(m_duration AS DOUBLE) END)"
_SESSION_N = "count(CASE WHEN event = 'session_end' AND CAST(m_duration AS DOUBLE) > 0 THEN 1 END)"

QUERIES: dict[str, Query] = {
    # --- scans ---
    "scan_events": Query(lambda x: _scan_events(x, False), _scan_events_sql("true")),
    "scan_events_trimmed": Query(lambda x: _scan_events(x, True),
                                 _scan_events_sql("local_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'")),
    "scan_trades": Query(lambda x: _trade_totals(scan_trades(_stored(x, "trades", x.trades, "trade_date"), *SPAN)),
                         _trade_totals_sql(f"trade_date BETWEEN '{SPAN[0]}' AND '{SPAN[1]}'"), {"amount": 2}),
    "scan_trades_by_timestamp": Query(
        lambda x: _trade_totals(scan_trades_by_timestamp(_stored(x, "trades", x.trades, "trade_date"), *SPAN)),
        _trade_totals_sql("\"timestamp\" >= TIMESTAMP '1996-03-01' AND \"timestamp\" < TIMESTAMP '1998-10-01'"), {"amount": 2}),
    "scan_users": Query(
        lambda x: scan_users(x.users).select("id", "ingest_order", F.explode_outer("linked_accounts").alias("a"))
        .select("id", "ingest_order", "a.*"),
        " UNION ALL ".join(f"""SELECT id, ingest_order, '{kind}' AS type, {address} AS address, {email} AS email, {name} AS name, {number} AS number,
            {username} AS username FROM users_flat WHERE {where}""" for kind, address, email, name, number, username, where in [
                ("wallet", "own_wallet", "NULL", "NULL", "NULL", "NULL", "own_wallet IS NOT NULL"),
                ("wallet", "other_wallet", "NULL", "NULL", "NULL", "NULL", "other_wallet IS NOT NULL"),
                ("google_oauth", "NULL", "google_email", "google_name", "NULL", "NULL", "google_email IS NOT NULL OR google_name IS NOT NULL"),
                ("email", "email", "NULL", "NULL", "NULL", "NULL", "email IS NOT NULL"),
                ("apple_oauth", "NULL", "apple", "NULL", "NULL", "NULL", "apple IS NOT NULL"),
                ("twitter_oauth", "NULL", "NULL", "NULL", "NULL", "twitter", "twitter IS NOT NULL"),
                ("phone", "NULL", "NULL", "NULL", "phone", "NULL", "phone IS NOT NULL")]) + """
            UNION ALL SELECT id, ingest_order, NULL, NULL, NULL, NULL, NULL, NULL FROM users_flat WHERE coalesce(own_wallet, other_wallet,
            google_email, google_name, email, apple, twitter, phone) IS NULL"""),
    # --- normalisation ---
    "normalize_events": Query(
        lambda x: _text_events(x).select("session_id", "ts", "date", "hour", "day_of_week"),
        f"SELECT session_id, {moment('ts')} AS ts, {day('date')} AS date, hour, day_of_week FROM evall"),
    "real_users": Query(lambda x: x.ev.select("session_id", "wallet_address", "platform", "event"),
                        "SELECT session_id, wallet_address, platform, event FROM ev"),
    "normalize_trades": Query(
        lambda x: x.tr.select("wallet_address", "ts", "trade_date", "hour", "dow", "type"),
        f"SELECT wallet_address, {moment('ts')} AS ts, {day('trade_date')} AS trade_date, hour, dow, type FROM tr"),
    "perps_notional": Query(
        lambda x: N.perps_notional(x.trades).select("wallet_address", "type", "venue", "is_close", "leverage",
                                                    "amount_usd", "_volume_usd"),
        'SELECT wallet_address, type, venue, is_close, leverage, amount_usd, vol AS "_volume_usd" FROM tr',
        {"amount_usd": 2, "_volume_usd": 2}),
    "short_forms": Query(
        lambda x: x.identity.select("wallet", short_wallet(F.col("wallet")).alias("wallet_short"),
                                    short_token(F.col("user_id")).alias("token_short"),
                                    short_token(F.col("user_id"), 6).alias("label_short")),
        f"""SELECT wallet, {short('wallet')} AS wallet_short,
            CASE WHEN length(user_id) > 12 THEN left(user_id, 6) || '...' || right(user_id, 4) ELSE user_id END AS token_short,
            CASE WHEN length(user_id) > 6 THEN left(user_id, 6) || '...' || right(user_id, 4) ELSE user_id END AS label_short
            FROM ident"""),
    # --- identity ---
    "extract_identity": Query(
        lambda x: I.extract_identity(x.users).select(
            "user_id", "label", "login_type", "contact", "email", F.array_join("wallets", ",").alias("wallets")),
        """SELECT id AS user_id, label, login AS login_type, contact, best_email AS email,
            concat_ws(',', lower(own_wallet), lower(other_wallet)) AS wallets FROM people"""),
    "wallet_identity": Query(
        lambda x: x.identity,
        "SELECT wallet, user_id, label, login AS login_type, contact, best_email AS email FROM ident"),
    "enrich_identity": Query(
        lambda x: I.enrich_identity(x.ev.select("session_id", "wallet_address"), x.identity),
        enriched("SELECT session_id, wallet_address FROM ev")),
    "matched_users": Query(
        lambda x: I.matched_users(x.ev, x.identity),
        """SELECT count(i.wallet) AS matched_users, count(*) AS unique_users, count(i.wallet) / count(*) * 100 AS matched_pct
            FROM (SELECT DISTINCT wallet_address FROM ev) w LEFT JOIN ident i ON lower(w.wallet_address) = i.wallet""",
        {"matched_pct": 6}),
    # --- audience ---
    "event_totals": Query(
        lambda x: A.event_totals(x.evall),
        "SELECT (SELECT count(*) FROM evall) AS total_events, (SELECT count(DISTINCT wallet_address) FROM ev) AS unique_users"),
    "dau": Query(lambda x: A.dau(x.ev),
                 f"SELECT {day('date')} AS date, count(DISTINCT wallet_address) AS users FROM ev GROUP BY ev.date"),
    "overview_kpis": Query(
        lambda x: A.overview_kpis(x.ev),
        f"""SELECT (SELECT avg(u) FROM (SELECT count(DISTINCT wallet_address) AS u FROM ev GROUP BY date)) AS avg_dau,
            count(DISTINCT wallet_address) AS unique_users, count(CASE WHEN event = 'session_start' THEN 1 END) AS sessions,
            {_SESSION_MS} AS avg_session_ms FROM ev""", {"avg_dau": 6, "avg_session_ms": 6}),
    "session_durations": Query(
        lambda x: A.session_durations(x.ev),
        f"SELECT wallet_address, session_id, duration_ms, {day('date')} AS date FROM sessions"),
    "user_activity": Query(
        lambda x: A.user_activity(x.ev, x.identity),
        enriched(_ACTIVITY, f"b.*, {short('b.wallet_address')} AS wallet_short")),
    "most_active_users": Query(
        lambda x: A.most_active_users(x.ev, x.users),
        enriched(f"{_ACTIVITY} ORDER BY events DESC, wallet_address LIMIT 20", f"b.*, {short('b.wallet_address')} AS wallet_short")),
    "concurrent_users": Query(
        lambda x: A.concurrent_users(x.ev),
        f"""SELECT {moment('b')} AS time_utc, {moment("(b AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'")} AS time, viewers,
            avg(viewers) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS viewers_smooth FROM (
            SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, count(DISTINCT wallet_address) AS viewers FROM ev GROUP BY 1)""",
        {"viewers_smooth": 6}),
    "wau_mau": Query(
        lambda x: A.wau_mau(x.ev, TODAY),
        """SELECT count(DISTINCT CASE WHEN date >= DATE '2024-01-23' THEN wallet_address END) AS wau,
            count(DISTINCT CASE WHEN date >= DATE '2023-12-31' THEN wallet_address END) AS mau FROM ev"""),
    "new_vs_returning": Query(
        lambda x: A.new_vs_returning(x.cohort_ev, START),
        """SELECT count(CASE WHEN d >= DATE '2024-01-08' THEN 1 END) AS new_users,
            count(CASE WHEN d < DATE '2024-01-08' THEN 1 END) AS returning_users,
            count(CASE WHEN d >= DATE '2024-01-08' THEN 1 END) / count(*) * 100 AS new_pct
            FROM (SELECT wallet_address, min(date) AS d FROM cohort_ev GROUP BY 1)""", {"new_pct": 6}),
    "events_per_user": Query(
        lambda x: A.events_per_user(x.ev),
        """SELECT count(*) AS events, count(DISTINCT wallet_address) AS unique_users,
            count(*) / count(DISTINCT wallet_address) AS events_per_user FROM ev""", {"events_per_user": 6}),
    "platform_kpis": Query(
        lambda x: A.platform_kpis(x.ev),
        f"""SELECT lower(platform) AS platform, count(DISTINCT wallet_address) AS users, {_SESSION_MS} / 1000 AS avg_session_s,
            count(*) / count(DISTINCT wallet_address) AS events_per_user, {_SESSION_N} AS timed_sessions
            FROM ev WHERE lower(platform) IN ('ios', 'android') GROUP BY 1""", {"avg_session_s": 6, "events_per_user": 6}),
    "dau_by_platform": Query(
        lambda x: A.dau_by_platform(x.ev),
        f"""SELECT {day('date')} AS date, count(DISTINCT CASE WHEN lower(platform) = 'ios' THEN wallet_address END) AS ios,
            count(DISTINCT CASE WHEN lower(platform) = 'android' THEN wallet_address END) AS android
            FROM ev WHERE lower(platform) IN ('ios', 'android') GROUP BY ev.date"""),
    "top_events_by_platform": Query(
        lambda x: A.top_events_by_platform(x.ev),
        """SELECT platform, event, count FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY count DESC, event) AS rn
            FROM (SELECT lower(platform) AS platform, event, count(*) AS count FROM ev
            WHERE lower(platform) IN ('ios', 'android') GROUP BY 1, 2)) WHERE rn <= 10"""),
    "events_by_day": Query(lambda x: A.events_by_day(x.ev),
                           f"SELECT {day('date')} AS date, count(*) AS count FROM ev GROUP BY ev.date"),
    "top_events": Query(lambda x: A.top_events(x.ev),
                        "SELECT event, count(*) AS count FROM ev GROUP BY event ORDER BY count DESC, event LIMIT 12"),
    "events_by_hour": Query(
        lambda x: A.events_by_hour(x.ev),
        """SELECT h AS hour, count(ev.event_id) AS events FROM (SELECT unnest(range(24)) AS h) LEFT JOIN ev ON ev.hour = h GROUP BY 1"""),
    "events_by_dow": Query(
        lambda x: A.events_by_dow(x.ev),
        """SELECT d AS dow, count(ev.event_id) AS events, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][d + 1] AS day
            FROM (SELECT unnest(range(7)) AS d) LEFT JOIN ev ON ev.day_of_week = d GROUP BY 1"""),
    "activity_heatmap": Query(
        lambda x: A.activity_heatmap(x.ev),
        "SELECT ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][d + 1] AS day, d AS dow, "
        + ", ".join(f"count(CASE WHEN hour = {h} THEN 1 END) AS h{h}" for h in range(24))
        + " FROM (SELECT unnest(range(7)) AS d) LEFT JOIN ev ON ev.day_of_week = d GROUP BY 2"),
    # --- leaderboards and one user ---
    "time_spent_leaderboard": Query(
        lambda x: A.time_spent_leaderboard(x.ev, x.users),
        enriched("""SELECT wallet_address, round_even(sum(duration_ms) / 60000, 1) AS total_time_min,
            count(session_id) AS sessions, round_even(avg(duration_ms) / 60000, 1) AS avg_session_min FROM sessions
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", f"b.*, {short('b.wallet_address')} AS wallet_short")),
    "user_list": Query(
        lambda x: A.user_list(x.ev, x.identity),
        f"""SELECT wallet_address, user_label, {short('wallet_address')} AS wallet_short
            FROM ({enriched('SELECT DISTINCT wallet_address FROM ev')})"""),
    "user_profile": Query(
        lambda x: A.user_profile(x.ev, x.users, WALLET),
        enriched(f"""SELECT '{WALLET}' AS wallet_address, count(*) AS events, count(DISTINCT date) AS days_active,
            coalesce(sum(CASE WHEN event = 'session_end' AND CAST(m_duration AS DOUBLE) > 0 THEN CAST(m_duration AS DOUBLE) END), 0)
            / 60000 AS total_min FROM ev WHERE wallet_address = '{WALLET}'"""), {"total_min": 6}),
    "user_event_breakdown": Query(
        lambda x: A.user_event_breakdown(x.ev, WALLET),
        f"""SELECT event, count(*) AS count FROM ev WHERE wallet_address = '{WALLET}'
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "user_daily_activity": Query(
        lambda x: A.user_daily_activity(x.ev, WALLET),
        f"SELECT {day('date')} AS date, count(*) AS events FROM ev WHERE wallet_address = '{WALLET}' GROUP BY ev.date"),
}
