"""The six inputs derived from the driver's tables, over all their rows.

Each derivation is a list of SQL expressions that reads the same in Spark and DuckDB, so both
sides of a comparison start from the same data and differ only in the analysis.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

EVENTS = {
    "event_id": "event_id",
    "date": "cast(cast(ts as date) as varchar(10))",
    "timestamp": "ts",
    "wallet_address": "case when user_id % 37 = 0 then 'server' "
                      "else concat('0xAB', lpad(cast(user_id as varchar(20)), 8, '0')) end",
    "platform": "case when event_id % 101 = 0 then 'server' when user_id % 3 = 0 then 'ios' "
                "when user_id % 3 = 1 then 'Android' else 'web' end",
    "event": """case
        when event_type = 'view' then case event_id % 4 when 0 then 'session_start' when 1 then 'session_end'
            when 2 then 'token_detail_view' else 'feed_card_tap' end
        when event_type = 'click' then case event_id % 4 when 0 then 'notification_received'
            when 1 then 'notification_tap' when 2 then 'buy_button_tap' else 'swap_modal_open' end
        when event_type = 'purchase' then case event_id % 3 when 0 then 'trade_initiated'
            when 1 then 'trade_success' else 'trade_error' end
        when event_type = 'signup' then case event_id % 4 when 0 then 'deposit_modal_open'
            when 1 then 'deposit_initiated' when 2 then 'deposit_success' else 'deposit_error' end
        else case event_id % 4 when 0 then 'notification_sent' when 1 then 'notification_sent_broadcast'
            when 2 then 'search_query' else 'scroll_depth' end end""",
    "session_id": "concat('s', cast(event_id as varchar(20)))",
    "metadata": """concat('{"duration_ms":', cast(cast(floor(value * 1000) as bigint) as varchar(20)),
        ',"provider":"P', cast(user_id % 4 as varchar(20)),
        '","sent_count":', cast(event_id % 50 as varchar(20)),
        ',"success":', case when event_id % 3 = 0 then 'true' else 'false' end,
        ',"type":"', case when event_id % 2 = 0 then 'price_alert' else 'lifecycle' end,
        '","ticker":"T', cast(user_id % 9 as varchar(20)), '"}')""",
}

# Cohorts need first visits on many days: one wallet per user and span of days.
COHORT_WALLET = """concat('0xAB', lpad(cast(user_id as varchar(20)), 8, '0'), '-',
    cast(cast(floor((extract(day from ts) - 1) / (3 + user_id % 12)) as bigint) as varchar(20)))"""

TRADES = {
    "timestamp": "l_shipdate + interval '1' second * ((l_orderkey * 7 + l_linenumber * 3607) % 86400)",
    "trade_date": "cast(cast(l_shipdate as date) as varchar(10))",
    "wallet_address": "concat('0xAB', lpad(cast(o_custkey as varchar(20)), 8, '0'))",
    "type": "case l_returnflag when 'R' then 'swap' when 'A' then 'perps' else 'deposit' end",
    "amount_usd": "l_extendedprice",
    "leverage": "l_linenumber",
    "size": "l_quantity",
    "price": "p_retailprice",
    "is_close": "l_linestatus = 'F'",
    "venue": "case when l_suppkey % 5 = 0 then 'Ostium' else 'hyperliquid' end",
    "asset": "p_brand",
    "from_token": "p_brand",
    "to_token": "p_type",
    "source": "o_orderpriority",
    "status": "o_orderstatus",
    "order_type": "case when l_discount > 0.05 then 'limit' else 'market' end",
    "side": "case when l_partkey % 2 = 0 then 'long' else 'short' end",
}

METRICS = [
    C.METRIC_FEE_BALANCE, C.METRIC_API_REQUEST, C.METRIC_API_ERROR, C.METRIC_API_LATENCY, C.METRIC_ORDER_PLACE,
    C.METRIC_ORDER_CANCEL, C.METRIC_WITHDRAW, C.METRIC_BRIDGE_SUCCESS, C.METRIC_BRIDGE_FAILURE,
    C.METRIC_BRIDGE_DURATION, C.METRIC_BRIDGE_FILL, C.METRIC_ROUTE, C.METRIC_REVERSE_ROUTE, C.METRIC_SETTLE_TIMEOUT,
    C.METRIC_VENUE_READ, C.METRIC_VENUE_ERROR, C.METRIC_CACHE_HIT, C.METRIC_CACHE_MISS, C.METRIC_WS_CONNECTIONS,
    C.METRIC_WS_SENT, C.METRIC_WS_RECEIVED, C.METRIC_WS_SLOW, C.METRIC_SIGNING, C.METRIC_SNAPSHOT,
    C.METRIC_MEMORY, C.METRIC_MEMORY_LIMIT, C.METRIC_CPU, C.METRIC_HTTP_REQUESTS, C.METRIC_HTTP_LATENCY,
    C.METRIC_NETWORK_TX, C.METRIC_CDN_REQUESTS, C.METRIC_CDN_BYTES, C.METRIC_CDN_4XX, C.METRIC_CDN_5XX,
    C.METRIC_CDN_HIT_RATE,
]
# Positions in the list above: which metrics carry which dimensions.
_IS_SERVICE, _IS_CDN = "metric between 24 and 29", "metric >= 30"

_POINT_METRIC = {
    "ts": "ts", "value": "value", "event_id": "event_id", "user_id": "user_id",
    "metric": f"(event_id * 11 + user_id) % {len(METRICS)}",
}
# One point per event. Dimension columns that are null are not part of the point's series.
POINTS = {
    "ts": "ts",
    "value": "value",
    "metric_name": "case metric " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(METRICS)) + " end",
    "environment": "case when metric >= 24 then null when event_id % 13 = 0 then 'production' else 'development' end",
    # Every seventh API request point also carries a venue and so belongs to a finer series.
    "venue": "case when metric in (4, 14, 15) or (metric = 1 and event_id % 7 = 0) "
             "then case user_id % 3 when 0 then 'hyperliquid' when 1 then 'lighter' else 'ostium' end end",
    "service": f"case when {_IS_SERVICE} then concat('svc-', cast(user_id % 5 as varchar(20))) end",
    "distribution": f"case when {_IS_CDN} then concat('E', cast(user_id % 2 as varchar(20))) end",
    "region": f"case when {_IS_CDN} then 'Global' end",
}
_DIM_COLUMNS = {C.DIM_ENVIRONMENT: "environment", C.DIM_VENUE: "venue", C.DIM_SERVICE: "service",
                C.DIM_DISTRIBUTION: "distribution", C.DIM_REGION: "region"}

LOGS = {
    "ts": "ts",
    "log_group": "'app'",
    "message": """concat('<', case event_type when 'error' then '3' when 'signup' then '4' else '6' end, '>1 ',
        replace(cast(ts as varchar(30)), ' ', 'T'), ' ',
        case user_id % 3 when 0 then 'swap-server-1' when 1 then 'twitter-scraper' else 'payments' end,
        case when event_id % 2 = 0 then concat(' http-request 1 http-request - {"statusCode":',
            case event_id % 6 when 0 then '200' when 2 then '400' else '502' end,
            ',"path":"/order?inputMint=So', lpad(cast(user_id as varchar(20)), 12, '0'),
            '&outputMint=Us', lpad(cast(user_id % 7 as varchar(20)), 12, '0'),
            '","method":"GET","responseTimeMS":', cast(cast(floor(value) as bigint) as varchar(20)),
            ',"time":"', cast(ts as varchar(30)), '"}')
        when event_id % 3 = 0 then concat(' app 1 app - >>> SIGNAL: T', cast(user_id % 9 as varchar(20)), ' BUY')
        when event_id % 3 = 1 then ' app 1 app - >>> Not tradable'
        else ' app 1 app - ECONNREFUSED upstream' end)""",
}

# One alarm per supplier.
ALARMS = {
    "AlarmName": "concat('pulse-alarm-', s_name)",
    "StateValue": "case s_suppkey % 4 when 0 then 'ALARM' when 3 then 'INSUFFICIENT_DATA' else 'OK' end",
    "AlarmDescription": "case when s_suppkey % 8 = 0 then null else concat('balance ', cast(s_nationkey as varchar(20))) end",
}

# One user per customer: accounts by market segment, an apple account for even nations, an own
# wallet outside HOUSEHOLD, and for keys ending in 3 also the wallet of the customer before.
USERS = {
    "id": "concat('did-', cast(c_custkey as varchar(20)))",
    "ingest_order": "c_custkey",
    "own_wallet": "case when c_mktsegment <> 'HOUSEHOLD' then concat('0xAB', lpad(cast(c_custkey as varchar(20)), 8, '0')) end",
    "other_wallet": "case when c_custkey % 10 = 3 then concat('0xAb', lpad(cast(c_custkey - 1 as varchar(20)), 8, '0')) end",
    "google_email": "case when c_mktsegment = 'BUILDING' then concat(c_name, '@g') end",
    "google_name": "case when c_mktsegment = 'BUILDING' and c_nationkey % 3 <> 0 then c_name end",
    "email": "case when c_mktsegment = 'MACHINERY' then concat(c_name, '@m') end",
    "apple": "case when c_nationkey % 2 = 0 then concat(c_name, '@a') end",
    "twitter": "case when c_mktsegment = 'FURNITURE' then c_name end",
    "phone": "case when c_mktsegment = 'AUTOMOBILE' then concat('+', cast(c_custkey as varchar(20))) end",
}


def _columns(spec: dict[str, str]) -> list[str]:
    return [f"{expr} AS `{name}`" for name, expr in spec.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(EVENTS))


def cohort_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns({**EVENTS, "wallet_address": COHORT_WALLET}))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
              .join(part, lines.l_partkey == part.p_partkey))
    return joined.selectExpr(*_columns(TRADES))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "events"))


def points_of(raw: DataFrame) -> DataFrame:
    flat = raw.selectExpr(*_columns(_POINT_METRIC)).selectExpr(*_columns(POINTS))
    pairs = F.array(*[F.struct(F.lit(key).alias("key"), F.col(name).alias("value")) for key, name in _DIM_COLUMNS.items()])
    dims = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return flat.select("ts", F.lit(None).cast("string").alias("namespace"), "metric_name", "value", dims.alias("dims"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(LOGS))


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*_columns(ALARMS))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "customer").selectExpr(*_columns(USERS))

    def account(kind: str, **fields: str) -> str:
        names = ("address", "email", "name", "number", "username")
        values = ", ".join(f"'{n}', {fields.get(n, 'cast(null AS string)')}" for n in names)
        present = " OR ".join(f"{column} IS NOT NULL" for column in fields.values())
        return f"CASE WHEN {present} THEN named_struct('type', '{kind}', {values}) END"

    accounts = ", ".join([
        account("wallet", address="own_wallet"), account("wallet", address="other_wallet"),
        account("google_oauth", email="google_email", name="google_name"), account("email", address="email"),
        account("apple_oauth", email="apple"), account("twitter_oauth", username="twitter"),
        account("phone", number="phone")])
    return flat.selectExpr("id", "ingest_order", f"array_compact(array({accounts})) AS linked_accounts")


# --- the same inputs as SQL -------------------------------------------------------

def _select(spec: dict[str, str], source: str) -> str:
    return "SELECT " + ",\n  ".join(f'{expr} AS "{name}"' for name, expr in spec.items()) + f"\nFROM {source}"


def _with_local(source: str, day: str) -> str:
    local = "(CAST(\"timestamp\" AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"
    return (f'SELECT * EXCLUDE ("{day}"), "timestamp" AS ts, {local} AS ts_local, CAST({local} AS DATE) AS "{day}", '
            f"CAST(extract(hour FROM {local}) AS INTEGER) AS hour, "
            f"CAST(extract(dow FROM {local}) AS INTEGER) AS day_of_week, "
            f"CAST(extract(isodow FROM {local}) - 1 AS INTEGER) AS dow FROM ({source})")


_REAL = ("(wallet_address IS NULL OR wallet_address NOT IN ('server', 'unknown', 'system', '')) "
         "AND (platform IS NULL OR platform <> 'server')")

_NOTIONAL = """SELECT * REPLACE (
    CASE WHEN type = 'perps' AND is_close THEN CASE WHEN lower(venue) = 'ostium' THEN abs(size) ELSE abs(size) * price END
         WHEN type = 'perps' THEN CASE WHEN lower(venue) = 'ostium' THEN amount_usd ELSE amount_usd * leverage END
         ELSE amount_usd END AS amount_usd) FROM (
    SELECT * REPLACE (CAST(leverage AS DOUBLE) AS leverage, CAST(size AS DOUBLE) AS size, CAST(price AS DOUBLE) AS price,
                      CAST(amount_usd AS DOUBLE) AS amount_usd) FROM trades_local)"""

CTES = {
    "evall": _with_local(_select(EVENTS, "events"), "date"),
    "ev": f"SELECT *, json_extract_string(metadata, '$.duration_ms') AS m_duration, "
          f"json_extract_string(metadata, '$.provider') AS m_provider, "
          f"json_extract_string(metadata, '$.ticker') AS m_ticker FROM evall WHERE {_REAL}",
    "cohort_ev": f"SELECT * FROM ({_with_local(_select({**EVENTS, 'wallet_address': COHORT_WALLET}, 'events'), 'date')}) WHERE {_REAL}",
    "sessions": "SELECT wallet_address, session_id, CAST(m_duration AS DOUBLE) AS duration_ms, date, platform "
                "FROM ev WHERE event = 'session_end' AND CAST(m_duration AS DOUBLE) > 0",
    "trades_raw": _select(TRADES, "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"),
    "trades_local": _with_local("SELECT * FROM trades_raw", "trade_date"),
    "tr": f"SELECT *, amount_usd * CASE WHEN type = 'perps' AND is_close THEN 2 ELSE 1 END AS vol FROM ({_NOTIONAL})",
    "users_flat": _select(USERS, "customer"),
    "people": """SELECT *,
        CASE WHEN google_name IS NOT NULL THEN google_name WHEN google_email IS NOT NULL THEN google_email
             WHEN email IS NOT NULL THEN email WHEN apple IS NOT NULL THEN apple
             WHEN twitter IS NOT NULL THEN '@' || twitter WHEN phone IS NOT NULL THEN phone END AS label,
        CASE WHEN google_email IS NOT NULL THEN 'google' WHEN email IS NOT NULL THEN 'email'
             WHEN apple IS NOT NULL THEN 'apple' WHEN twitter IS NOT NULL THEN 'twitter'
             WHEN phone IS NOT NULL THEN 'phone' ELSE 'wallet_only' END AS login,
        CASE WHEN google_email IS NOT NULL THEN google_email WHEN email IS NOT NULL THEN email
             WHEN apple IS NOT NULL THEN apple WHEN twitter IS NOT NULL THEN NULL
             WHEN phone IS NOT NULL THEN phone END AS contact,
        coalesce(email, google_email, apple) AS best_email FROM users_flat""",
    "ident": """SELECT wallet, id AS user_id, label, login, contact, best_email FROM (
        SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ingest_order DESC) AS rn FROM (
            SELECT lower(own_wallet) AS wallet, * FROM people WHERE own_wallet IS NOT NULL
            UNION ALL SELECT lower(other_wallet) AS wallet, * FROM people WHERE other_wallet IS NOT NULL)) WHERE rn = 1""",
    "points": _select(POINTS, "(" + _select(_POINT_METRIC, "events") + ")"),
    "logs_raw": _select(LOGS, "events"),
    "logs": r"""SELECT *, TRY_CAST(nullif(regexp_extract(body, '"statusCode":(\d+)', 1), '') AS INTEGER) AS sc,
        nullif(regexp_extract(body, '"method":"([^"]+)"', 1), '') AS method,
        nullif(regexp_extract(body, '"time":"([^"]+)"', 1), '') AS req_time,
        TRY_CAST(nullif(regexp_extract(body, '"responseTimeMS":(\d+)', 1), '') AS BIGINT) AS latency,
        nullif(regexp_extract(rawpath, '^/([^?]+)', 1), '') AS endpoint,
        nullif(regexp_extract(rawpath, 'inputMint=([^&]+)', 1), '') AS in_mint,
        nullif(regexp_extract(rawpath, 'outputMint=([^&]+)', 1), '') AS out_mint FROM (
        SELECT *, nullif(regexp_extract(body, '"path":"([^"]+)"', 1), '') AS rawpath FROM (
            SELECT ts, message, CAST(regexp_extract(message, '^<(\d+)>', 1) AS INTEGER) AS pri,
                regexp_extract(message, '^<\d+>\d+ (\S+)', 1) AS log_ts,
                regexp_extract(message, '^<\d+>\d+ \S+ (\S+)', 1) AS svc,
                regexp_extract(message, '^<\d+>\d+ \S+ \S+ \S+ \d+ \S+ - (.*)', 1) AS body FROM logs_raw))""",
    "alarms": _select(ALARMS, "supplier"),
}


def with_inputs(sql: str) -> str:
    """A complete statement: the input definitions that `sql` needs, then `sql`."""
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name, definition in CTES.items():
            if name != own and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(definition, name)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    inputs = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in needed)
    return f"WITH {inputs}\n{sql}"
