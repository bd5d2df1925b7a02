"""Registered queries: metric rollups, health, alarms, logs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import health as H
from ..operators import logs as L
from ..operators.normalize import real_users
from ..operators.notifications import time_to_trade
from ..sources import metric_dim_values, metric_series, metric_series_by_dim, metric_series_by_service, period_for, scan_alarms
from ..sources import scan_logs, scan_points
from ..session import work_dir
from ..streaming import (metric_rollup, run_available, stream_concurrent_users, stream_errors_per_hour, stream_metric_rollup,
                         stream_time_to_trade, viewers_per_bucket, with_open_taps, with_open_windows)
from . import fixtures
from .base import Inputs, Query, moment
from .trading_queries import HALF_DAY
from .trading_queries import QUERIES as TRADING

END = "2024-01-29 00:00:00"
BACKEND = {C.DIM_ENVIRONMENT: C.BACKEND_ENVIRONMENT}
VALUE = {"value": 6}
FINE = {"value": 12}     # scaled values: rounded so far down that no exact half can meet the cut
MB = 1024 * 1024
P = "points"

# One exact series: which dimension columns are set, and to what.
_OWN = "environment = 'development' AND venue IS NULL"
_VENUE = "environment = 'development' AND venue IS NOT NULL"
_CDN = f"distribution = (SELECT min(distribution) FROM {P} WHERE metric_name = 'Requests') AND region = 'Global'"


def _bucket(period: int) -> str:
    return f"time_bucket(INTERVAL '{period} seconds', ts)"


def _series(metric: str, fn: str, where: str, period: int = 300, keys: str = "", scale: int = 1) -> str:
    group = f", {keys}" if keys else ""
    value = "v" if scale == 1 else f"v / {scale}.0::double"
    return (f"SELECT {moment('b')} AS timestamp, {value} AS value{group} FROM (SELECT {_bucket(period)} AS b, {fn}(value) AS v{group} "
            f"FROM {P} WHERE metric_name = '{metric}' AND {where} GROUP BY 1{group})")


def _mean(metric: str, where: str = _OWN) -> str:
    return (f"(SELECT avg(v) FROM (SELECT avg(value) AS v FROM {P} WHERE metric_name = '{metric}' AND {where} "
            f"GROUP BY {_bucket(300)}))")


def _sum(metric: str, where: str = _OWN) -> str:
    return f"(SELECT CAST(trunc(coalesce(sum(value), 0)) AS BIGINT) FROM {P} WHERE metric_name = '{metric}' AND {where})"


def _venue_mean(metric: str) -> str:
    return (f"SELECT venue, avg(v) AS m FROM (SELECT venue, avg(value) AS v FROM {P} WHERE metric_name = '{metric}' AND {_VENUE} "
            f"GROUP BY venue, {_bucket(300)}) GROUP BY venue")


def _service_series(metric: str, fn: str, scale: int = 1) -> str:
    return _series(metric, fn, "service IS NOT NULL", keys="service", scale=scale)


_ALL = dict(period=300, hours=None)     # every point of the table; only metric_series_lookback and scan_logs look back


_ERR = "pri <= 4"
_SWAP_FAILED = "message LIKE '%swap-server%' AND message LIKE '%http-request%' AND sc >= 400"


def _hourly(where: str) -> str:
    return f"SELECT {moment('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS hour, count(*) AS errors FROM logs WHERE {where} GROUP BY 1"


_HTTP_DETAIL = (f"SELECT svc AS service, 'HTTP ' || sc || ' /' || endpoint AS detail, count(*) AS count FROM logs WHERE {_ERR} "
                "AND message LIKE '%http-request%' AND sc >= 400 GROUP BY 1, 2")
_APP_DETAIL = (f"SELECT svc AS service, body AS detail, count(*) AS count FROM logs WHERE {_ERR} "
               "AND message NOT LIKE '%http-request%' GROUP BY 1, 2")
_FIRST = " ORDER BY 3 DESC, 1, 2 LIMIT 15"


def _short(col: str) -> str:
    return f"CASE WHEN length({col}) > 12 THEN left({col}, 6) || '...' || right({col}, 4) ELSE {col} END"


# --- streams: the raw events file as a stream ---------------------------------------

def _raw_stream(x: Inputs):
    raw = fixtures.table(x.spark, x.sf_dir, "events")
    # As a pattern the path may be a file or a folder of part files; a stream takes a plain path for a folder.
    return x.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 64).parquet(f"{x.sf_dir}/[e]vents.parquet")


def _closed(x: Inputs, stream: DataFrame, purpose: str) -> DataFrame:
    """The closed windows of a whole run; an error where rows are missing from them."""
    run = run_available(stream, work_dir(x.spark, purpose))
    if run.late_rows:
        raise RuntimeError(f"{purpose}: {run.late_rows} rows came too late for their windows")
    if not run.read_rows and not fixtures.table(x.spark, x.sf_dir, "events").isEmpty():
        raise RuntimeError(f"{purpose}: the stream read no row of a table that has some")
    return run.table


def _stream_users(x: Inputs):
    flat = _raw_stream(x).selectExpr(*[f"{e} AS `{n}`" for n, e in fixtures.EVENTS.items()])
    real = real_users(flat.withColumn("ts", F.col("timestamp")))
    closed = _closed(x, stream_concurrent_users(real), "concurrent-users")
    return with_open_windows(closed, x.ev, "time_utc", 300, viewers_per_bucket)


def _stream_rollup(x: Inputs):
    points = fixtures.points_of(_raw_stream(x))
    closed = _closed(x, stream_metric_rollup(points, C.METRIC_API_LATENCY, period=3600, dims=BACKEND), "metric-rollup")
    return with_open_windows(closed, x.points, "timestamp", 3600, lambda p: metric_rollup(p, C.METRIC_API_LATENCY, period=3600, dims=BACKEND))


def _stream_errors(x: Inputs):
    lines = _raw_stream(x).selectExpr(*[f"{e} AS `{n}`" for n, e in fixtures.LOGS.items()])
    closed = _closed(x, stream_errors_per_hour(lines), "errors-per-hour")
    return with_open_windows(closed, x.logs, "hour", 3600, L.errors_per_hour)


def _stream_times(x: Inputs):
    flat = _raw_stream(x).selectExpr(*[f"{e} AS `{n}`" for n, e in fixtures.EVENTS.items()])
    real = real_users(flat.withColumn("ts", F.col("timestamp")))
    closed = _closed(x, stream_time_to_trade(real, window_seconds=HALF_DAY), "time-to-trade")
    return with_open_taps(closed, x.ev, lambda ev: time_to_trade(ev, window_seconds=HALF_DAY))


def _lookback(hours: int) -> Query:
    """Each lookback has its own period: 5 minutes up to a day, 15 minutes up to three, else an hour."""
    period = period_for(hours)
    return Query(
        lambda x: metric_series(x.points, C.METRIC_API_REQUEST, "Sum", dims=BACKEND, hours=hours, end=END, exact_dims=False),
        _series(C.METRIC_API_REQUEST, "sum", f"environment = 'development' AND ts >= TIMESTAMP '{END}' - INTERVAL '{hours} hours' "
                f"AND ts < TIMESTAMP '{END}'", period), {"value": 2})


QUERIES: dict[str, Query] = {
    # --- metric rollups ---
    "scan_points": Query(
        lambda x: scan_points(x.points).select("ts", "namespace", "metric_name", "value", F.to_json("dims").alias("dims")),
        f"""SELECT {moment('ts')} AS ts, CAST(NULL AS VARCHAR) AS namespace, metric_name, value, '{{' || array_to_string(list_filter([
            '"{C.DIM_ENVIRONMENT}":"' || environment || '"', '"{C.DIM_VENUE}":"' || venue || '"', '"{C.DIM_SERVICE}":"' || service || '"',
            '"{C.DIM_DISTRIBUTION}":"' || distribution || '"', '"{C.DIM_REGION}":"' || region || '"'], lambda x: x IS NOT NULL), ',') || '}}' AS dims
            FROM points"""),
    "metric_series": Query(lambda x: metric_series(x.points, C.METRIC_API_LATENCY, "Average", dims=BACKEND, **_ALL),
                           _series(C.METRIC_API_LATENCY, "avg", _OWN), VALUE),
    "metric_series_sum": Query(lambda x: metric_series(x.points, C.METRIC_API_REQUEST, "Sum", dims=BACKEND, period=86400, hours=None),
                               _series(C.METRIC_API_REQUEST, "sum", _OWN, 86400), {"value": 2}),
    "metric_series_max": Query(lambda x: metric_series(x.points, C.METRIC_WS_CONNECTIONS, "Maximum", dims=BACKEND, period=900, hours=None),
                               _series(C.METRIC_WS_CONNECTIONS, "max", _OWN, 900)),
    "metric_series_lookback": _lookback(168),
    "metric_series_lookback_24h": _lookback(24),
    "metric_series_lookback_72h": _lookback(72),
    "metric_series_by_dim": Query(
        lambda x: metric_series_by_dim(x.points, C.METRIC_VENUE_ERROR, C.DIM_VENUE, C.ORDER_VENUES, "Sum", dims=BACKEND, **_ALL),
        "SELECT timestamp, value, venue AS dimension FROM (" + _series(
            C.METRIC_VENUE_ERROR, "sum", _VENUE + " AND venue IN ('hyperliquid', 'ostium')", keys="venue") + ")", {"value": 2}),
    "metric_series_by_service": Query(lambda x: metric_series_by_service(x.points, C.METRIC_MEMORY, "Average", **_ALL),
                                      _service_series(C.METRIC_MEMORY, "avg"), VALUE),
    "metric_dim_values": Query(
        lambda x: metric_dim_values(x.points, C.METRIC_MEMORY, C.DIM_SERVICE, hours=None),
        f"SELECT DISTINCT service AS value FROM {P} WHERE metric_name = '{C.METRIC_MEMORY}' AND service IS NOT NULL"),
    # --- backend ---
    "api_health": Query(
        lambda x: H.api_health(x.points, **_ALL),
        f"""SELECT {_sum(C.METRIC_API_REQUEST)} AS requests, {_mean(C.METRIC_API_LATENCY)} AS avg_latency_ms,
            {_sum(C.METRIC_API_ERROR)} AS errors""", {"avg_latency_ms": 6}),
    "api_series": Query(
        lambda x: H.api_series(x.points, **_ALL),
        " UNION ALL ".join(f"SELECT '{name}' AS metric, timestamp, value FROM ({_series(metric, fn, _OWN)})" for name, metric, fn in [
            ("requests", C.METRIC_API_REQUEST, "sum"), ("latency_ms", C.METRIC_API_LATENCY, "avg"), ("errors", C.METRIC_API_ERROR, "sum")]), VALUE),
    "ws_series": Query(
        lambda x: H.ws_series(x.points, **_ALL),
        " UNION ALL ".join(f"SELECT '{name}' AS metric, timestamp, value FROM ({_series(metric, fn, _OWN)})" for name, metric, fn in [
            ("connections", C.METRIC_WS_CONNECTIONS, "max"), ("sent", C.METRIC_WS_SENT, "sum")]), VALUE),
    "api_error_rate": Query(
        lambda x: H.api_error_rate(x.points, **_ALL),
        f"""SELECT *, errors / requests * 100 AS error_rate_pct, errors / requests * 100 > 1 AS high FROM (
            SELECT {_sum(C.METRIC_API_REQUEST)} AS requests, {_sum(C.METRIC_API_ERROR)} AS errors)""", {"error_rate_pct": 6}),
    "order_latency_by_venue": Query(
        lambda x: H.order_latency_by_venue(x.points, **_ALL),
        f"SELECT venue, m AS avg_latency_ms FROM ({_venue_mean(C.METRIC_ORDER_PLACE)}) WHERE venue IN ('hyperliquid', 'ostium')",
        {"avg_latency_ms": 6}),
    "order_latency_series": Query(
        lambda x: H.order_latency_series(x.points, **_ALL),
        "SELECT timestamp, value, venue AS dimension FROM (" + _series(
            C.METRIC_ORDER_PLACE, "avg", _VENUE + " AND venue IN ('hyperliquid', 'ostium')", keys="venue") + ")", VALUE),
    "order_action_latency": Query(
        lambda x: H.order_action_latency(x.points, **_ALL),
        f"SELECT {_mean(C.METRIC_ORDER_CANCEL)} AS avg_cancel_ms, {_mean(C.METRIC_WITHDRAW)} AS avg_withdraw_ms",
        {"avg_cancel_ms": 6, "avg_withdraw_ms": 6}),
    "bridge_health": Query(
        lambda x: H.bridge_health(x.points, **_ALL),
        f"""SELECT {_sum(C.METRIC_BRIDGE_SUCCESS)} AS successes, {_sum(C.METRIC_BRIDGE_FAILURE)} AS failures,
            {_mean(C.METRIC_BRIDGE_DURATION)} / 1000 AS avg_duration_s, {_mean(C.METRIC_BRIDGE_FILL)} / 1000 AS avg_fill_s""",
        {"avg_duration_s": 6, "avg_fill_s": 6}),
    "bridge_duration_series": Query(lambda x: H.bridge_duration_series(x.points, **_ALL),
                                    _series(C.METRIC_BRIDGE_DURATION, "avg", _OWN, scale=1000), FINE),
    "fund_router_health": Query(
        lambda x: H.fund_router_health(x.points, **_ALL),
        f"""SELECT {_mean(C.METRIC_ROUTE)} / 1000 AS avg_route_s, {_mean(C.METRIC_REVERSE_ROUTE)} / 1000 AS avg_reverse_s,
            {_sum(C.METRIC_SETTLE_TIMEOUT)} AS timeouts""", {"avg_route_s": 6, "avg_reverse_s": 6}),
    "fund_route_series": Query(lambda x: H.fund_route_series(x.points, **_ALL),
                               _series(C.METRIC_ROUTE, "avg", _OWN, scale=1000), FINE),
    "venue_health": Query(
        lambda x: H.venue_health(x.points, **_ALL),
        f"""SELECT s.venue, coalesce(l.m, 0) AS avg_read_ms, coalesce(e.n, 0) AS read_errors
            FROM (SELECT unnest(['hyperliquid', 'lighter', 'ostium']) AS venue) s LEFT JOIN ({_venue_mean(C.METRIC_VENUE_READ)}) l
            ON l.venue = s.venue LEFT JOIN (SELECT venue, CAST(trunc(sum(value)) AS BIGINT) AS n FROM {P}
            WHERE metric_name = '{C.METRIC_VENUE_ERROR}' AND {_VENUE} GROUP BY 1) e ON e.venue = s.venue""", {"avg_read_ms": 6}),
    "venue_latency_series": Query(
        lambda x: H.venue_latency_series(x.points, **_ALL),
        f"SELECT timestamp, value, venue AS dimension FROM ({_series(C.METRIC_VENUE_READ, 'avg', _VENUE, keys='venue')})", VALUE),
    "cache_hit_rate": Query(
        lambda x: H.cache_hit_rate(x.points, **_ALL),
        f"""SELECT *, hits / (hits + misses) * 100 AS hit_rate_pct FROM (
            SELECT {_sum(C.METRIC_CACHE_HIT)} AS hits, {_sum(C.METRIC_CACHE_MISS)} AS misses)""", {"hit_rate_pct": 6}),
    "cache_series": Query(
        lambda x: H.cache_series(x.points, **_ALL),
        f"""SELECT *, 'Hit' AS type FROM ({_series(C.METRIC_CACHE_HIT, 'sum', _OWN)})
            UNION ALL SELECT *, 'Miss' FROM ({_series(C.METRIC_CACHE_MISS, 'sum', _OWN)})""", {"value": 2}),
    "ws_health": Query(
        lambda x: H.ws_health(x.points, **_ALL),
        f"""SELECT *, peak_connections / 21000 * 100 AS capacity_pct, least(peak_connections / 21000 * 100, 100) AS capacity_bar_pct
            FROM (SELECT (SELECT CAST(trunc(max(value)) AS BIGINT) FROM {P} WHERE metric_name = '{C.METRIC_WS_CONNECTIONS}'
                AND {_OWN}) AS peak_connections, {_sum(C.METRIC_WS_SENT)} AS sent, {_sum(C.METRIC_WS_RECEIVED)} AS received,
                {_sum(C.METRIC_WS_SLOW)} AS slow_clients)""", {"capacity_pct": 6, "capacity_bar_pct": 6}),
    "signing_health": Query(
        lambda x: H.signing_health(x.points, **_ALL),
        f"""SELECT {_mean(C.METRIC_SIGNING)} AS avg_signing_ms, (SELECT count(DISTINCT {_bucket(300)}) FROM {P}
            WHERE metric_name = '{C.METRIC_SIGNING}' AND {_OWN}) AS signings""", {"avg_signing_ms": 6}),
    "snapshot_latency": Query(lambda x: H.snapshot_latency(x.points, **_ALL),
                              f"SELECT {_mean(C.METRIC_SNAPSHOT)} AS avg_snapshot_ms", {"avg_snapshot_ms": 6}),
    "fee_balance_series": Query(
        lambda x: H.fee_balance_series(x.points, **_ALL),
        f"SELECT *, CAST(0.005 AS DOUBLE) AS threshold, value < 0.005 AS low FROM ({_series(C.METRIC_FEE_BALANCE, 'min', _OWN)})"),
    "fee_balance_series_sol": Query(
        lambda x: H.fee_balance_series(x.points, threshold=C.SOL_BALANCE_ALARM, **_ALL),
        f"SELECT *, CAST({C.SOL_BALANCE_ALARM} AS DOUBLE) AS threshold, value < {C.SOL_BALANCE_ALARM} AS low FROM ({_series(C.METRIC_FEE_BALANCE, 'min', _OWN)})"),
    # --- alarms ---
    "scan_alarms": Query(lambda x: scan_alarms(x.alarms), 'SELECT "AlarmName", "StateValue", "AlarmDescription" FROM alarms'),
    "alarm_status": Query(
        lambda x: H.alarm_status(x.alarms),
        """SELECT "StateValue" AS state, "AlarmName" AS alarm, split_part("AlarmName", '-', -1) AS short_name,
            CASE WHEN "StateValue" = 'ALARM' THEN coalesce("AlarmDescription", 'No description') END AS description
            FROM alarms WHERE "StateValue" IN ('ALARM', 'OK')"""),
    "alarm_counts": Query(lambda x: H.alarm_counts(x.alarms),
                          'SELECT "StateValue" AS state, count(*) AS alarms FROM alarms GROUP BY 1'),
    # --- services ---
    "service_health": Query(
        lambda x: H.service_health(x.points, **_ALL),
        f"""SELECT service, upper(left(replace(service, '-', ' '), 1)) || lower(substr(replace(service, '-', ' '), 2)) AS label,
            avg_memory / {MB}.0::double AS avg_memory_mb, lim / {MB}.0::double AS limit_mb, avg_memory / lim * 100 AS memory_pct, requests,
            CASE WHEN n <= 2 THEN 'NO DATA' WHEN avg_memory / lim * 100 > 85 THEN 'CRITICAL'
                 WHEN avg_memory / lim * 100 > 70 THEN 'WARNING' ELSE 'HEALTHY' END AS status
            FROM (SELECT service, avg(v) AS avg_memory, count(*) AS n FROM (SELECT service, avg(value) AS v FROM {P}
                WHERE metric_name = '{C.METRIC_MEMORY}' GROUP BY service, {_bucket(300)}) GROUP BY 1) m
            LEFT JOIN (SELECT service, max(value) AS lim FROM {P} WHERE metric_name = '{C.METRIC_MEMORY_LIMIT}' GROUP BY 1) l USING (service)
            LEFT JOIN (SELECT service, CAST(trunc(sum(value)) AS BIGINT) AS requests FROM {P}
                WHERE metric_name = '{C.METRIC_HTTP_REQUESTS}' GROUP BY 1) r USING (service)""",
        {"avg_memory_mb": 12, "limit_mb": 12, "memory_pct": 6}),
    "service_memory": Query(
        lambda x: H.service_memory(x.points, **_ALL),
        f"""SELECT timestamp, value AS value_mb, service, lim / {MB}.0::double AS limit_mb
            FROM ({_service_series(C.METRIC_MEMORY, 'avg', MB)}) LEFT JOIN (SELECT service, max(value) AS lim FROM {P}
            WHERE metric_name = '{C.METRIC_MEMORY_LIMIT}' GROUP BY 1) USING (service)""", {"value_mb": 12, "limit_mb": 12}),
    "service_cpu_series": Query(lambda x: H.service_cpu_series(x.points, **_ALL), _service_series(C.METRIC_CPU, "avg"), VALUE),
    "service_http_series": Query(lambda x: H.service_http_series(x.points, **_ALL), _service_series(C.METRIC_HTTP_REQUESTS, "sum"), VALUE),
    "service_latency_series": Query(lambda x: H.service_latency_series(x.points, **_ALL), _service_series(C.METRIC_HTTP_LATENCY, "avg"), VALUE),
    "service_network_series": Query(lambda x: H.service_network_series(x.points, **_ALL),
                                    _service_series(C.METRIC_NETWORK_TX, "sum", 1024), FINE),
    "service_series": Query(
        lambda x: H.service_series(x.points, **_ALL),
        " UNION ALL ".join(f"SELECT '{name}' AS metric, service, timestamp, value FROM ({_service_series(metric, fn, scale)})"
                           for name, metric, fn, scale in [
                               ("cpu", C.METRIC_CPU, "avg", 1), ("http", C.METRIC_HTTP_REQUESTS, "sum", 1),
                               ("latency", C.METRIC_HTTP_LATENCY, "avg", 1), ("network_kb", C.METRIC_NETWORK_TX, "sum", 1024)]), FINE),
    # --- CDN ---
    "cdn_health": Query(
        lambda x: H.cdn_health(x.points, **_ALL),
        f"""SELECT *, avg_4xx_pct > 1 AS high_4xx, avg_5xx_pct > 0.5 AS high_5xx FROM (SELECT {_sum(C.METRIC_CDN_REQUESTS, _CDN)} AS requests,
            (SELECT sum(value) / {1024 ** 3}.0::double FROM {P} WHERE metric_name = '{C.METRIC_CDN_BYTES}' AND {_CDN}) AS served_gb,
            {_mean(C.METRIC_CDN_4XX, _CDN)} AS avg_4xx_pct, {_mean(C.METRIC_CDN_5XX, _CDN)} AS avg_5xx_pct,
            {_mean(C.METRIC_CDN_HIT_RATE, _CDN)} AS cache_hit_pct)""",
        {"served_gb": 15, "avg_4xx_pct": 6, "avg_5xx_pct": 6, "cache_hit_pct": 6}),
    "cdn_error_series": Query(
        lambda x: H.cdn_error_series(x.points, **_ALL),
        f"""SELECT *, '4xx' AS type FROM ({_series(C.METRIC_CDN_4XX, 'avg', _CDN)})
            UNION ALL SELECT *, '5xx' FROM ({_series(C.METRIC_CDN_5XX, 'avg', _CDN)})""", VALUE),
    "cdn_request_series": Query(lambda x: H.cdn_series(x.points, C.METRIC_CDN_REQUESTS, "Sum", **_ALL),
                                _series(C.METRIC_CDN_REQUESTS, "sum", _CDN), {"value": 2}),
    "cdn_megabytes_series": Query(
        lambda x: H.cdn_series(x.points, C.METRIC_CDN_BYTES, "Sum", scale=MB, **_ALL),
        _series(C.METRIC_CDN_BYTES, "sum", _CDN, scale=MB), FINE),
    "cdn_hit_rate_series": Query(lambda x: H.cdn_series(x.points, C.METRIC_CDN_HIT_RATE, "Average", **_ALL),
                                 _series(C.METRIC_CDN_HIT_RATE, "avg", _CDN), VALUE),
    # --- logs ---
    "scan_logs": Query(
        lambda x: scan_logs(x.logs, "app", 168, END).select("ts", "log_group", "message"),
        f"""SELECT {moment('ts')} AS ts, log_group, message FROM logs_raw WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29'"""),
    "parse_syslog": Query(
        lambda x: L.parse_syslog(x.logs).select("priority", "log_ts", "service", "body", "status", "path", "time", "method",
                                                "latency_ms", "endpoint", "in_mint", "out_mint"),
        """SELECT pri AS priority, log_ts, svc AS service, body, sc AS status, rawpath AS path, req_time AS time, method,
            latency AS latency_ms, endpoint, in_mint, out_mint FROM logs"""),
    "errors_by_service": Query(lambda x: L.errors_by_service(x.logs),
                               f"SELECT svc AS service, count(*) AS errors FROM logs WHERE {_ERR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "error_banner": Query(
        lambda x: L.error_banner(x.logs),
        f"""SELECT CAST(sum(errors) AS BIGINT) AS total_errors, first(service ORDER BY errors DESC, service) AS top_service,
            max(errors) AS top_errors FROM (SELECT svc AS service, count(*) AS errors FROM logs WHERE {_ERR} GROUP BY 1)"""),
    "errors_per_hour": Query(lambda x: L.errors_per_hour(x.logs), _hourly(_ERR)),
    "http_error_details": Query(lambda x: L.http_error_details(x.logs), _HTTP_DETAIL + _FIRST),
    "app_error_details": Query(lambda x: L.app_error_details(x.logs), _APP_DETAIL + _FIRST),
    "top_error_messages": Query(
        lambda x: L.top_error_messages(x.logs),
        f"""SELECT service, CASE WHEN detail IS NULL THEN '(unstructured)' WHEN length(detail) > 120 THEN left(detail, 120) || '...'
            ELSE detail END AS detail, count FROM (SELECT * FROM ({_HTTP_DETAIL}) UNION ALL SELECT * FROM ({_APP_DETAIL}))
            ORDER BY count DESC, service, detail LIMIT 25"""),
    "recent_errors": Query(
        lambda x: L.recent_errors(x.logs),
        f"SELECT log_ts AS time, svc AS service, body FROM logs WHERE {_ERR} ORDER BY ts DESC, message LIMIT 30"),
    "keyword_errors_per_hour": Query(lambda x: L.keyword_errors_per_hour(x.logs),
                                     _hourly("regexp_matches(message, '(?i)(error|exception|fatal|crash|ECONNREFUSED)')")),
    "keyword_errors_total": Query(
        lambda x: L.keyword_errors_total(x.logs),
        "SELECT count(*) AS errors FROM logs WHERE regexp_matches(message, '(?i)(error|exception|fatal|crash|ECONNREFUSED)')"),
    "swap_http_errors": Query(
        lambda x: L.swap_http_errors(x.logs),
        f"""SELECT *, 'HTTP ' || status || ' /' || coalesce(endpoint, '?') || CASE WHEN length(out_mint) > 10
            THEN ' → ' || left(out_mint, 6) || '...' || right(out_mint, 4) ELSE '' END AS label FROM (
            SELECT sc AS status, endpoint, out_mint, count(*) AS count FROM logs WHERE {_SWAP_FAILED}
            GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 20)"""),
    "swap_errors_per_hour": Query(lambda x: L.swap_errors_per_hour(x.logs), _hourly(_SWAP_FAILED)),
    "swap_recent_failures": Query(
        lambda x: L.swap_recent_failures(x.logs),
        f"""SELECT req_time AS time, sc AS status, method, endpoint, latency AS latency_ms, {_short('in_mint')} AS in_mint,
            {_short('out_mint')} AS out_mint FROM logs WHERE {_SWAP_FAILED} ORDER BY ts DESC, message LIMIT 25"""),
    "scraper_outcomes": Query(
        lambda x: L.scraper_outcomes(x.logs),
        r"""SELECT outcome, CASE outcome WHEN 'SIGNAL:' THEN 'Signals Generated' WHEN 'Not' THEN 'Rejected (Not Tradable)'
            WHEN 'Written' THEN 'Written to DB/Sheet' END AS label, count(*) AS count FROM (
            SELECT regexp_extract(message, '>>> (\S+)', 1) AS outcome FROM logs WHERE message LIKE '%twitter-scraper%')
            WHERE outcome IN ('SIGNAL:', 'Not', 'Written') GROUP BY 1"""),
    "scraper_signals": Query(
        lambda x: L.scraper_signals(x.logs),
        r"""SELECT ticker, direction, count(*) AS count, ticker || ' ' || direction AS label FROM (
            SELECT regexp_extract(message, '>>> SIGNAL: (\S+) (\S+)', 1) AS ticker,
                regexp_extract(message, '>>> SIGNAL: (\S+) (\S+)', 2) AS direction FROM logs
            WHERE message LIKE '%twitter-scraper%' AND message LIKE '%SIGNAL:%') GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15"""),
    "log_search": Query(
        lambda x: L.log_search(x.logs, service="payments", level="errors only", text="upstream"),
        f"""SELECT {moment('ts')} AS ts, message FROM logs WHERE message LIKE '%payments%' AND message LIKE '%upstream%'
            AND regexp_matches(message, '(?i)(error|exception|fatal|panic|crash|ECONNREFUSED|ETIMEDOUT)')
            ORDER BY logs.ts DESC, message LIMIT 200"""),
    # --- streams ---
    "stream_concurrent_users": Query(
        _stream_users,
        f"""SELECT {moment('b')} AS time_utc, viewers FROM (
            SELECT {_bucket(300)} AS b, count(DISTINCT wallet_address) AS viewers FROM ev GROUP BY 1)"""),
    "stream_metric_rollup": Query(
        _stream_rollup,
        f"""SELECT {moment('b')} AS timestamp, sum, average, minimum, maximum FROM (
            SELECT {_bucket(3600)} AS b, sum(value) AS sum, avg(value) AS average, min(value) AS minimum, max(value) AS maximum
            FROM points WHERE metric_name = '{C.METRIC_API_LATENCY}' AND {_OWN} GROUP BY 1)""", {"sum": 2, "average": 6}),
    "stream_errors_per_hour": Query(
        _stream_errors,
        f"""SELECT {moment('b')} AS hour, errors FROM (SELECT date_trunc('hour', ts) AS b, count(*) AS errors
            FROM logs WHERE {_ERR} GROUP BY 1)"""),
    "stream_time_to_trade": Query(_stream_times, TRADING["time_to_trade"].sql, TRADING["time_to_trade"].digits),
}
