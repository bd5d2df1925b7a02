from datetime import datetime, timedelta

import pytest

from pulsegrid import constants as C
from pulsegrid.operators import health as H
from pulsegrid.sources import log_hours, metric_dim_values, metric_series, metric_series_by_dim, metric_series_by_service, period_for

SCHEMA = "ts timestamp_ntz, namespace string, metric_name string, value double, dims map<string,string>"
T0 = datetime(2024, 1, 1)
DEV = {"Environment": "development"}
ALL = dict(hours=None, period=300)
MB = 1024 * 1024


def points(frame, *data):
    """(minute offset, metric, value, dims) items."""
    return frame(SCHEMA, [(T0 + timedelta(minutes=m), "ns", name, float(v), d) for m, name, v, d in data])


def test_period_rule():
    assert [period_for(h) for h in (1, 24, 25, 72, 73, 168)] == [300, 300, 900, 900, 3600, 3600]
    assert [log_hours(h) for h in (1, 24, 168)] == [1, 24, 24]


def test_series_buckets_statistics_and_lookback(frame, rows):
    p = points(frame, (0, "m", 1, {}), (4, "m", 3, {}), (5, "m", 10, None), (61, "m", 7, {}), (0, "other", 99, {}))
    for stat, first in (("Sum", 4.0), ("Average", 2.0), ("Minimum", 1.0), ("Maximum", 3.0)):
        got = rows(metric_series(p, "m", stat, **ALL))
        assert got[0] == {"timestamp": T0, "value": first} and [g["value"] for g in got[1:]] == [10.0, 7.0]
    # The end is exclusive, the start inclusive.
    got = rows(metric_series(p, "m", "Sum", hours=1, end="2024-01-01 01:05:00"))
    assert [g["value"] for g in got] == [10.0, 7.0]
    assert metric_series(p, "m", "Sum", namespace="elsewhere", **ALL).count() == 0
    with pytest.raises(ValueError):
        metric_series(p, "m", "Median")


def test_a_series_is_one_exact_set_of_dimensions(frame, rows):
    p = points(frame, (0, "m", 1, DEV), (0, "m", 5, {**DEV, "Venue": "v"}), (0, "m", 50, {"Environment": "production"}))
    assert rows(metric_series(p, "m", "Sum", dims=DEV, **ALL))[0]["value"] == 1.0
    assert rows(metric_series(p, "m", "Sum", dims=DEV, exact_dims=False, **ALL))[0]["value"] == 6.0
    assert rows(metric_series_by_dim(p, "m", "Venue", ["v", "w"], dims=DEV, **ALL)) == [{"timestamp": T0, "value": 5.0, "dimension": "v"}]
    assert [r["value"] for r in rows(metric_dim_values(p, "m", "Environment", hours=None))] == ["development", "production"]


def test_by_service_needs_no_list(frame, rows):
    p = points(frame, (0, "m", 1, {"service.name": "b"}), (0, "m", 2, {"service.name": "a"}), (0, "m", 3, {}))
    assert [(r["service"], r["value"]) for r in rows(metric_series_by_service(p, "m", **ALL))] == [("a", 2.0), ("b", 1.0)]


def test_mean_is_a_mean_of_period_means(frame, rows):
    p = points(frame, (0, C.METRIC_API_LATENCY, 10, DEV), (1, C.METRIC_API_LATENCY, 20, DEV), (1, C.METRIC_API_LATENCY, 30, DEV), (10, C.METRIC_API_LATENCY, 100, DEV),
               (0, C.METRIC_API_REQUEST, 100, DEV), (0, C.METRIC_API_ERROR, 2.9, DEV))
    assert rows(H.api_health(p, **ALL)) == [{"requests": 100, "avg_latency_ms": 60.0, "errors": 2}]
    assert rows(H.api_error_rate(p, **ALL)) == [{"requests": 100, "errors": 2, "error_rate_pct": 2.0, "high": True}]
    assert rows(H.signing_health(points(frame, (0, C.METRIC_SIGNING, 1, DEV), (1, C.METRIC_SIGNING, 3, DEV), (9, C.METRIC_SIGNING, 5, DEV)), **ALL)) == [
        {"avg_signing_ms": 3.5, "signings": 2}]


def test_without_points(frame, rows):
    p = points(frame, (0, "unrelated", 1, DEV))
    assert rows(H.api_health(p, **ALL)) == [{"requests": 0, "avg_latency_ms": 0.0, "errors": 0}]
    assert rows(H.api_error_rate(p, **ALL))[0]["error_rate_pct"] == 0.0
    assert rows(H.order_action_latency(p, **ALL)) == [{"avg_cancel_ms": None, "avg_withdraw_ms": None}]
    assert rows(H.fund_router_health(p, **ALL)) == [{"avg_route_s": None, "avg_reverse_s": None, "timeouts": 0}]
    assert rows(H.bridge_health(p, **ALL)) == [{"successes": 0, "failures": 0, "avg_duration_s": 0.0, "avg_fill_s": 0.0}]
    assert rows(H.cache_hit_rate(p, **ALL))[0]["hit_rate_pct"] == 0.0
    assert [r["avg_latency_ms"] for r in rows(H.order_latency_by_venue(p, **ALL))] == [0.0, 0.0]
    assert [(r["venue"], r["read_errors"]) for r in rows(H.venue_health(p, **ALL))] == [("hyperliquid", 0), ("lighter", 0), ("ostium", 0)]
    assert rows(H.ws_health(p, **ALL))[0]["peak_connections"] == 0
    assert H.service_health(p, **ALL).count() == 0
    assert rows(H.cdn_health(p, **ALL))[0]["requests"] == 0


def test_capacity_bar_is_clipped(frame, rows):
    p = points(frame, (0, C.METRIC_WS_CONNECTIONS, 42000.7, DEV), (0, C.METRIC_WS_SENT, 5, DEV))
    got = rows(H.ws_health(p, **ALL))[0]
    assert (got["peak_connections"], got["capacity_pct"], got["capacity_bar_pct"], got["sent"]) == (42000, 200.0, 100.0, 5)


def test_fee_balance_flag(frame, rows):
    p = points(frame, (0, C.METRIC_FEE_BALANCE, 0.006, DEV), (1, C.METRIC_FEE_BALANCE, 0.004, DEV), (10, C.METRIC_FEE_BALANCE, 0.005, DEV))
    assert [(r["value"], r["low"]) for r in rows(H.fee_balance_series(p, **ALL))] == [(0.004, True), (0.005, False)]


def test_service_status(frame, rows):
    def service(name, used, limit, n=3):
        d = {"service.name": name}
        return [(10 * i, C.METRIC_MEMORY, used * MB, d) for i in range(n)] + ([(0, C.METRIC_MEMORY_LIMIT, limit * MB, d)] if limit else [])
    p = points(frame, *service("a-crit", 86, 100), *service("b-warn", 71, 100), *service("c-ok", 70, 100), *service("d-few", 99, 100, 2), *service("e-nolimit", 50, None),
               (0, C.METRIC_HTTP_REQUESTS, 5, {"service.name": "a-crit"}), (0, C.METRIC_HTTP_REQUESTS, 5, {"service.name": "http-only"}))
    got = {r["service"]: r for r in rows(H.service_health(p, **ALL))}
    assert {k: v["status"] for k, v in got.items()} == {"a-crit": "CRITICAL", "b-warn": "WARNING", "c-ok": "HEALTHY", "d-few": "NO DATA", "e-nolimit": "HEALTHY"}
    assert got["a-crit"]["requests"] == 5 and got["a-crit"]["label"] == "A Crit" and got["e-nolimit"]["memory_pct"] == 0.0
    # A service that fell silent before the lookback is still listed.
    late = {r["service"]: r["status"] for r in rows(H.service_health(p, hours=1, end="2024-01-02 00:00:00"))}
    assert set(late.values()) == {"NO DATA"} and len(late) == 5


def test_first_distribution_is_used(frame, rows):
    d = lambda i: {"DistributionId": i, "Region": "Global"}
    p = points(frame, (0, "Requests", 5, d("E2")), (0, "Requests", 7, d("E1")), (0, "4xxErrorRate", 2, d("E1")), (0, "5xxErrorRate", 0.5, d("E1")), (0, "4xxErrorRate", 9, d("E2")))
    got = rows(H.cdn_health(p, **ALL))[0]
    assert (got["requests"], got["avg_4xx_pct"], got["high_4xx"], got["high_5xx"]) == (7, 2.0, True, False)
    assert rows(H.cdn_health(p, distribution="E2", **ALL))[0]["requests"] == 5
    assert [(r["type"], r["value"]) for r in rows(H.cdn_error_series(p, **ALL))] == [("4xx", 2.0), ("5xx", 0.5)]


def test_alarms(frame, rows):
    a = frame("AlarmName string, StateValue string, AlarmDescription string", [("x-cpu", "OK", "d"), ("x-gas", "ALARM", None), ("x-ws", "ALARM", "high"), ("y", "INSUFFICIENT_DATA", None)])
    assert rows(H.alarm_status(a)) == [
        {"state": "ALARM", "alarm": "x-gas", "short_name": "gas", "description": "No description"},
        {"state": "ALARM", "alarm": "x-ws", "short_name": "ws", "description": "high"},
        {"state": "OK", "alarm": "x-cpu", "short_name": "cpu", "description": None}]
    assert {r["state"]: r["alarms"] for r in rows(H.alarm_counts(a))} == {"ALARM": 2, "OK": 1, "INSUFFICIENT_DATA": 1}


def test_lookback_ends_now_unless_told(frame, rows, spark):
    now = spark.sql("SELECT cast(current_timestamp() AS timestamp_ntz) AS t").first()["t"]
    p = frame(SCHEMA, [(now - timedelta(minutes=m), "ns", "m", 1.0, {}) for m in (10, 50, 90)])
    assert sum(r["value"] for r in rows(metric_series(p, "m", "Sum", hours=1))) == 2.0
    assert sum(r["value"] for r in rows(metric_series(p, "m", "Sum", hours=None))) == 3.0


def test_points_before_the_lookback_name_services_only(frame, rows):
    p = points(frame, (0, C.METRIC_MEMORY, 5, {C.DIM_SERVICE: "old"}), *[(24 * 60 + 5 * i, C.METRIC_MEMORY, 5, {C.DIM_SERVICE: "new"}) for i in range(4)])
    got = {r["service"]: r["status"] for r in rows(H.service_health(p, hours=1, end="2024-01-02 00:30:00"))}
    assert got == {"old": "NO DATA", "new": "HEALTHY"}
    assert {r["service"] for r in rows(H.service_health(p, hours=1, end="2024-01-20 00:00:00"))} == set()
    assert len(rows(H.service_health(p, hours=1, end="2024-01-20 00:00:00", discovery_hours=None))) == 2


def test_named_series(frame, rows):
    p = points(frame, (0, C.METRIC_API_REQUEST, 3, DEV), (1, C.METRIC_API_LATENCY, 40, DEV), (2, C.METRIC_WS_CONNECTIONS, 9, DEV))
    assert [(r["metric"], r["value"]) for r in rows(H.api_series(p, **ALL))] == [("latency_ms", 40.0), ("requests", 3.0)]
    assert [(r["metric"], r["value"]) for r in rows(H.ws_series(p, **ALL))] == [("connections", 9.0)]
