"""Backend, service and CDN health from metric points.

Each result reads the points once: the metrics it needs are picked by name, rolled up per metric
and period, and the period rows are summarised. A mean is the unweighted mean of period means.
Common keyword arguments: `period` (seconds, default from the lookback), `hours` and `end` (the
lookback: 24 hours before now unless given; `hours=None` for all history), `namespace`, `exact_dims`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.frames import fill_spine, fixed_list
from ..functions.numbers import percent, whole
from ..functions.timestamps import bucket
from ..sources.metrics import (dim, metric_series, metric_series_by_dim, metric_series_by_service,
                               period_for, rollup, select_points, statistics)
from ..sources.tables import lookback_end

MB = 1024 * 1024
GB = 1024 * 1024 * 1024


def _backend(environment: str | None) -> dict[str, str]:
    return {} if environment is None else {C.DIM_ENVIRONMENT: environment}


def _periods(points: DataFrame, names: Sequence[str], dims: dict[str, str], by: Sequence[str] = (), *,
             period: int | None = None, hours: int | None = 24, end: str | None = None,
             namespace: str | None = None, exact_dims: bool = True, **keys: Column) -> DataFrame:
    chosen = select_points(points, names, dims=dims, by=by, hours=hours, end=end,
                           namespace=namespace, exact_dims=exact_dims)
    columns = [F.col("metric_name"), *[expr.alias(name) for name, expr in keys.items()]]
    return rollup(chosen, period or period_for(hours), *columns)


def _of(metric: str, stat: str) -> Column:
    return F.when(F.col("metric_name") == metric, F.col(stat))


def _sum(metric: str) -> Column:
    return whole(_of(metric, "Sum"))


def _mean(metric: str) -> Column:
    return F.avg(_of(metric, "Average"))


def _mean0(metric: str) -> Column:
    return F.coalesce(_mean(metric), F.lit(0.0))


# --- backend --------------------------------------------------------------------

def api_health(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    names = [C.METRIC_API_REQUEST, C.METRIC_API_LATENCY, C.METRIC_API_ERROR]
    return _periods(points, names, _backend(environment), **scope).agg(
        _sum(C.METRIC_API_REQUEST).alias("requests"), _mean0(C.METRIC_API_LATENCY).alias("avg_latency_ms"),
        _sum(C.METRIC_API_ERROR).alias("errors"))


def api_error_rate(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    sums = _periods(points, [C.METRIC_API_REQUEST, C.METRIC_API_ERROR], _backend(environment), **scope).agg(
        _sum(C.METRIC_API_REQUEST).alias("requests"), _sum(C.METRIC_API_ERROR).alias("errors"))
    rated = sums.withColumn("error_rate_pct", percent(F.col("errors"), F.col("requests")))
    return rated.withColumn("high", F.col("error_rate_pct") > C.ERROR_RATE_ALARM_PCT)


def api_series(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Requests, mean latency (ms) and errors per period, from one scan, with a `metric` label."""
    return _named_series(points, {C.METRIC_API_REQUEST: ("requests", "Sum"), C.METRIC_API_LATENCY: ("latency_ms", "Average"),
                                  C.METRIC_API_ERROR: ("errors", "Sum")}, environment, **scope)


def ws_series(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Active connections (highest) and messages sent per period, from one scan, with a `metric` label."""
    return _named_series(points, {C.METRIC_WS_CONNECTIONS: ("connections", "Maximum"), C.METRIC_WS_SENT: ("sent", "Sum")}, environment, **scope)


def _named_series(points: DataFrame, kinds: dict[str, tuple[str, str]], environment: str | None, **scope) -> DataFrame:
    label = value = F.when(F.lit(False), F.lit(None))
    for metric, (name, stat) in kinds.items():
        label, value = label.when(F.col("metric_name") == metric, F.lit(name)), value.when(F.col("metric_name") == metric, F.col(stat))
    return (_periods(points, list(kinds), _backend(environment), **scope)
            .select(label.alias("metric"), "timestamp", value.alias("value")).orderBy("metric", "timestamp"))


def order_latency_by_venue(points: DataFrame, *, venues: Sequence[str] = C.ORDER_VENUES,
                           environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Mean order placement latency of each listed venue, 0 without data."""
    per_venue = (_periods(points.where(dim(C.DIM_VENUE).isin(list(venues))), [C.METRIC_ORDER_PLACE],
                          _backend(environment), [C.DIM_VENUE], venue=dim(C.DIM_VENUE), **scope)
                 .groupBy("venue").agg(F.avg("Average").alias("avg_latency_ms")))
    spine = fixed_list(points.sparkSession, "venue", list(venues)).drop("step")
    return fill_spine(spine, per_venue, "venue", avg_latency_ms=0.0).orderBy("venue")


def order_latency_series(points: DataFrame, *, venues: Sequence[str] = C.ORDER_VENUES,
                         environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    return metric_series_by_dim(points, C.METRIC_ORDER_PLACE, C.DIM_VENUE, venues, "Average",
                                dims=_backend(environment), **scope)


def order_action_latency(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Mean cancel and withdraw latency, null without data."""
    return _periods(points, [C.METRIC_ORDER_CANCEL, C.METRIC_WITHDRAW], _backend(environment), **scope).agg(
        _mean(C.METRIC_ORDER_CANCEL).alias("avg_cancel_ms"), _mean(C.METRIC_WITHDRAW).alias("avg_withdraw_ms"))


def bridge_health(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    names = [C.METRIC_BRIDGE_SUCCESS, C.METRIC_BRIDGE_FAILURE, C.METRIC_BRIDGE_DURATION, C.METRIC_BRIDGE_FILL]
    return _periods(points, names, _backend(environment), **scope).agg(
        _sum(C.METRIC_BRIDGE_SUCCESS).alias("successes"), _sum(C.METRIC_BRIDGE_FAILURE).alias("failures"),
        (_mean0(C.METRIC_BRIDGE_DURATION) / 1000).alias("avg_duration_s"),
        (_mean0(C.METRIC_BRIDGE_FILL) / 1000).alias("avg_fill_s"))


def _scaled(series: DataFrame, factor: float) -> DataFrame:
    return series.withColumn("value", F.col("value") / factor)


def bridge_duration_series(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Mean bridge duration per period, in seconds."""
    return _scaled(metric_series(points, C.METRIC_BRIDGE_DURATION, "Average", dims=_backend(environment), **scope), 1000)


def fund_router_health(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    names = [C.METRIC_ROUTE, C.METRIC_REVERSE_ROUTE, C.METRIC_SETTLE_TIMEOUT]
    return _periods(points, names, _backend(environment), **scope).agg(
        (_mean(C.METRIC_ROUTE) / 1000).alias("avg_route_s"), (_mean(C.METRIC_REVERSE_ROUTE) / 1000).alias("avg_reverse_s"),
        _sum(C.METRIC_SETTLE_TIMEOUT).alias("timeouts"))


def fund_route_series(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Mean route latency per period, in seconds."""
    return _scaled(metric_series(points, C.METRIC_ROUTE, "Average", dims=_backend(environment), **scope), 1000)


def venue_health(points: DataFrame, *, venues: Sequence[str] = C.READ_VENUES,
                 environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Mean read latency and summed read errors of each listed venue."""
    per_venue = (_periods(points.where(dim(C.DIM_VENUE).isin(list(venues))),
                          [C.METRIC_VENUE_READ, C.METRIC_VENUE_ERROR], _backend(environment), [C.DIM_VENUE],
                          venue=dim(C.DIM_VENUE), **scope)
                 .groupBy("venue").agg(_mean(C.METRIC_VENUE_READ).alias("avg_read_ms"),
                                       _sum(C.METRIC_VENUE_ERROR).alias("read_errors")))
    spine = fixed_list(points.sparkSession, "venue", list(venues)).drop("step")
    return fill_spine(spine, per_venue, "venue", avg_read_ms=0.0, read_errors=0).orderBy("venue")


def venue_latency_series(points: DataFrame, *, venues: Sequence[str] = C.READ_VENUES,
                         environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    return metric_series_by_dim(points, C.METRIC_VENUE_READ, C.DIM_VENUE, venues, "Average",
                                dims=_backend(environment), **scope)


def cache_hit_rate(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    sums = _periods(points, [C.METRIC_CACHE_HIT, C.METRIC_CACHE_MISS], _backend(environment), **scope).agg(
        _sum(C.METRIC_CACHE_HIT).alias("hits"), _sum(C.METRIC_CACHE_MISS).alias("misses"))
    return sums.withColumn("hit_rate_pct", percent(F.col("hits"), F.col("hits") + F.col("misses")))


def _typed_series(points: DataFrame, labels: dict[str, str], stat: str, dims: dict[str, str], **scope) -> DataFrame:
    """Several metrics as one series with a `type` label, from one scan."""
    label = F.when(F.lit(False), F.lit(""))
    for metric, name in labels.items():
        label = label.when(F.col("metric_name") == metric, name)
    return (_periods(points, list(labels), dims, **scope)
            .select("timestamp", F.col(stat).alias("value"), label.alias("type")).orderBy("type", "timestamp"))


def cache_series(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    labels = {C.METRIC_CACHE_HIT: "Hit", C.METRIC_CACHE_MISS: "Miss"}
    return _typed_series(points, labels, "Sum", _backend(environment), **scope)


def ws_health(points: DataFrame, *, capacity: int = C.WS_CAPACITY,
              environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Peak connections, messages, slow clients, and the share of capacity (bar value capped at 100)."""
    names = [C.METRIC_WS_CONNECTIONS, C.METRIC_WS_SENT, C.METRIC_WS_RECEIVED, C.METRIC_WS_SLOW]
    peak = F.coalesce(F.max(_of(C.METRIC_WS_CONNECTIONS, "Maximum")).cast("bigint"), F.lit(0))
    sums = _periods(points, names, _backend(environment), **scope).agg(
        peak.alias("peak_connections"), _sum(C.METRIC_WS_SENT).alias("sent"),
        _sum(C.METRIC_WS_RECEIVED).alias("received"), _sum(C.METRIC_WS_SLOW).alias("slow_clients"))
    return (sums.withColumn("capacity_pct", percent(F.col("peak_connections"), F.lit(capacity)))
            .withColumn("capacity_bar_pct", F.least("capacity_pct", F.lit(100.0))))


def signing_health(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Mean signing latency and the number of data points (periods), which stands for signings."""
    return _periods(points, [C.METRIC_SIGNING], _backend(environment), **scope).agg(
        _mean(C.METRIC_SIGNING).alias("avg_signing_ms"), F.count("*").alias("signings"))


def snapshot_latency(points: DataFrame, *, environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    return _periods(points, [C.METRIC_SNAPSHOT], _backend(environment), **scope).agg(
        _mean(C.METRIC_SNAPSHOT).alias("avg_snapshot_ms"))


def fee_balance_series(points: DataFrame, *, threshold: float = C.ETH_BALANCE_ALARM,
                       metric: str = C.METRIC_FEE_BALANCE,
                       environment: str | None = C.BACKEND_ENVIRONMENT, **scope) -> DataFrame:
    """Lowest fee balance per period with the alarm line and a low flag."""
    series = metric_series(points, metric, "Minimum", dims=_backend(environment), **scope)
    return series.withColumns({"threshold": F.lit(float(threshold)), "low": F.col("value") < threshold})


# --- alarms ---------------------------------------------------------------------

def alarm_status(alarms: DataFrame) -> DataFrame:
    """Firing alarms with their description, and OK alarms with the last part of their name."""
    state = F.col("StateValue")
    return (alarms.where(state.isin("ALARM", "OK"))
            .select(state.alias("state"), F.col("AlarmName").alias("alarm"),
                    F.element_at(F.split("AlarmName", "-"), -1).alias("short_name"),
                    F.when(state == "ALARM", F.coalesce("AlarmDescription", F.lit("No description"))).alias("description"))
            .orderBy("state", "alarm"))


def alarm_counts(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy(F.col("StateValue").alias("state")).agg(F.count("*").alias("alarms")).orderBy("state")


# --- services -------------------------------------------------------------------

def service_health(points: DataFrame, *, period: int | None = None, hours: int | None = 24, end: str | None = None,
                   namespace: str | None = None, exact_dims: bool = True,
                   discovery_hours: int | None = 336) -> DataFrame:
    """Memory, memory limit, requests and a status for every service that reports memory.

    Services are those with a memory point in the discovery time (two weeks by default, all history with
    None), so a service that fell silent within the lookback shows as NO DATA, and one silent for
    longer than the discovery time is not listed. Points before the lookback fold to one row per service and metric.
    """
    names = [C.METRIC_MEMORY, C.METRIC_MEMORY_LIMIT, C.METRIC_HTTP_REQUESTS]
    reach = None if hours is None or discovery_hours is None else max(hours, discovery_hours)
    chosen = select_points(points, names, by=[C.DIM_SERVICE], hours=reach, end=end,
                           namespace=namespace, exact_dims=exact_dims)
    recent = F.lit(True) if hours is None else F.col("ts") >= lookback_end(end) - F.make_dt_interval(hours=F.lit(hours))
    start = F.when(recent, bucket(F.col("ts"), period or period_for(hours)))
    periods = chosen.groupBy("metric_name", dim(C.DIM_SERVICE).alias("service"), start.alias("timestamp")).agg(
        *[column.alias(stat) for stat, column in statistics(chosen).items()]).withColumn("recent", F.col("timestamp").isNotNull())
    now = lambda metric, stat: F.when(F.col("recent"), _of(metric, stat))
    per_service = periods.groupBy("service").agg(
        F.coalesce(F.avg(now(C.METRIC_MEMORY, "Average")), F.lit(0.0)).alias("avg_memory"),
        F.coalesce(F.max(now(C.METRIC_MEMORY_LIMIT, "Maximum")), F.lit(0.0)).alias("memory_limit"),
        whole(now(C.METRIC_HTTP_REQUESTS, "Sum")).alias("requests"),
        F.count(now(C.METRIC_MEMORY, "Average")).alias("points"),
        F.bool_or(F.col("metric_name") == C.METRIC_MEMORY).alias("_reports"))
    used = F.when(F.col("memory_limit") > 0, percent(F.col("avg_memory"), F.col("memory_limit"))).otherwise(0.0)
    status = (F.when(F.col("points") < C.MIN_HEALTH_POINTS, "NO DATA")
              .when(F.col("memory_pct") > C.MEMORY_CRITICAL_PCT, "CRITICAL")
              .when(F.col("memory_pct") > C.MEMORY_WARNING_PCT, "WARNING")
              .otherwise("HEALTHY"))
    return (per_service.where("_reports").withColumn("memory_pct", used)
            .select("service", F.initcap(F.replace(F.col("service"), F.lit("-"), F.lit(" "))).alias("label"),
                    (F.col("avg_memory") / MB).alias("avg_memory_mb"), (F.col("memory_limit") / MB).alias("limit_mb"),
                    "memory_pct", "requests", status.alias("status")).orderBy("service"))


def service_memory(points: DataFrame, **scope) -> DataFrame:
    """Memory per service and period in MB, with the service's highest limit.

    The window runs over period rows (at most one per metric and period), not over points.
    """
    periods = _periods(points, [C.METRIC_MEMORY, C.METRIC_MEMORY_LIMIT], {}, [C.DIM_SERVICE],
                       service=dim(C.DIM_SERVICE), **scope)
    limit = F.max(_of(C.METRIC_MEMORY_LIMIT, "Maximum")).over(Window.partitionBy("service"))
    return (periods.withColumn("limit_mb", limit / MB).where(F.col("metric_name") == C.METRIC_MEMORY)
            .select("timestamp", (F.col("Average") / MB).alias("value_mb"), "service", "limit_mb")
            .orderBy("service", "timestamp"))


def service_cpu_series(points: DataFrame, **scope) -> DataFrame:
    return metric_series_by_service(points, C.METRIC_CPU, "Average", **scope)


def service_http_series(points: DataFrame, **scope) -> DataFrame:
    return metric_series_by_service(points, C.METRIC_HTTP_REQUESTS, "Sum", **scope)


def service_latency_series(points: DataFrame, **scope) -> DataFrame:
    return metric_series_by_service(points, C.METRIC_HTTP_LATENCY, "Average", **scope)


def service_network_series(points: DataFrame, **scope) -> DataFrame:
    """Bytes sent per service and period, in KB."""
    return _scaled(metric_series_by_service(points, C.METRIC_NETWORK_TX, "Sum", **scope), 1024)


def service_series(points: DataFrame, **scope) -> DataFrame:
    """CPU, requests, latency and network (KB) of every service, from one scan, with a `metric` label."""
    kinds = {C.METRIC_CPU: ("cpu", F.col("Average")), C.METRIC_HTTP_REQUESTS: ("http", F.col("Sum")),
             C.METRIC_HTTP_LATENCY: ("latency", F.col("Average")), C.METRIC_NETWORK_TX: ("network_kb", F.col("Sum") / 1024)}
    label = value = F.when(F.lit(False), F.lit(None))
    for metric, (name, stat) in kinds.items():
        label = label.when(F.col("metric_name") == metric, F.lit(name))
        value = value.when(F.col("metric_name") == metric, stat)
    return (_periods(points, list(kinds), {}, [C.DIM_SERVICE], service=dim(C.DIM_SERVICE), **scope)
            .select(label.alias("metric"), "service", "timestamp", value.alias("value"))
            .orderBy("metric", "service", "timestamp"))


# --- CDN ------------------------------------------------------------------------

def _of_distribution(points: DataFrame, names: Sequence[str], distribution: str | None, **scope) -> DataFrame:
    """Period rows of the given distribution, or of the first one by name that reports requests in the lookback.

    The first one is found among the period rows of the same scan.
    """
    own = points.where(dim(C.DIM_REGION) == C.CDN_REGION)
    if distribution is not None:
        return _periods(own.where(dim(C.DIM_DISTRIBUTION) == distribution), names, {}, [C.DIM_DISTRIBUTION, C.DIM_REGION], **scope)
    wanted = list(dict.fromkeys([*names, C.METRIC_CDN_REQUESTS]))
    periods = _periods(own, wanted, {}, [C.DIM_DISTRIBUTION, C.DIM_REGION], distribution=dim(C.DIM_DISTRIBUTION), **scope)
    first = periods.where(F.col("metric_name") == C.METRIC_CDN_REQUESTS).agg(F.min("distribution")).scalar()
    return periods.where(F.col("metric_name").isin(list(names)) & (F.col("distribution") == first))


def cdn_health(points: DataFrame, *, distribution: str | None = None, **scope) -> DataFrame:
    """Requests, GB served, mean error and cache-hit rates, and the two alarm flags."""
    names = [C.METRIC_CDN_REQUESTS, C.METRIC_CDN_BYTES, C.METRIC_CDN_4XX, C.METRIC_CDN_5XX, C.METRIC_CDN_HIT_RATE]
    sums = _of_distribution(points, names, distribution, **scope).agg(
        _sum(C.METRIC_CDN_REQUESTS).alias("requests"),
        (F.coalesce(F.sum(_of(C.METRIC_CDN_BYTES, "Sum")), F.lit(0.0)) / GB).alias("served_gb"),
        _mean0(C.METRIC_CDN_4XX).alias("avg_4xx_pct"), _mean0(C.METRIC_CDN_5XX).alias("avg_5xx_pct"),
        _mean0(C.METRIC_CDN_HIT_RATE).alias("cache_hit_pct"))
    return (sums.withColumn("high_4xx", F.col("avg_4xx_pct") > C.CDN_4XX_ALARM_PCT)
            .withColumn("high_5xx", F.col("avg_5xx_pct") > C.CDN_5XX_ALARM_PCT))


def cdn_error_series(points: DataFrame, *, distribution: str | None = None, **scope) -> DataFrame:
    """4xx and 5xx rates per period."""
    label = F.when(F.col("metric_name") == C.METRIC_CDN_4XX, "4xx").otherwise("5xx")
    return (_of_distribution(points, [C.METRIC_CDN_4XX, C.METRIC_CDN_5XX], distribution, **scope)
            .select("timestamp", F.col("Average").alias("value"), label.alias("type")).orderBy("type", "timestamp"))


def cdn_series(points: DataFrame, metric: str, stat: str, *, distribution: str | None = None,
               scale: float = 1.0, **scope) -> DataFrame:
    """One CDN metric per period (requests, megabytes with scale=MB, cache-hit rate)."""
    periods = _of_distribution(points, [metric], distribution, **scope)
    return periods.select("timestamp", (F.col(stat) / scale).alias("value")).orderBy("timestamp")
