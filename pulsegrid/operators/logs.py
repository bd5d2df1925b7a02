"""Error analytics over syslog lines `<pri>1 TS service proc pid msgid - body`.

`logs` is (ts, message). Text marks are plain substring tests before any pattern is applied, and
each pattern is applied only to rows that passed them. Labels are kept even where a field is
missing, so rows without a service or detail are counted too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.frames import top
from ..functions.timestamps import bucket
from ..functions.wallets import short_token


def _capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A captured group of the first match, for groups that are never empty; null where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _captured_int(text: Column, pattern: str, dtype: str = "int") -> Column:
    """A captured whole number; no match gives '', which is no number and so null."""
    return F.regexp_extract(text, pattern, 1).try_cast(dtype)


def priority(message: Column) -> Column:
    return _captured_int(message, C.PRIORITY_PATTERN)


def body(message: Column) -> Column:
    """The text after the header, which may be empty; null where the header has another form."""
    return F.get(F.regexp_extract_all(message, F.lit(C.LINE_PATTERN), F.lit(2)), F.lit(0))


def parse_syslog(logs: DataFrame) -> DataFrame:
    """All fields of a line: header, HTTP access fields, tokens of the query string."""
    text = F.col("message")
    parsed = logs.withColumns({
        "priority": priority(text),
        "service": _capture(text, C.SERVICE_PATTERN),
        "body": body(text),
    })
    line = F.col("body")
    # The whole header is matched once, for the body; the time is then the first token after the version.
    parsed = parsed.withColumn("log_ts", F.when(line.isNotNull(), _capture(text, C.LOG_TIME_PATTERN)))
    parsed = parsed.withColumns({
        "status": _captured_int(line, C.STATUS_PATTERN),
        "path": _capture(line, C.PATH_PATTERN),
        "time": _capture(line, C.TIME_PATTERN),
        "method": _capture(line, C.METHOD_PATTERN),
        "latency_ms": _captured_int(line, C.LATENCY_PATTERN, "bigint"),
    })
    path = F.col("path")
    return parsed.withColumns({
        "endpoint": _capture(path, C.ENDPOINT_PATTERN),
        "in_mint": _capture(path, C.IN_MINT_PATTERN),
        "out_mint": _capture(path, C.OUT_MINT_PATTERN),
    })


def _errors(logs: DataFrame) -> DataFrame:
    return logs.where(priority(F.col("message")) <= C.ERROR_PRIORITY)


def _per_hour(logs: DataFrame) -> DataFrame:
    return logs.groupBy(bucket(F.col("ts"), 3600).alias("hour")).agg(F.count("*").alias("errors"))


def _newest(logs: DataFrame, k: int) -> DataFrame:
    """The k latest lines. The k rows are one partition already; coalesce(1) keeps what is
    computed on them from being moved below the limit, which would turn the top-k into a sort."""
    return logs.select("ts", "message").orderBy(F.desc("ts"), "message").limit(k).coalesce(1)


def _service_counts(logs: DataFrame) -> DataFrame:
    return (_errors(logs).groupBy(_capture(F.col("message"), C.SERVICE_PATTERN).alias("service"))
            .agg(F.count("*").alias("errors")))


def errors_by_service(logs: DataFrame, *, k: int = 15) -> DataFrame:
    return top(_service_counts(logs), k, "errors", "service")


def error_banner(logs: DataFrame) -> DataFrame:
    """Errors of all services, and the worst service; among equals the first named one."""
    worst = F.min_by(F.struct("service", "errors"), F.struct(-F.col("errors"), F.col("service").isNull(), "service"))
    return (_service_counts(logs).agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"), worst.alias("_worst"))
            .select("total_errors", F.col("_worst.service").alias("top_service"),
                    F.col("_worst.errors").alias("top_errors")))


def errors_per_hour(logs: DataFrame) -> DataFrame:
    return _per_hour(_errors(logs)).orderBy("hour")


def _details(errors: DataFrame) -> DataFrame:
    """Every error by kind, service and detail, from one pass.

    Failed requests show "HTTP status /endpoint" (other requests are left out), all other lines their text.
    """
    text = F.col("message")
    is_http = text.contains(C.HTTP_MARK)
    lines = errors.select(is_http.alias("is_http"), body(text).alias("body"), _capture(text, C.SERVICE_PATTERN).alias("service"))
    status = F.when(F.col("is_http"), _captured_int(F.col("body"), C.STATUS_PATTERN))
    lines = lines.withColumn("status", status).where(~F.col("is_http") | (F.col("status") >= 400))
    endpoint = _capture(_capture(F.col("body"), C.PATH_PATTERN), C.ENDPOINT_PATTERN)
    request = F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" /"), endpoint)
    service = F.when(F.col("is_http") | F.col("body").isNotNull(), F.col("service"))
    return (lines.groupBy("is_http", service.alias("service"), F.when(F.col("is_http"), request).otherwise(F.col("body")).alias("detail"))
            .agg(F.count("*").alias("count")))


def http_error_details(logs: DataFrame, *, k: int | None = 15) -> DataFrame:
    """Failed requests among the errors, by service and "HTTP status /endpoint"."""
    counts = _details(_errors(logs.where(F.col("message").contains(C.HTTP_MARK)))).drop("is_http")
    return counts if k is None else top(counts, k, "count", "service", "detail")


def app_error_details(logs: DataFrame, *, k: int | None = 15) -> DataFrame:
    """All other errors, by service and text."""
    counts = _details(_errors(logs.where(~F.col("message").contains(C.HTTP_MARK)))).drop("is_http")
    return counts if k is None else top(counts, k, "count", "service", "detail")


def clean_detail(detail: Column) -> Column:
    """Missing as "(unstructured)"; long text cut with dots (the cut is the display rule)."""
    shown = F.concat(F.left(detail, F.lit(C.DETAIL_LIMIT)), F.lit("..."))
    return F.coalesce(F.when(F.length(detail) > C.DETAIL_LIMIT, shown).otherwise(detail), F.lit(C.UNSTRUCTURED))


def top_error_messages(logs: DataFrame, *, k: int = 25) -> DataFrame:
    """All details of both kinds as one list, most frequent first, cleaned for display. The log is read once."""
    return (top(_details(_errors(logs)), k, "count", "service", "detail", "is_http")
            .select("service", clean_detail(F.col("detail")).alias("detail"), "count"))


def recent_errors(logs: DataFrame, *, k: int = 30) -> DataFrame:
    newest = _newest(_errors(logs), k)
    parsed = parse_syslog(newest)
    matched = F.col("body").isNotNull()
    return (parsed.orderBy(F.desc("ts"), "message")
            .select(F.col("log_ts").alias("time"), F.when(matched, F.col("service")).alias("service"), "body"))


def keyword_errors_per_hour(logs: DataFrame) -> DataFrame:
    """Lines with an error word in any case, latest hour first."""
    return _per_hour(logs.where(F.col("message").rlike(C.KEYWORD_PATTERN))).orderBy(F.desc("hour"))


def keyword_errors_total(logs: DataFrame) -> DataFrame:
    return keyword_errors_per_hour(logs).agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))


def _swap_requests(logs: DataFrame) -> DataFrame:
    text = F.col("message")
    return logs.where(text.contains(C.SWAP_SERVICE_MARK) & text.contains(C.HTTP_MARK))


def _failed(lines: DataFrame) -> DataFrame:
    """The failed ones of lines that have a `body`; it and the status are read once."""
    return lines.withColumn("status", _captured_int(F.col("body"), C.STATUS_PATTERN)).where(F.col("status") >= 400)


def swap_http_errors(logs: DataFrame, *, k: int = 20) -> DataFrame:
    """Failed swap requests by status, endpoint and output token, with a label."""
    failed = _failed(_swap_requests(logs).select(body(F.col("message")).alias("body")))
    paths = failed.select("status", _capture(F.col("body"), C.PATH_PATTERN).alias("path"))
    counts = (paths.groupBy("status", _capture(F.col("path"), C.ENDPOINT_PATTERN).alias("endpoint"),
                            _capture(F.col("path"), C.OUT_MINT_PATTERN).alias("out_mint"))
              .agg(F.count("*").alias("count")))
    arrow = F.when(F.length("out_mint") > 10, F.concat(F.lit(" → "), short_token(F.col("out_mint"), 10)))
    label = F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" /"),
                     F.coalesce("endpoint", F.lit("?")), F.coalesce(arrow, F.lit("")))
    return top(counts, k, "count", "status", "endpoint", "out_mint").withColumn("label", label)


def swap_errors_per_hour(logs: DataFrame) -> DataFrame:
    return _per_hour(_failed(_swap_requests(logs).select("ts", body(F.col("message")).alias("body")))).orderBy("hour")


def swap_recent_failures(logs: DataFrame, *, k: int = 25) -> DataFrame:
    requests = _swap_requests(logs)
    newest = _newest(_failed(requests.withColumn("body", body(F.col("message")))), k)
    return (parse_syslog(newest).orderBy(F.desc("ts"), "message")
            .select("time", "status", "method", "endpoint", "latency_ms",
                    short_token(F.col("in_mint")).alias("in_mint"), short_token(F.col("out_mint")).alias("out_mint")))


def scraper_outcomes(logs: DataFrame) -> DataFrame:
    """Counts of the three known outcomes, labelled."""
    marked = logs.where(F.col("message").contains(C.SCRAPER_SERVICE_MARK))
    outcome = _capture(F.col("message"), C.OUTCOME_PATTERN)
    counts = (marked.select(outcome.alias("outcome")).where(F.col("outcome").isin(list(C.OUTCOME_LABELS)))
              .groupBy("outcome").agg(F.count("*").alias("count")))
    label = F.when(F.lit(False), F.lit(""))
    for code, name in C.OUTCOME_LABELS.items():
        label = label.when(F.col("outcome") == code, name)
    return (counts.withColumn("label", label.otherwise(F.col("outcome"))).select("outcome", "label", "count")
            .orderBy(F.desc("count"), "outcome"))


def scraper_signals(logs: DataFrame, *, k: int = 15) -> DataFrame:
    """Trade signals by ticker and direction, with a label."""
    text = F.col("message")
    marked = logs.where(text.contains(C.SCRAPER_SERVICE_MARK) & text.contains(C.SIGNAL_MARK))
    counts = (marked.groupBy(_capture(text, C.SIGNAL_PATTERN, 1).alias("ticker"),
                             _capture(text, C.SIGNAL_PATTERN, 2).alias("direction"))
              .agg(F.count("*").alias("count")))
    label = F.concat(F.coalesce("ticker", F.lit("?")), F.lit(" "), F.coalesce("direction", F.lit("")))
    return top(counts, k, "count", "ticker", "direction").withColumn("label", label)


def log_search(logs: DataFrame, *, service: str | None = None, level: str | None = None,
               text: str | None = None, k: int = 200) -> DataFrame:
    """Newest lines that match an optional service, level ("errors only" or "warnings+") and pattern."""
    message = F.col("message")
    for pattern in (service, C.LEVEL_PATTERNS[level] if level else None, text):
        if pattern:
            logs = logs.where(message.rlike(pattern))
    return _newest(logs, k)
