"""Event-time rollups with watermarks.

State is keyed by window (and wallet), so it is spread over the shuffle partitions, and the
watermark drops closed windows. Append mode emits each window once, when it is closed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..constants import ERROR_PRIORITY
from ..functions.timestamps import bucket, instant_to_utc, micros, to_utc
from ..operators.logs import priority
from ..sources.metrics import select_points

WALLET = "wallet_address"
_KEPT = "spark.sql.streaming.numRecentProgressUpdates"
KEPT = 2000               # micro-batches whose figures a query keeps
EACH = 5                  # seconds after which they are read; far fewer batches end in that time


def instant(df: DataFrame) -> Column:
    """Watermarks need TIMESTAMP: the UTC wall clock `ts` as an instant."""
    return F.timestamp_micros(micros(to_utc(df, "ts")))


def stream_concurrent_users(events: DataFrame, *, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Distinct users per bucket.

    Exact distinct counts are two chained windowed counts: per (bucket, user), then per bucket.
    """
    size = f"{minutes} minutes"
    seen = (events.where(F.col("ts").isNotNull() & F.col(WALLET).isNotNull())
            .select(instant(events).alias("ts"), WALLET).withWatermark("ts", delay)
            .groupBy(F.window("ts", size).alias("w"), WALLET).count())
    return (seen.groupBy(F.window(F.window_time("w"), size).alias("w"))
            .agg(F.count("*").alias("viewers"))
            .select(instant_to_utc(F.col("w.start")).alias("time_utc"), "viewers"))


def viewers_per_bucket(events: DataFrame, *, minutes: int = 5) -> DataFrame:
    """The batch twin of stream_concurrent_users."""
    return (events.where(F.col("ts").isNotNull() & F.col(WALLET).isNotNull())
            .groupBy(bucket(F.col("ts"), minutes * 60).alias("time_utc")).agg(F.count_distinct(WALLET).alias("viewers")))


_STATISTICS = {"sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max}


def _rolled(grouped: GroupedData) -> DataFrame:
    return grouped.agg(*[fn("value").alias(name) for name, fn in _STATISTICS.items()])


def stream_metric_rollup(points: DataFrame, name: str, *, period: int = 300, delay: str = "10 minutes",
                         dims: Mapping[str, str] | None = None, namespace: str | None = None,
                         exact_dims: bool = True) -> DataFrame:
    """All four statistics of one series of a metric per period; a series is chosen as in `metric_series`."""
    chosen = select_points(points, [name], dims=dims, hours=None, namespace=namespace, exact_dims=exact_dims)
    windows = (chosen.withColumn("ts", instant(points)).withWatermark("ts", delay)
               .groupBy(F.window("ts", f"{period} seconds").alias("w")))
    return _rolled(windows).select(instant_to_utc(F.col("w.start")).alias("timestamp"), *_STATISTICS)


def metric_rollup(points: DataFrame, name: str, *, period: int = 300, dims: Mapping[str, str] | None = None,
                  namespace: str | None = None, exact_dims: bool = True) -> DataFrame:
    """The batch twin of stream_metric_rollup."""
    chosen = select_points(points, [name], dims=dims, hours=None, namespace=namespace, exact_dims=exact_dims)
    return _rolled(chosen.groupBy(bucket(F.col("ts"), period).alias("timestamp")))


def stream_errors_per_hour(logs: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Error lines (priority 4 and below) per hour."""
    return (logs.where(priority(F.col("message")) <= ERROR_PRIORITY)
            .withColumn("ts", instant(logs)).withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("errors"))
            .select(instant_to_utc(F.col("w.start")).alias("hour"), "errors"))


class Run(NamedTuple):
    """The closed windows so far, how many rows of this run came too late for theirs, and how many it read."""

    table: DataFrame
    late_rows: int
    read_rows: int


def run_available(stream: DataFrame, folder: str) -> Run:
    """Process what the source holds beyond the last run into a table under `folder`, and read that table.

    `folder` holds table and checkpoint and lies where all executors can reach it. A run with the folder of
    an earlier one, failed or finished, continues where that stopped. Bound the micro-batches on the source
    (`maxFilesPerTrigger`, `maxBytesPerTrigger`). Windows that the watermark has not closed stay in the
    state; `with_open_windows` adds them to a result.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_KEPT, None)
    spark.conf.set(_KEPT, str(KEPT))          # the query takes its settings over when it starts
    try:
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True).start())
    finally:
        spark.conf.unset(_KEPT) if before is None else spark.conf.set(_KEPT, before)
    counts: dict[int, tuple[int, int]] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(EACH)
        counts |= _counts(query.recentProgress)
    missing = set(range(min(counts), max(counts) + 1)) - set(counts) if counts else set()
    if missing:
        raise RuntimeError(f"no figures of {len(missing)} micro-batches, so late rows cannot be told")
    late, read = (sum(c[i] for c in counts.values()) for i in (0, 1))
    return Run(spark.read.schema(stream.schema).parquet(f"{folder}/table"), late, read)


def _counts(progress: list) -> dict[int, tuple[int, int]]:
    """(late rows, rows read) of each micro-batch."""
    return {p["batchId"]: (sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), p["numInputRows"]) for p in progress}


def with_open_windows(closed: DataFrame, rows: DataFrame, time_col: str, seconds: int,
                      batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Closed windows of a stream, and those still open from a batch over the newest rows.

    All windows up to the last closed one are settled, so `batch` reads only rows (by `ts`) from its end on, a plain
    bound that reaches the reader.
    """
    end = closed.agg((F.max(time_col) + F.make_dt_interval(secs=F.lit(seconds))).alias("end")).first()["end"]
    fresh = rows if end is None else rows.where(F.col("ts") >= F.lit(end).cast("timestamp_ntz"))
    return closed.unionByName(batch(fresh).select(*closed.columns))
