"""Period rollups of raw metric points: the base of every operational result.

A point is (ts, namespace, metric_name, value, dims). As with most metric services a series is
one exact set of dimensions: with `exact_dims` (the default) a point that carries further
dimensions belongs to another series and is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIM_SERVICE
from ..functions.timestamps import bucket
from .tables import within_hours

STATS = {"Sum": F.sum, "Average": F.avg, "Minimum": F.min, "Maximum": F.max}
STATES = ("sum", "count", "min", "max")       # columns of a stored rollup, in place of `value`


def period_for(hours: int | None) -> int:
    """Bucket length in seconds for a lookback: 5 min, 15 min or 1 h (also for all history)."""
    if hours is None or hours > 72:
        return 3600
    return 300 if hours <= 24 else 900


def log_hours(hours: int) -> int:
    """Lookback of log results that belongs to a metric lookback: the same, at most a day."""
    return min(hours, 24)


def dim(name: str) -> Column:
    return F.try_element_at(F.col("dims"), F.lit(name))


def select_points(points: DataFrame, names: Sequence[str], *, dims: Mapping[str, str] | None = None,
                  by: Sequence[str] = (), hours: int | None = 24, end: str | None = None,
                  namespace: str | None = None, exact_dims: bool = True) -> DataFrame:
    """Points of the named metrics with the given dimensions, and any value of the `by` ones.

    Name and time predicates are plain comparisons, so they reach the Parquet reader. The lookback ends at
    `end`, or now; `hours=None` asks for all history.
    """
    df = points.where(F.col("metric_name").isin(list(names)))
    if namespace is not None:
        df = df.where(F.col("namespace") == namespace)
    df = within_hours(df, hours, end)
    for key, value in (dims or {}).items():
        df = df.where(dim(key) == value)
    for key in by:
        df = df.where(dim(key).isNotNull())
    if exact_dims:
        size = F.when(F.col("dims").isNull(), F.lit(0)).otherwise(F.size("dims"))
        df = df.where(size == len(dims or {}) + len(by))
    return df


def point_states() -> dict[str, Column]:
    """What a rollup keeps of the values in a bucket."""
    return {"sum": F.sum("value"), "count": F.count("value"), "min": F.min("value"), "max": F.max("value")}


def merged_states() -> dict[str, Column]:
    """States of a coarser bucket from those of finer ones."""
    return {"sum": F.sum("sum"), "count": F.sum("count"), "min": F.min("min"), "max": F.max("max")}


def statistics(points: DataFrame) -> dict[str, Column]:
    """The four statistics as aggregates, over raw points or over the rows of a stored rollup."""
    if "value" in points.columns or not set(STATES) <= set(points.columns):
        return {stat: fn("value") for stat, fn in STATS.items()}
    states = merged_states()
    return {"Sum": states["sum"], "Average": F.try_divide(states["sum"], states["count"]), "Minimum": states["min"], "Maximum": states["max"]}


def rollup(points: DataFrame, period: int, *keys: Column) -> DataFrame:
    """All four statistics per key and bucket, in one pass."""
    return (points.groupBy(*keys, bucket(F.col("ts"), period).alias("timestamp"))
            .agg(*[column.alias(stat) for stat, column in statistics(points).items()]))


def _series(points: DataFrame, stat: str, period: int, *keys: Column) -> DataFrame:
    if stat not in STATS:
        raise ValueError(f"stat must be one of {sorted(STATS)}")
    return (points.groupBy(*keys, bucket(F.col("ts"), period).alias("timestamp"))
            .agg(statistics(points)[stat].alias("value")))


def metric_series(points: DataFrame, name: str, stat: str = "Average", *, period: int | None = None,
                  hours: int | None = 24, end: str | None = None, dims: Mapping[str, str] | None = None,
                  namespace: str | None = None, exact_dims: bool = True) -> DataFrame:
    """One metric as (timestamp, value), by time."""
    chosen = select_points(points, [name], dims=dims, hours=hours, end=end,
                           namespace=namespace, exact_dims=exact_dims)
    return (_series(chosen, stat, period or period_for(hours))
            .select("timestamp", "value").orderBy("timestamp"))


def metric_series_by_dim(points: DataFrame, name: str, dimension: str, values: Sequence[str],
                         stat: str = "Sum", *, period: int | None = None, hours: int | None = 24,
                         end: str | None = None, dims: Mapping[str, str] | None = None,
                         namespace: str | None = None, exact_dims: bool = True) -> DataFrame:
    """One metric as (timestamp, value, dimension) for the listed dimension values, in one pass."""
    chosen = select_points(points, [name], dims=dims, by=[dimension], hours=hours, end=end,
                           namespace=namespace, exact_dims=exact_dims)
    chosen = chosen.where(dim(dimension).isin(list(values)))
    return (_series(chosen, stat, period or period_for(hours), dim(dimension).alias("dimension"))
            .select("timestamp", "value", "dimension").orderBy("dimension", "timestamp"))


def metric_series_by_service(points: DataFrame, name: str, stat: str = "Average", *,
                             period: int | None = None, hours: int | None = 24, end: str | None = None,
                             namespace: str | None = None, exact_dims: bool = True) -> DataFrame:
    """One metric as (timestamp, value, service) for every service that reports it."""
    chosen = select_points(points, [name], by=[DIM_SERVICE], hours=hours, end=end,
                           namespace=namespace, exact_dims=exact_dims)
    return (_series(chosen, stat, period or period_for(hours), dim(DIM_SERVICE).alias("service"))
            .select("timestamp", "value", "service").orderBy("service", "timestamp"))


def metric_dim_values(points: DataFrame, name: str, dimension: str, *, hours: int | None = 336,
                      end: str | None = None, namespace: str | None = None) -> DataFrame:
    """Sorted distinct values of one dimension of a metric, of the last two weeks by default."""
    chosen = select_points(points, [name], by=[dimension], hours=hours, end=end,
                           namespace=namespace, exact_dims=False)
    return chosen.select(dim(dimension).alias("value")).distinct().orderBy("value")
