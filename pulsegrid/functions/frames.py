"""Small frame helpers: fixed lists, zero-filled spines, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fixed_list(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """One row per value of a short fixed list, with its position in `step`."""
    items = F.array(*[F.lit(v) for v in values])
    return spark.range(0, 1, 1, 1).select(F.posexplode(items).alias("step", name))


def whole_range(spark: SparkSession, name: str, size: int) -> DataFrame:
    return spark.range(0, size, 1, 1).select(F.col("id").cast("int").alias(name))


def fill_spine(spine: DataFrame, counts: DataFrame, key: str, **defaults: object) -> DataFrame:
    """Every spine row, with the counts that exist and defaults elsewhere."""
    joined = spine.join(counts, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def top(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k largest by `by`; equal values are ordered by the tie columns."""
    return df.orderBy(F.col(by).desc(), *[F.col(t).asc() for t in ties]).limit(k)


def top_per(df: DataFrame, group: str, k: int, by: str, *ties: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), *[F.col(t).asc() for t in ties])
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in `bins` equal bins over [min, max] of the non-null values; empty bins are left out.

    Values are first counted one by one; bounds (a scalar subquery) and bins both read that one
    shuffle, so the source is evaluated once. One value alone fills bin 1.
    """
    values = (df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v"))
              .agg(F.count("*").alias("n")))
    bounds = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    low, high = bounds["low"], bounds["high"]
    width = (high - low) / bins
    index = F.when(high > low, F.least(F.width_bucket(F.col("v"), low, high, F.lit(bins)), F.lit(bins)))
    binned = values.select(F.coalesce(index, F.lit(1)).cast("bigint").alias("bin"), "n")
    return (binned.groupBy("bin").agg(F.sum("n").alias("count"))
            .select("bin", (low + (F.col("bin") - 1) * width).alias("bin_start"),
                    (low + F.col("bin") * width).alias("bin_end"), "count")
            .orderBy("bin"))
