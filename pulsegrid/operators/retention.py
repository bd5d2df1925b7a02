"""Cohort retention: who came back how many days after the first visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RETENTION_DAYS
from ..functions.frames import count_if
from ..functions.numbers import percent


def cohort_retention(ev: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """Per first-seen day: cohort size and the share active exactly D days later.

    Events are reduced to distinct (user, day) before anything else, so a user's group in the
    window below has at most one row per day, however many events they sent.
    """
    active = (ev.where(F.col("wallet_address").isNotNull() & F.col("date").isNotNull())
              .select("wallet_address", "date").distinct())
    first = F.min("date").over(Window.partitionBy("wallet_address"))
    aged = active.select(first.alias("cohort"), F.col("date")).withColumn("age", F.date_diff("date", "cohort"))
    sizes = aged.groupBy("cohort").agg(
        count_if(F.col("age") == 0).alias("users"),
        *[count_if(F.col("age") == d).alias(f"_{d}") for d in days])
    return sizes.select("cohort", "users", *[percent(F.col(f"_{d}"), F.col("users")).alias(f"D{d}") for d in days]
                        ).orderBy("cohort")


def retention_curve(ev: DataFrame, days: Sequence[int] = RETENTION_DAYS, *,
                    mature_only: bool = False) -> DataFrame:
    """Unweighted mean over cohorts for each D.

    Days a cohort has not reached yet count as 0; with `mature_only` a cohort counts for D only
    if the data reaches that far.
    """
    cohorts = cohort_retention(ev, days)
    if mature_only:
        last = ev.agg(F.max("date").alias("last")).scalar()
        cohorts = cohorts.select("cohort", *[
            F.when(F.date_add("cohort", d) <= last, F.col(f"D{d}")).alias(f"D{d}") for d in days])
    means = cohorts.agg(*[F.coalesce(F.avg(f"D{d}"), F.lit(0.0)).alias(f"D{d}") for d in days])
    points = F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"D{d}").alias("retention_pct")) for d in days])
    return means.select(F.inline(points)).orderBy("day")


def retention_matrix(ev: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """Cohort x day matrix, only where there is more than one cohort."""
    cohorts = cohort_retention(ev, days)
    several = F.count("*").over(Window.partitionBy()) > 1
    return (cohorts.withColumn("_several", several).where("_several")
            .select("cohort", *[f"D{d}" for d in days]).orderBy("cohort"))
