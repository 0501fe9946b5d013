"""Recent-versus-previous comparison of daily metric values.

Periods are counted in *days that have data*, newest first: the recent period
is days 1..N, the previous one days N+1..2N.

The first of these days is looked up from the date column alone and reaches the
scan as a filter, so a long history is pruned by partition or row-group
statistics before any metric column is read.  Only the 2N daily rows are ranked;
the ordering window never sees the fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtide.functions.ratios import pct_change, trend_label
from adtide.operators.rollups import daily_metric


def _newest_days(df: DataFrame, metric: str, count: int) -> DataFrame:
    """(date, value) of the newest ``count`` days that have data."""
    days = df.where(F.col("date").isNotNull()).select("date").distinct()
    first = days.orderBy(F.col("date").desc()).limit(count).agg(F.min("date")).scalar()
    return daily_metric(df.where(F.col("date") >= first), metric)


def _ranked_days(df: DataFrame, metric: str, days: int) -> DataFrame:
    newest = _newest_days(df, metric, 2 * days).orderBy(F.col("date").desc()).limit(2 * days)
    return newest.withColumn("rn", F.row_number().over(Window.orderBy(F.col("date").desc())))


def _periods(df: DataFrame, metric: str, days: int) -> DataFrame:
    rn = F.col("rn")
    recent, previous = rn <= days, rn > days
    return _ranked_days(df, metric, days).agg(
        F.avg(F.when(recent, F.col("value"))).alias("recent"),
        F.avg(F.when(previous, F.col("value"))).alias("previous"),
        F.count_if(recent).alias("recent_days"),
        F.count_if(previous).alias("previous_days"),
    )


def metric_trend(df: DataFrame, metric: str = "roas", days: int = 7) -> DataFrame:
    """One row: mean daily value of both periods, change in percent, label."""
    change = pct_change(F.col("recent"), F.col("previous"))
    return _periods(df, metric, days).select(
        F.lit(metric).alias("metric"),
        F.lit(days).alias("days"),
        F.col("recent").alias("recent_avg"),
        F.col("previous").alias("previous_avg"),
        change.alias("change_pct"),
        trend_label(change > 0).alias("trend"),
    )


def time_series_summary(df: DataFrame, metric: str = "roas", window: int = 7) -> DataFrame:
    """As :func:`metric_trend`, but a period without days reports 0 and the
    label compares the two means."""
    recent, previous = F.col("recent"), F.col("previous")
    no_previous = F.col("previous_days") == 0
    return _periods(df, metric, window).select(
        F.lit(metric).alias("metric"),
        F.when(F.col("recent_days") == 0, F.lit(0.0)).otherwise(recent).alias("recent_avg"),
        F.when(no_previous, F.lit(0.0)).otherwise(previous).alias("previous_avg"),
        F.when(no_previous, F.lit(0.0)).otherwise(pct_change(recent, previous)).alias("change_pct"),
        trend_label(recent > previous).alias("trend"),
    )


def daily_values(df: DataFrame, metric: str = "roas", days: int = 7) -> DataFrame:
    """The last min(7, ``days``) daily values in date order."""
    newest = _newest_days(df, metric, min(7, days))
    return newest.withColumnRenamed("value", metric).orderBy("date")
