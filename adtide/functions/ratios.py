"""Ratio metrics and period-over-period change as null-safe column expressions.

A zero denominator gives NULL (never an ANSI error, never infinity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.schema import RATIO_METRICS


def ratio(name: str) -> Column:
    """The ratio metric ``name`` computed from the base columns of the row."""
    top, bottom, scale = RATIO_METRICS[name]
    value = F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))
    return value * F.lit(scale) if scale != 1 else value


def with_ratio_metrics(df: DataFrame, which: tuple[str, ...] = tuple(RATIO_METRICS)) -> DataFrame:
    """Add (or replace) the named ratio columns."""
    return df.withColumns({name: ratio(name) for name in which})


def metric_value(name: str) -> Column:
    """A base or ratio metric of an already summed row, as double."""
    return ratio(name) if name in RATIO_METRICS else F.col(name).cast("double")


def pct_change(recent: Column, previous: Column) -> Column:
    """Change in percent of ``previous``; 0 when ``previous`` is 0."""
    change = F.try_divide(recent - previous, previous) * 100
    return F.when(previous == 0, F.lit(0.0)).otherwise(change)


def trend_label(rising: Column) -> Column:
    """'increasing' where ``rising`` holds; unknown counts as not rising."""
    return F.when(F.coalesce(rising, F.lit(False)), "increasing").otherwise("decreasing")
