"""Normalising a table of analysis requests (metric, threshold, time frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.operators.thresholds import default_threshold
from adtide.schema import (
    DEFAULT_TREND_DAYS,
    METRIC_ALIASES,
    METRICS,
    TASK_DEFAULT_METRIC,
    ThresholdConfig,
)


def _text_map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def metric_name(raw: Column) -> Column:
    """Known metric for a free-form name (case, blanks, aliases); else NULL."""
    known = {m: m for m in METRICS} | METRIC_ALIASES
    return _text_map(known, F.lower(F.trim(raw)))


def threshold_value(raw: Column, default: Column) -> Column:
    """Number behind a threshold text: 'zero' words are 0, 'top' words, bad and
    missing values the default."""
    text = F.lower(raw)
    # digit groups may be joined by an underscore
    number = F.trim(F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")).try_cast("double")
    return (
        F.when(text.contains("zero"), F.lit(0.0))
        .when(text.contains("top"), default)
        .otherwise(F.coalesce(F.when(~F.isnan(number), number), default))
    )


def trend_days(timeframe: Column) -> Column:
    """Number of days in ``last_N_days``; 7 when there is none."""
    digits = F.regexp_extract(timeframe, r"last_(\d+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(DEFAULT_TREND_DAYS))


def normalize_requests(requests: DataFrame, config: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """Add ``metric_used``, ``threshold_used`` and ``days_used`` to a table with
    ``task_type``, ``metric``, ``threshold`` and ``timeframe``.

    An unknown metric becomes the default of its task type; the default
    threshold is the one of the metric finally used.
    """
    used = F.coalesce(
        metric_name(F.col("metric")), _text_map(TASK_DEFAULT_METRIC, F.col("task_type")), F.lit("roas")
    )
    named = requests.withColumn("metric_used", used)
    default = default_threshold(F.col("metric_used"), config)
    return named.withColumns(
        {
            "threshold_used": threshold_value(F.col("threshold"), default),
            "days_used": trend_days(F.col("timeframe")),
        }
    )
