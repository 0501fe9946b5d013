"""Running a list of analysis tasks as lazily built DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtide.operators import rank, rollups, trends
from adtide.operators.requests import DEFAULT_TREND_DAYS
from adtide.operators.thresholds import threshold_for
from adtide.plans.staging import settle
from adtide.schema import METRIC_ALIASES, METRICS, TASK_DEFAULT_METRIC, ThresholdConfig


class Trend(NamedTuple):
    summary: DataFrame
    daily_values: DataFrame


class Segments(NamedTuple):
    dimension: str
    segments: DataFrame


class Creatives(NamedTuple):
    total: DataFrame
    analysis: rank.CreativeAnalysis
    by_type: DataFrame


class TaskResult(NamedTuple):
    """``data`` holds the task's DataFrames, ``error`` the reason it has none."""

    task_id: str
    task_type: str
    data: Any
    error: str | None = None


def _metric(params: dict, task_type: str) -> str:
    name = str(params.get("metric", "")).lower().strip()
    name = METRIC_ALIASES.get(name, name)
    return name if name in METRICS else TASK_DEFAULT_METRIC[task_type]


def _days(params: dict) -> int:
    parts = str(params.get("timeframe", "")).split("last_", 1)
    digits = parts[1].split("_")[0] if len(parts) > 1 else ""
    days = int(digits) if digits.isascii() and digits.isdigit() else DEFAULT_TREND_DAYS
    return days if days < 1 << 31 else DEFAULT_TREND_DAYS  # as for request tables


def _threshold(value: Any, metric: str, config: ThresholdConfig) -> float:
    default = threshold_for(metric, config)
    text = str(value).lower() if value is not None else "top"
    if "zero" in text:
        return 0.0
    if "top" in text:
        return default
    try:
        number = float(text)
    except ValueError:
        return default
    return number if number == number else default


#: The table that has a group of the given keys in each row (or is the facts themselves).
Source = Callable[[tuple[str, ...]], DataFrame]
_PAIR = ("campaign_name", "adset_name")
_CREATIVE = ("creative_type", "creative_message")


def _trend(source: Source, params: dict, config: ThresholdConfig) -> Trend:
    metric, days = _metric(params, "analyze_metric_trend"), _days(params)
    daily = source(("date",))
    return Trend(trends.metric_trend(daily, metric, days), trends.daily_values(daily, metric, days))


def _underperformers(source: Source, params: dict, config: ThresholdConfig) -> rank.Underperformers:
    metric = _metric(params, "identify_underperformers")
    return rank.underperformers(source(_PAIR), metric, _threshold(params.get("threshold"), metric, config))


def _dimension(params: dict) -> str:
    return params.get("dimension", "creative_type")


def _segments(source: Source, params: dict, config: ThresholdConfig) -> Segments:
    dimension = _dimension(params)
    return Segments(dimension, rank.segment_analysis(source((dimension,)), dimension, _metric(params, "segment_analysis")))


def _creatives(source: Source, params: dict, config: ThresholdConfig) -> Creatives:
    each = source(_CREATIVE)
    return Creatives(rollups.creative_variant_count(each), rank.creative_analysis(each), rollups.creative_type_ctr(source(("creative_type",))))


TASKS: dict[str, Callable[[Source, dict, ThresholdConfig], Any]] = {
    "analyze_metric_trend": _trend,
    "identify_underperformers": _underperformers,
    "segment_analysis": _segments,
    "creative_analysis": _creatives,
}


def task_keys(tasks: Sequence[dict]) -> list[tuple[str, ...]]:
    """The sets of keys the tasks group by, each once."""
    out: list[tuple[str, ...]] = []
    for task in tasks:
        params = task.get("parameters") or {}
        sets = {
            "analyze_metric_trend": [("date",)],
            "identify_underperformers": [_PAIR],
            "segment_analysis": [(_dimension(params),)],
            "creative_analysis": [_CREATIVE, ("creative_type",)],
        }
        out += sets.get(str(task.get("task_type")), [])
    return list(dict.fromkeys(out))


def shared_source(df: DataFrame, key_sets: Sequence[tuple[str, ...]]) -> Source:
    """All roll-ups over the key sets the table has columns for, computed now in one scan of it.
    Other keys are answered from the table itself."""
    known = [keys for keys in key_sets if set(keys) <= set(df.columns)]
    if not known:
        return lambda keys: df
    shared = settle(rollups.shared_rollup(df, known))
    return lambda keys: rollups.key_set_rows(shared, known.index(keys), keys) if keys in known else df


def run_tasks(
    df: DataFrame, tasks: Sequence[dict], config: ThresholdConfig = ThresholdConfig(), source: Source | None = None
) -> list[TaskResult]:
    """Build the result of every task; an unknown type gives an error entry.

    Several tasks share one scan of the table, which runs now and keeps the roll-ups they ask for
    (``shared_source``; or give a ``source`` that has them).  Nothing else runs until one of the
    returned DataFrames is used.
    """
    if source is None:
        keys = task_keys(tasks)
        source = shared_source(df, keys) if len(keys) > 1 else lambda keys: df
    out = []
    for i, task in enumerate(tasks, 1):
        kind, task_id = str(task.get("task_type")), str(task.get("task_id", i))
        build = TASKS.get(kind)
        if build is None:
            out.append(TaskResult(task_id, kind, None, f"unknown task type: {kind}"))
        else:
            out.append(TaskResult(task_id, kind, build(source, task.get("parameters") or {}, config)))
    return out


def default_tasks(config: ThresholdConfig = ThresholdConfig()) -> list[dict]:
    """The plan used when no other is given: ROAS trend and CTR underperformers."""
    return [
        {
            "task_id": "1",
            "task_type": "analyze_metric_trend",
            "description": "Analyze ROAS trend over time",
            "parameters": {"metric": "roas", "timeframe": "last_7_days"},
        },
        {
            "task_id": "2",
            "task_type": "identify_underperformers",
            "description": "Find campaigns with low CTR",
            "parameters": {"metric": "ctr", "threshold": threshold_for("ctr", config)},
        },
    ]


def trend_results(results: Sequence[TaskResult]) -> DataFrame | None:
    """The trend rows of all results as one table (what insights build on)."""
    rows = [
        r.data.summary.select(F.lit(r.task_id).alias("task_id"), "*") for r in results if isinstance(r.data, Trend)
    ]
    out = rows[0] if rows else None
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


class InsightContext(NamedTuple):
    summary: DataFrame
    time_series: DataFrame
    dimensions: DataFrame


def insight_context(df: DataFrame) -> InsightContext:
    """Dataset summary, ROAS time series summary and dimension counts."""
    return InsightContext(
        rollups.dataset_summary(df), trends.time_series_summary(df, "roas", 7), rollups.value_counts(df)
    )
