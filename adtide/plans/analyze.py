"""The whole analysis: health, drift, tasks, insights, evaluation, report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from adtide.operators import alerts as alert_ops
from adtide.operators import drift as drift_ops
from adtide.operators import insights as insight_ops
from adtide.operators import quality, rank, rollups
from adtide.operators.report import report_sections
from adtide.operators.thresholds import quality_levels, variation_columns
from adtide.plans.staging import settle
from adtide.plans.tasks import Source, TaskResult, default_tasks, run_tasks, task_keys, trend_results
from adtide.schema import ThresholdConfig


class Analysis(NamedTuple):
    health: DataFrame
    health_summary: DataFrame
    drift: DataFrame | None
    data_quality: DataFrame
    tasks: list[TaskResult]
    insights: DataFrame
    creatives: DataFrame
    evaluation: insight_ops.Evaluation
    alerts: DataFrame
    report: DataFrame


def _gathered(df: DataFrame, columns: list[Column], key_sets: list[tuple[str, ...]]) -> tuple[DataFrame, Source]:
    """``columns`` (aggregates of the whole table) as one row, and the shared roll-up as a source,
    from one scan: the aggregates are observed while the roll-up is written.

    An observed number counts a row again when a lost executor's task runs again.  The row count is
    observed as well and held against the roll-up's, which is exact; if they differ the
    aggregates are computed on their own.
    """
    known = [k for k in key_sets if set(k) <= set(df.columns)]
    if not known:  # no task groups by a column of the table
        return settle(df.agg(*columns)), lambda keys: df
    observed = Observation()
    shared = settle(rollups.shared_rollup(df.observe(observed, *columns), known))
    schema = df.limit(0).agg(*columns).schema
    row = df.sparkSession.createDataFrame([tuple(observed.get[c] for c in schema.fieldNames())], schema)
    exact = shared.where("key_set = 0").agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
    if observed.get["total_rows"] != exact:
        row = settle(df.agg(*columns))
    return row, lambda keys: rollups.key_set_rows(shared, known.index(keys), keys) if keys in known else df


def analyze(
    df: DataFrame,
    baseline: DataFrame | None = None,
    tasks: Sequence[dict] | None = None,
    as_of: str | None = None,
    config: ThresholdConfig = ThresholdConfig(),
    title: str | None = None,
) -> Analysis:
    """Compose the operators over one fact table.

    One scan, made now, writes the roll-ups the tasks ask for and gathers the health, drift and
    variation numbers.  ``baseline`` is a stored baseline to compare with (see
    ``drift.check_or_create_baseline`` for the version that keeps one); its drift and outlier
    alerts become alerts and a part of the report.  Only the medians of a metric that dropped read
    the facts again.  The few rows that later parts build on are kept as tables; the returned
    DataFrames are computed from these when used.
    """
    spark = df.sparkSession
    tasks = list(tasks if tasks is not None else default_tasks(config))
    scan = drift_ops.prepare_scan(df, baseline) if baseline is not None else None
    columns = quality.scan_columns(df) + variation_columns(df)
    if scan is not None:
        columns += [c.alias(f"drift_{n}") for c, n in zip(scan.columns, df.limit(0).agg(*scan.columns).columns, strict=True)]
    keys = [k for k in [("campaign_name",), *task_keys(tasks)] if set(k) <= set(df.columns)]
    row, source = _gathered(df, columns, list(dict.fromkeys(keys)))
    health = settle(quality.run_health_checks(df, as_of, scan=row))
    drift = None
    if scan is not None:
        moved = row.select(*[F.col(c).alias(c.removeprefix("drift_")) for c in row.columns if c.startswith("drift_")])
        drift = settle(drift_ops.alerts_from_scan(scan, moved, df, baseline))
    campaigns = source(("campaign_name",)).where("campaign_name is not null").count() if "campaign_name" in df.columns else 0
    variation = row.select(F.lit(campaigns).cast("long").alias("sample_size"), *[c for c in row.columns if c.endswith("_cv") and not c.startswith("null_")])
    level = settle(quality_levels(variation, config))
    results = run_tasks(df, tasks, config, source)
    trends = trend_results(results)
    if trends is None:
        schema = "task_id string, metric string, change_pct double, recent_avg double"
        trends = spark.createDataFrame([], schema)
    else:
        trends = settle(trends)
    insights = insight_ops.fallback_insights(trends)
    evaluation = insight_ops.evaluate(insights, trends, level.select("quality_level").scalar(), config=config)
    worst = [r.data.top for r in results if isinstance(r.data, rank.Underperformers)]
    if worst:
        creatives = settle(insight_ops.fallback_creatives(worst[-1]))
    else:
        creatives = spark.createDataFrame([], insight_ops.CREATIVE_TYPE)
    raised = alert_ops.make_alerts(insight_ops.low_confidence(insights), evaluation.report, health, ts=as_of, drift=drift)
    return Analysis(
        health,
        quality.health_summary(health),
        drift,
        level,
        results,
        insights,
        creatives,
        evaluation,
        raised,
        report_sections(insights, creatives, evaluation.report, drift, title),
    )
