"""Threshold resolution, data-driven thresholds and data-quality levels.

The fixed defaults hold a handful of metrics, so they become literal map
look-ups inside the projection; only campaign overrides, whose number grows
with the account, are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.operators.baseline import number
from adtide.functions.quantiles import percentiles
from adtide.schema import MetricBounds, ThresholdConfig


def _lookup(table: dict, key: Column) -> Column:
    """Literal map look-up; NULL for a key (or table entry) that is missing."""
    known = {k: v for k, v in table.items() if v is not None}
    if not known:
        return F.lit(None).cast("double")
    entries = [F.lit(x) for k, v in known.items() for x in (k, float(v))]
    return F.try_element_at(F.create_map(*entries), key)


def adaptive_multiplier(metric: Column, quality: Column, config: ThresholdConfig = ThresholdConfig()) -> Column:
    """Multiplier for a metric under a data-quality level; 1 when none applies."""
    own = {m for m, _ in config.multipliers if m != "*"}
    kind = F.when(metric.isin(*sorted(own)), metric).otherwise("*")
    table = {f"{m}|{q}": v for (m, q), v in config.multipliers.items()}
    return F.coalesce(_lookup(table, F.concat_ws("|", kind, quality)), F.lit(1.0))


def default_threshold(metric: Column, config: ThresholdConfig = ThresholdConfig()) -> Column:
    """Metric default, else global default, else the fallback constant."""
    own = {m: config.metric_default(m) for m in config.metrics}
    return F.coalesce(_lookup(own, metric), _lookup(config.global_defaults, metric), F.lit(config.fallback))


def threshold_for(metric: str, config: ThresholdConfig = ThresholdConfig()) -> float:
    """The unadapted default of one metric as a plain number."""
    for value in (config.metric_default(metric), config.global_defaults.get(metric)):
        if value is not None:
            return float(value)
    return config.fallback


def resolve_thresholds(
    requests: DataFrame,
    config: ThresholdConfig = ThresholdConfig(),
    overrides: DataFrame | None = None,
    use_adaptive: bool = True,
) -> DataFrame:
    """Add ``base_threshold``, ``multiplier``, ``threshold`` and ``source``.

    ``requests`` needs ``metric``, ``campaign_id`` and ``data_quality``.
    Overrides come from ``config.campaigns`` or, when there are many, from the
    table ``overrides(campaign_id, metric, threshold)``.  That table is joined
    by key with no size hint: Spark broadcasts it only when statistics show it
    is small, and splits hot campaigns otherwise.
    """
    metric = F.col("metric")
    if overrides is None and config.campaigns:
        rows = [(c, m, float(v)) for c, ms in config.campaigns.items() for m, v in ms.items()]
        overrides = requests.sparkSession.createDataFrame(rows, "campaign_id string, metric string, threshold double")
    if overrides is not None:
        unique = overrides.groupBy("campaign_id", "metric").agg(F.max("threshold").cast("double").alias("_override"))
        joined = requests.join(unique, ["campaign_id", "metric"], "left")
    else:
        joined = requests.withColumn("_override", F.lit(None).cast("double"))
    own = _lookup({m: config.metric_default(m) for m in config.metrics}, metric)
    shared = _lookup(config.global_defaults, metric)
    override = F.col("_override")
    source = (
        F.when(override.isNotNull(), "campaign")
        .when(own.isNotNull(), "metric")
        .when(shared.isNotNull(), "global")
        .otherwise("fallback")
    )
    factor = adaptive_multiplier(metric, F.col("data_quality"), config) if use_adaptive else F.lit(1.0)
    base = F.coalesce(override, own, shared, F.lit(config.fallback))
    return joined.select(
        *[F.col(c) for c in requests.columns],
        base.alias("base_threshold"),
        factor.alias("multiplier"),
        (base * factor).alias("threshold"),
        source.alias("source"),
    )


def historical_threshold(
    df: DataFrame,
    metric: str,
    percentile: float = 25,
    min_samples: int = 100,
    by: Sequence[str] = (),
    lookback_days: int | None = None,
    as_of: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """Percentile of the finite values of ``metric``: ``by`` + ``metric``,
    ``samples``, ``threshold``.

    The threshold is NULL below ``min_samples`` values.  Without ``by`` there is
    always one row, also when the column is absent.  ``lookback_days`` keeps
    the days after ``as_of`` minus that many days.
    """
    by = list(by)
    if metric not in df.columns:
        nothing = df.where(F.lit(False)).agg(F.lit(metric).alias("metric"), F.count("*").alias("samples"))
        return nothing.withColumn("threshold", F.lit(None).cast("double"))
    data = df
    for key in by:
        data = data.where(F.col(key).isNotNull())
    if lookback_days is not None:
        end = F.lit(as_of).cast("date") if as_of else F.current_date()
        data = data.where(F.col("date") > F.date_sub(end, lookback_days))
    # stack() hands on the value as a plain column, however costly its expression
    rows = data.selectExpr(*by, f"stack(1, '{metric}', cast(`{metric}` as double)) as (metric, value)")
    finite = rows.where(F.abs("value") < F.lit(float("inf")))
    pct = percentiles(finite, "value", [percentile / 100.0], by + ["metric"], approx=approx, few_groups=not by)
    enough = F.when(F.col("n") >= min_samples, F.col("q0"))
    if by:
        return pct.select(*by, "metric", F.col("n").alias("samples"), enough.alias("threshold"))
    return pct.agg(
        F.lit(metric).alias("metric"),
        F.coalesce(F.max("n"), F.lit(0)).alias("samples"),
        F.max(enough).alias("threshold"),
    )


def _bounds(metric: str, config: ThresholdConfig) -> MetricBounds:
    entry = config.metrics.get(metric)
    if entry is None:
        return MetricBounds(None, None, None)
    if isinstance(entry, MetricBounds):
        return entry
    return MetricBounds(entry * 0.5, float(entry), entry * 2.0)


def with_metric_bounds(df: DataFrame, config: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """Add ``low``, ``default`` and ``high`` to a table with a ``metric`` column.

    Unknown metrics get NULLs; a metric configured as a single number gets half,
    once and twice that number.
    """
    bounds = {m: _bounds(m, config) for m in config.metrics}
    metric = F.col("metric")
    return df.withColumns(
        {part: _lookup({m: getattr(b, part) for m, b in bounds.items()}, metric) for part in ("low", "default", "high")}
    )


def performance_tier(value: Column, metric: str, config: ThresholdConfig = ThresholdConfig()) -> Column:
    """low / average / high; NULL without a value or without bounds."""
    bounds = _bounds(metric, config)
    if bounds.low is None or bounds.high is None:
        return F.lit(None).cast("string")
    return (
        F.when(value < bounds.low, "low").when(value < bounds.high, "average").when(value.isNotNull(), "high")
    )


def with_performance_tier(df: DataFrame, metric: str, config: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    return df.withColumn(f"{metric}_tier", performance_tier(F.col(metric), metric, config))


def _quality_level(variance: Column, campaigns: Column, config: ThresholdConfig) -> Column:
    return (
        F.when(variance == "high", "volatile")
        .when((variance == "low") & (campaigns > config.stable_min_campaigns), "stable")
        .otherwise("medium")
    )


def coefficient_of_variation(df: DataFrame, metrics: Sequence[str] = ("ctr", "roas", "cvr")) -> DataFrame:
    """One row with ``<metric>_cv`` per present metric and their mean ``avg_cv``."""
    present = [m for m in metrics if m in df.columns]
    cvs = [F.try_divide(F.stddev_samp(number(df, m)), F.avg(number(df, m))).alias(f"{m}_cv") for m in present]
    return _with_mean_cv(df.agg(F.count("*").alias("total_rows"), *cvs), present)


def _with_mean_cv(wide: DataFrame, present: Sequence[str]) -> DataFrame:
    total, known = F.lit(0.0), F.lit(0)
    for m in present:
        total = total + F.coalesce(F.col(f"{m}_cv"), F.lit(0.0))
        known = known + F.col(f"{m}_cv").isNotNull().cast("int")
    return wide.withColumn("avg_cv", F.try_divide(total, known))


def variation_columns(df: DataFrame, metrics: Sequence[str] = ("ctr", "roas", "cvr")) -> list[Column]:
    """Aggregates of one scan: ``<metric>_cv`` per present metric."""
    present = [m for m in metrics if m in df.columns]
    return [F.try_divide(F.stddev_samp(number(df, m)), F.avg(number(df, m))).alias(f"{m}_cv") for m in present]


def quality_levels(wide: DataFrame, config: ThresholdConfig = ThresholdConfig(), metrics: Sequence[str] = ("ctr", "roas", "cvr")) -> DataFrame:
    """Mean CV, variance and quality level of a row with ``sample_size`` (campaigns) and ``<metric>_cv`` columns."""
    wide = _with_mean_cv(wide, [m for m in metrics if f"{m}_cv" in wide.columns])
    cv = F.nullif(F.col("avg_cv"), F.lit(float("nan")))  # an infinite value leaves no usable variation: medium
    variance = F.when(cv > config.high_variance_cv, "high").when(cv < config.low_variance_cv, "low").otherwise("medium")
    return wide.withColumn("variance_level", variance).withColumn(
        "quality_level", _quality_level(F.col("variance_level"), F.col("sample_size"), config)
    )


def assess_data_quality(
    df: DataFrame, config: ThresholdConfig = ThresholdConfig(), metrics: Sequence[str] = ("ctr", "roas", "cvr")
) -> DataFrame:
    """One row: CV per metric, mean CV, campaign count, variance and quality level."""
    size = F.count_distinct("campaign_name") if "campaign_name" in df.columns else F.lit(0).cast("long")
    return quality_levels(df.agg(size.alias("sample_size"), *variation_columns(df, metrics)), config, metrics)


def assess_quality_from_summary(summary: DataFrame, config: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """The same levels from a dataset summary alone (no row data): few campaigns
    or an implausible mean ROAS count as high variance."""
    roas = F.coalesce(F.col("avg_roas"), F.lit(0.0))
    odd = (F.col("campaign_count") < 10) | (roas < 0.5) | (roas > 5.0)
    levels = summary.select(
        F.col("campaign_count").alias("sample_size"), F.when(odd, "high").otherwise("medium").alias("variance_level")
    )
    return levels.withColumn("quality_level", _quality_level(F.col("variance_level"), F.col("sample_size"), config))


def adapt_thresholds(quality: DataFrame, config: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """CTR, CVR and ROAS thresholds adapted to the *variance* level."""
    variance = F.col("variance_level")
    level = F.when(variance == "high", "volatile").when(variance == "low", "stable").otherwise("medium")
    out = [
        (default_threshold(F.lit(m), config) * adaptive_multiplier(F.lit(m), level, config)).alias(f"{m}_threshold")
        for m in ("ctr", "cvr", "roas")
    ]
    return quality.select("variance_level", *out)


def min_evidence(quality: Column, config: ThresholdConfig = ThresholdConfig()) -> Column:
    """Evidence items an insight needs; one more when the data is volatile."""
    extra = F.when(quality == "volatile", config.volatile_extra_evidence).otherwise(0)
    return (F.lit(config.min_evidence) + extra).cast("int")
