"""Metric drift and outliers of current data against a stored baseline.

The baseline is one row per metric; it is folded into a single struct and used
as a scalar subquery, so comparing needs neither a join nor a driver round
trip.  Drift and outlier numbers of every metric come from one scan of the
current table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.functions.quantiles import percentiles
from adtide.operators.baseline import baseline_stats, metric_rows, number, read_baseline, write_baseline
from adtide.plans.staging import settle
from adtide.schema import CRITICAL_DROP, DRIFT_DROP_LIMITS, OUTLIER_WARNING_PCT, OUTLIER_Z

ALERT_COLUMNS = (
    "metric", "kind", "severity", "baseline_value", "current_value", "change_pct",
    "affected_rows", "message", "details",
)


def _baseline_struct(baseline: DataFrame, metrics: list[str], stats: Sequence[str] = ("mean", "std")) -> Column:
    """The baseline as one struct with ``<metric>_<statistic>`` fields."""
    fields = [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in stats]
    wide = baseline.agg(*fields)
    return wide.select(F.struct(*wide.columns).alias("b")).scalar()


def _zscore(value: Column, metric: str, base: Column) -> Column:
    std = base[f"{metric}_std"]
    return (value - base[f"{metric}_mean"]) / F.when(std != 0, std)


def scan_columns(current: DataFrame, metrics: Sequence[str], base: Column, limits: dict[str, float], z: float = OUTLIER_Z) -> list[Column]:
    """Aggregates of one scan with every number the alerts need; ``base`` is the baseline as a struct."""
    aggs = [F.count("*").alias("total_rows")]
    for m in metrics:
        x = number(current, m)
        score = F.abs(_zscore(x, m, base))
        out = F.when(score > z, x)
        aggs += [
            F.avg(x).alias(f"{m}_mean"),
            F.stddev_samp(x).alias(f"{m}_std"),
            F.count_if(x < base[f"{m}_mean"] * (1 - limits[m])).alias(f"{m}_below"),
            F.count(out).alias(f"{m}_out"),
            F.avg(out).alias(f"{m}_out_mean"),
            F.stddev_samp(out).alias(f"{m}_out_std"),
            F.max(score).alias(f"{m}_max_z"),
        ]
    return aggs


def _scan(current: DataFrame, baseline: DataFrame, limits: dict[str, float], z: float) -> tuple[DataFrame, list[str]]:
    """One row of the numbers above.  Parts an alert kind does not use are pruned
    from the aggregate by the optimizer."""
    metrics = [m for m in limits if m in current.columns]
    packed = _baseline_struct(baseline, metrics)
    facts = current.select(*[number(current, m).alias(m) for m in metrics]).withColumn("_b", packed)
    return facts.agg(*scan_columns(facts, metrics, F.col("_b"), limits, z)).withColumn("_b", packed), metrics


class Scan(NamedTuple):
    """The aggregates of a drift check, to be gathered in a scan that is made anyway."""

    metrics: list[str]
    columns: list[Column]
    base: Column


def prepare_scan(current: DataFrame, baseline: DataFrame, limits: dict[str, float] = DRIFT_DROP_LIMITS, z: float = OUTLIER_Z) -> Scan:
    """What ``alerts_from_scan`` needs of ``current``: aggregates against the baseline's numbers (a row per metric, read now)."""
    metrics = [m for m in limits if m in current.columns]
    known = {r["metric"]: r for r in baseline.where(F.col("metric").isin(metrics)).select("metric", "mean", "std").collect()}
    fields = [F.lit(known[m][s] if m in known else None).cast("double").alias(f"{m}_{s}") for m in metrics for s in ("mean", "std")]
    base = F.struct(*fields)
    return Scan(metrics, scan_columns(current, metrics, base, limits, z), base)


def alerts_from_scan(
    scan: Scan, row: DataFrame, current: DataFrame, baseline: DataFrame, limits: dict[str, float] = DRIFT_DROP_LIMITS, medians: bool = True, approx: bool = False
) -> DataFrame:
    """As ``detect_drift``, from the gathered ``row``."""
    wide = row.withColumn("_b", scan.base)
    if medians:
        wide = _with_medians(wide, current, baseline, limits, scan.metrics, approx)
    return _alerts(wide, [_drift_alert(m, limits[m], medians) for m in scan.metrics] + [_outlier_alert(m) for m in scan.metrics])


def _number_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("double"))])


def _alert(metric, kind, severity, baseline, current, change, affected, message, details) -> Column:
    values = (F.lit(metric), F.lit(kind), severity, baseline, current, change, affected, message, details)
    return F.struct(*[v.alias(n) for v, n in zip(values, ALERT_COLUMNS, strict=True)])


def _drift_alert(m: str, limit: float, medians: bool) -> Column:
    base_mean = F.col("_b")[f"{m}_mean"]
    now = F.col(f"{m}_mean")
    change = _change(m)
    drop, rise = change < -limit, change > 2 * limit
    severity = (
        F.when(drop & (F.abs(change) > CRITICAL_DROP), "CRITICAL").when(drop | rise, "WARNING")
    )
    size = F.abs(change) * 100
    message = F.when(drop, F.format_string(f"{m.upper()} dropped %.1f%%", size)).otherwise(
        F.format_string(f"{m.upper()} increased %.1f%% - verify data quality", size)
    )
    spread = {"baseline_std": F.col("_b")[f"{m}_std"], "current_std": F.col(f"{m}_std")}
    middle = {}
    if medians:
        middle = {"baseline_median": F.col("_m")[f"{m}_baseline"], "current_median": F.col("_m")[f"{m}_current"]}
    details = F.when(drop, _number_map({**spread, **middle})).otherwise(_number_map(spread))
    affected = F.when(drop, F.col(f"{m}_below")).otherwise(F.lit(0).cast("long"))
    return _alert(m, "drift", severity, base_mean, now, change * 100, affected, message, details)


def _outlier_alert(m: str) -> Column:
    count = F.col(f"{m}_out")
    share = F.try_divide(count * 100.0, F.col("total_rows"))
    severity = F.when(count > 0, F.when(share > OUTLIER_WARNING_PCT, "WARNING").otherwise("INFO"))
    message = F.format_string(f"%d rows (%.1f%%) have outlier {m.upper()} values", count, share)
    details = _number_map(
        {
            "max_z_score": F.col(f"{m}_max_z"),
            "outlier_mean": F.col(f"{m}_out_mean"),
            "outlier_std": F.col(f"{m}_out_std"),
            "outlier_pct": share,
        }
    )
    mean = F.col(f"{m}_out_mean")
    return _alert(m, "outlier", severity, F.col("_b")[f"{m}_mean"], mean, F.lit(0.0), count, message, details)


def _change(m: str) -> Column:
    base = F.col("_b")[f"{m}_mean"]
    return F.try_divide(F.col(f"{m}_mean") - base, base)


def _with_medians(wide: DataFrame, current: DataFrame, baseline: DataFrame, limits: dict[str, float], metrics: list[str], approx: bool) -> DataFrame:
    """Add the baseline and current medians as the struct ``_m``, of the metrics that dropped:
    no other alert tells them, and without a drop the table is not read for them."""
    wide = settle(wide)
    fallen = wide.select(*[(_change(m) < -limits[m]).alias(m) for m in metrics]).first()  # one row
    dropped = [m for m in metrics if fallen[m]]
    none = F.lit(None).cast("double")
    if not dropped:
        return wide.withColumn("_m", F.struct(*[none.alias(f"{m}_{side}") for m in metrics for side in ("baseline", "current")]))
    values = metric_rows(current, dropped)
    # the exact way reads the values three times, and the table may be the result of joins
    values = values if approx else settle(values.where("value is not null"))
    halves = percentiles(values, "value", [0.5], ["metric"], approx, few_groups=True)
    both = halves.select("metric", F.col("q0").alias("v"), F.lit("current").alias("side")).unionByName(
        baseline.select("metric", F.col("median").alias("v"), F.lit("baseline").alias("side"))
    )
    row = both.agg(
        *[
            F.max(F.when((F.col("metric") == m) & (F.col("side") == side), F.col("v"))).alias(f"{m}_{side}")
            for m in metrics
            for side in ("baseline", "current")
        ]
    )
    return wide.withColumn("_m", row.select(F.struct(*row.columns).alias("m")).scalar())


def _alerts(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.inline(F.array(*structs))).where(F.col("severity").isNotNull())


def metric_drift(
    current: DataFrame,
    baseline: DataFrame,
    limits: dict[str, float] = DRIFT_DROP_LIMITS,
    medians: bool = True,
    approx: bool = False,
) -> DataFrame:
    """Alerts for metrics whose mean fell by more than their limit (with the
    number of rows under the limit) or rose by more than twice of it.

    A metric whose baseline mean is missing or 0 gives no alert.  ``medians``
    adds the medians of metrics that fell to the details, at the price of one more scan if one did.
    """
    wide, metrics = _scan(current, baseline, limits, OUTLIER_Z)
    if medians:
        wide = _with_medians(wide, current, baseline, limits, metrics, approx)
    return _alerts(wide, [_drift_alert(m, limits[m], medians) for m in metrics])


def outliers(
    current: DataFrame, baseline: DataFrame, z: float = OUTLIER_Z, limits: dict[str, float] = DRIFT_DROP_LIMITS
) -> DataFrame:
    """One alert per metric that has rows more than ``z`` baseline deviations
    from the baseline mean."""
    wide, metrics = _scan(current, baseline, limits, z)
    return _alerts(wide, [_outlier_alert(m) for m in metrics])


def outlier_rows(
    current: DataFrame, baseline: DataFrame, z: float = OUTLIER_Z, metrics: tuple[str, ...] = tuple(DRIFT_DROP_LIMITS)
) -> DataFrame:
    """The outlying rows themselves: the row plus ``outlier_metric``,
    ``outlier_value`` and ``z_score``, once per metric it is an outlier in."""
    present = [m for m in metrics if m in current.columns]
    base = F.col("_b")
    scored = F.array(
        *[
            F.struct(
                F.lit(m).alias("outlier_metric"),
                number(current, m).alias("outlier_value"),
                _zscore(number(current, m), m, base).alias("z_score"),
            )
            for m in present
        ]
    )
    far = F.filter(scored, lambda s: F.abs(s["z_score"]) > z)
    flagged = current.withColumn("_b", _baseline_struct(baseline, present))
    return flagged.select(*current.columns, F.inline(far))


def detect_drift(
    current: DataFrame,
    baseline: DataFrame,
    limits: dict[str, float] = DRIFT_DROP_LIMITS,
    z: float = OUTLIER_Z,
    medians: bool = True,
    approx: bool = False,
) -> DataFrame:
    """Drift alerts followed by outlier alerts, from one scan (plus medians)."""
    wide, metrics = _scan(current, baseline, limits, z)
    if medians:
        wide = _with_medians(wide, current, baseline, limits, metrics, approx)
    drifted = [_drift_alert(m, limits[m], medians) for m in metrics]
    return _alerts(wide, drifted + [_outlier_alert(m) for m in metrics])


def drift_summary(alerts: DataFrame) -> DataFrame:
    """One row of counts; ``suggest_reset`` when a critical alert is present."""
    critical = F.count_if(F.col("severity") == "CRITICAL")
    return alerts.agg(
        (F.count("*") > 0).alias("has_drift"),
        F.count("*").alias("num_alerts"),
        critical.alias("critical_alerts"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_alerts"),
        (critical > 0).alias("suggest_reset"),
    )


class DriftCheck(NamedTuple):
    """``created``: this run stored the first baseline (no alerts then)."""

    created: bool
    baseline: DataFrame
    alerts: DataFrame


def check_or_create_baseline(df: DataFrame, path: str, created_at: str | None = None, **options) -> DriftCheck:
    """Compare with the stored baseline, or store one when there is none."""
    stored = read_baseline(df.sparkSession, path)
    if stored is not None:
        return DriftCheck(False, stored, detect_drift(df, stored, **options))
    write_baseline(baseline_stats(df, created_at=created_at), path)
    fresh = read_baseline(df.sparkSession, path)
    return DriftCheck(True, fresh, detect_drift(df, fresh, medians=False).where(F.lit(False)))
