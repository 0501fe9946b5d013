"""Roll-ups, trends, rankings, thresholds, baseline and drift."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adtide.operators import baseline, drift, rank, requests, rollups, thresholds, trends
from adtide.operators.alerts import drift_digest
from adtide.plans.staging import settle, staging_dir
from adtide.plans.tasks import Trend, default_tasks, run_tasks
from adtide.schema import BASE_METRICS, MetricBounds, ThresholdConfig
from adtide.sources.ads import sample_rows
from workload import tables as t
from workload.registry import day, query, rounded

ADS = t.ads_sql()
BASES = list(BASE_METRICS)
SUMS = (
    "CAST(sum(spend) AS DOUBLE) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, "
    "CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(purchases) AS BIGINT) AS purchases, "
    "CAST(sum(revenue) AS DOUBLE) AS revenue"
)


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


RATIO_SQL = (
    f"{_div('clicks', 'impressions')} AS ctr, {_div('revenue', 'spend')} AS roas, {_div('purchases', 'clicks')} AS cvr, "
    f"{_div('spend', 'clicks')} AS cpc, {_div('spend', 'impressions')} * 1000 AS cpm"
)


def _rollup_sql(keys: str, where: str, out: str | None = None) -> str:
    return f"SELECT {out or keys}, {','.join(BASES)}, {RATIO_SQL} FROM (SELECT {keys}, {SUMS} FROM ads WHERE {where} GROUP BY {keys})"


DAILY = _rollup_sql("date", "date IS NOT NULL", "CAST(date AS VARCHAR) AS date")
PAIRS = _rollup_sql("campaign_name, adset_name", "campaign_name IS NOT NULL AND adset_name IS NOT NULL")


# --- roll-ups --------------------------------------------------------------------------
@query("daily_rollup", ADS + DAILY)
def _(spark, d):
    return rollups.daily_rollup(t.ads(spark, d, ["date", *BASES])).withColumn("date", day())


@query("campaign_adset_rollup", ADS + PAIRS)
def _(spark, d):
    return rollups.campaign_adset_rollup(t.ads(spark, d, ["campaign_name", "adset_name", *BASES]))


@query(
    "dataset_summary",
    ADS
    + "SELECT count(*) AS total_rows, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, "
    "CAST(max(date) - min(date) AS INTEGER) AS days, count(DISTINCT campaign_name) AS campaign_count, "
    "CAST(sum(spend) AS DOUBLE) AS total_spend, CAST(sum(impressions) AS BIGINT) AS total_impressions, "
    "CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(purchases) AS BIGINT) AS total_purchases, "
    "CAST(sum(revenue) AS DOUBLE) AS total_revenue, round(avg(ctr), 9) AS avg_ctr, round(avg(roas), 9) AS avg_roas FROM ads",
)
def _(spark, d):
    out = rollups.dataset_summary(t.ads(spark, d, ["date", "campaign_name", *BASES, "ctr", "roas"]))
    out = out.withColumns({"start_date": day("start_date"), "end_date": day("end_date")})
    return rounded(out, 9, "avg_ctr", "avg_roas")


@query(
    "value_counts",
    ADS
    + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS cnt FROM ads WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("creative_type", "platform", "country", "audience_type")
    ),
)
def _(spark, d):
    return rollups.value_counts(t.ads(spark, d, ["creative_type", "platform", "country", "audience_type"]))


@query(
    "campaign_overview",
    ADS
    + "SELECT count(DISTINCT campaign_name) AS campaign_count, "
    "(SELECT string_agg(campaign_name, ',' ORDER BY campaign_name) FROM (SELECT DISTINCT campaign_name FROM ads "
    "WHERE campaign_name IS NOT NULL ORDER BY campaign_name LIMIT 5)) AS first_names FROM ads",
)
def _(spark, d):
    return rollups.campaign_overview(t.ads(spark, d, ["campaign_name"])).withColumn(
        "first_names", F.array_join("first_names", ",")
    )


@query("segment_platform_roas", ADS + _rollup_sql("platform", "platform IS NOT NULL"))
def _(spark, d):
    return rank.segment_analysis(t.ads(spark, d, ["platform", *BASES]), "platform", "roas")


@query("segment_country_cpc", ADS + _rollup_sql("country", "country IS NOT NULL"))
def _(spark, d):
    return rank.segment_analysis(t.ads(spark, d, ["country", *BASES]), "country", "cpc")


CREATIVE = (
    f"SELECT creative_type, creative_message, {SUMS}, round(avg(ctr), 9) AS ctr, round(avg(roas), 9) AS roas FROM ads "
    "WHERE creative_type IS NOT NULL AND creative_message IS NOT NULL GROUP BY 1, 2"
)
_CREATIVE_COLUMNS = ["creative_type", "creative_message", *BASES, "ctr", "roas"]


@query("creative_rollup", ADS + CREATIVE)
def _(spark, d):
    return rounded(rollups.creative_rollup(t.ads(spark, d, _CREATIVE_COLUMNS)), 9, "ctr", "roas")


@query(
    "creative_variant_count",
    ADS + f"SELECT count(*) AS total_creative_variants FROM ({CREATIVE})",
)
def _(spark, d):
    return rollups.creative_variant_count(t.ads(spark, d, ["creative_type", "creative_message"]))


@query("creative_top10", ADS + CREATIVE + " ORDER BY avg(ctr) DESC NULLS LAST, creative_type, creative_message LIMIT 10")
def _(spark, d):
    return rounded(rank.creative_analysis(t.ads(spark, d, _CREATIVE_COLUMNS)).top, 9, "ctr", "roas")


@query("creative_bottom10", ADS + CREATIVE + " ORDER BY avg(ctr) ASC NULLS LAST, creative_type, creative_message LIMIT 10")
def _(spark, d):
    return rounded(rank.creative_analysis(t.ads(spark, d, _CREATIVE_COLUMNS)).bottom, 9, "ctr", "roas")


@query(
    "creative_type_ctr",
    ADS + "SELECT creative_type, round(avg(ctr), 9) AS avg_ctr FROM ads WHERE creative_type IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return rounded(rollups.creative_type_ctr(t.ads(spark, d, ["creative_type", "ctr"])), 9, "avg_ctr")


# --- trends ---------------------------------------------------------------------------------
def _trend_sql(metric: str, days: int, zero: bool = False) -> str:
    change = "CASE WHEN p = 0 THEN 0.0 ELSE (r - p) / p * 100 END"
    label = "(r - p) / p * 100 > 0" if not zero else "r > p"
    label = f"p IS NOT NULL AND p <> 0 AND {label}" if not zero else label
    head = f"'{metric}' AS metric, " + ("" if zero else f"{days} AS days, ")
    fill = (lambda x, n: f"CASE WHEN {n} = 0 THEN 0.0 ELSE {x} END") if zero else (lambda x, n: x)
    return (
        ADS
        + f", daily AS (SELECT * FROM ({_rollup_sql('date', 'date IS NOT NULL')})), "
        f"ranked AS (SELECT {metric} AS v, row_number() OVER (ORDER BY date DESC) AS rn FROM daily), "
        f"periods AS (SELECT avg(v) FILTER (WHERE rn <= {days}) AS r, avg(v) FILTER (WHERE rn > {days} AND rn <= {2 * days}) AS p, "
        f"count(*) FILTER (WHERE rn <= {days}) AS nr, count(*) FILTER (WHERE rn > {days} AND rn <= {2 * days}) AS np FROM ranked) "
        f"SELECT {head}round({fill('r', 'nr')}, 9) AS recent_avg, round({fill('p', 'np')}, 9) AS previous_avg, "
        f"round({fill(change, 'np')}, 6) AS change_pct, CASE WHEN {label} THEN 'increasing' ELSE 'decreasing' END AS trend FROM periods"
    )


def _trend(spark, d, metric, days):
    out = trends.metric_trend(t.ads(spark, d, ["date", *BASES]), metric, days)
    return rounded(rounded(out, 9, "recent_avg", "previous_avg"), 6, "change_pct")


@query("trend_roas_7", _trend_sql("roas", 7))
def _(spark, d):
    return _trend(spark, d, "roas", 7)


@query("trend_ctr_30", _trend_sql("ctr", 30))
def _(spark, d):
    return _trend(spark, d, "ctr", 30)


@query("trend_cpc_14", _trend_sql("cpc", 14))
def _(spark, d):
    return _trend(spark, d, "cpc", 14)


@query("time_series_summary", _trend_sql("roas", 7, zero=True))
def _(spark, d):
    out = trends.time_series_summary(t.ads(spark, d, ["date", *BASES]), "roas", 7)
    return rounded(rounded(out, 9, "recent_avg", "previous_avg"), 6, "change_pct")


@query(
    "daily_values_7",
    ADS
    + f"SELECT CAST(date AS VARCHAR) AS date, roas FROM ({_rollup_sql('date', 'date IS NOT NULL')}) ORDER BY date DESC LIMIT 7",
)
def _(spark, d):
    return trends.daily_values(t.ads(spark, d, ["date", *BASES]), "roas", 7).withColumn("date", day())


# --- rankings -----------------------------------------------------------------------------------
_PAIR_COLUMNS = ["campaign_name", "adset_name", *BASES]


@query("underperformers_ctr", ADS + PAIRS + " WHERE ctr < 0.0195 ORDER BY ctr, campaign_name, adset_name LIMIT 10".replace("WHERE ctr", f"WHERE {_div('clicks', 'impressions')}"))
def _(spark, d):
    return rank.underperformers(t.ads(spark, d, _PAIR_COLUMNS), "ctr", 0.0195).top


@query("underperformers_count", ADS + f"SELECT count(*) AS count FROM ({PAIRS}) WHERE ctr < 0.0195")
def _(spark, d):
    return rank.underperformers(t.ads(spark, d, _PAIR_COLUMNS), "ctr", 0.0195).total


@query("underperformers_all", ADS + f"SELECT * FROM ({PAIRS}) WHERE roas < 0.54")
def _(spark, d):
    return rank.below_threshold(t.ads(spark, d, _PAIR_COLUMNS), "roas", 0.54)


_DAY_PAIR = "concat(adset_name, ' ', CAST(date AS VARCHAR(10)))"


@query(
    "zero_revenue_pairs",
    t.ads_sql(adset_name=_DAY_PAIR)
    + f"SELECT * FROM ({PAIRS}) WHERE revenue <= 0 ORDER BY spend DESC NULLS LAST, campaign_name, adset_name LIMIT 10",
)
def _(spark, d):
    facts = t.ads(spark, d, ["date", *_PAIR_COLUMNS], adset_name=_DAY_PAIR)
    return rank.underperformers(facts, "revenue", 0.0).top


@query(
    "zero_revenue_count",
    t.ads_sql(adset_name=_DAY_PAIR) + f"SELECT count(*) AS count FROM ({PAIRS}) WHERE revenue <= 0",
)
def _(spark, d):
    facts = t.ads(spark, d, ["date", *_PAIR_COLUMNS], adset_name=_DAY_PAIR)
    return rank.underperformers(facts, "revenue", 0.0).total


_TASKS = default_tasks() + [
    {"task_id": "3", "task_type": "segment_analysis", "parameters": {"dimension": "platform", "metric": "sales"}},
    {"task_id": "4", "task_type": "creative_analysis"},
    {"task_id": "5", "task_type": "identify_underperformers", "parameters": {"metric": "ctr", "threshold": "0.0195"}},
]


@query(
    "creative_inputs",
    ADS
    + f"SELECT 'worst' AS side, campaign_name AS name, adset_name AS part, ctr, spend FROM (SELECT * FROM ({PAIRS}) WHERE ctr < 0.0195 "
    "ORDER BY ctr, campaign_name, adset_name LIMIT 5) UNION ALL "
    f"SELECT 'best', creative_message, creative_type, ctr, NULL FROM (SELECT * FROM ({CREATIVE}) ORDER BY ctr DESC NULLS LAST, creative_type, creative_message LIMIT 5)",
)
def _(spark, d):
    picked = rank.creative_inputs(run_tasks(t.ads(spark, d), _TASKS))
    worst = picked.worst_campaigns.select(
        F.lit("worst").alias("side"), F.col("campaign").alias("name"), F.col("adset").alias("part"), "ctr", "spend"
    )
    best = picked.best_creatives.select(
        F.lit("best").alias("side"), F.col("message").alias("name"), F.col("type").alias("part"),
        F.round("ctr", 9).alias("ctr"), F.lit(None).cast("double").alias("spend"),
    )
    return worst.unionByName(best)


@query("default_task_trend", _trend_sql("roas", 7))
def _(spark, d):
    results = run_tasks(t.ads(spark, d), default_tasks())
    out = next(r.data for r in results if isinstance(r.data, Trend)).summary
    return rounded(rounded(out, 9, "recent_avg", "previous_avg"), 6, "change_pct")


@query("sample_rows", ADS + "SELECT CAST(date AS VARCHAR) AS date, campaign_name, adset_name, impressions, clicks, purchases FROM ads "
       "ORDER BY md5(concat_ws('|', '42', coalesce(CAST(date AS VARCHAR), '~'), coalesce(campaign_name, '~'), coalesce(adset_name, '~'), "
       "coalesce(CAST(impressions AS VARCHAR), '~'), coalesce(CAST(clicks AS VARCHAR), '~'), coalesce(CAST(purchases AS VARCHAR), '~'))) LIMIT 1000")
def _(spark, d):
    facts = t.ads(spark, d, ["date", "campaign_name", "adset_name", "impressions", "clicks", "purchases"])
    return sample_rows(facts, 1000, seed=42).withColumn("date", day())


# --- thresholds and requests ------------------------------------------------------------------------
_OVERRIDES = {"C1": {"ctr": 0.025, "roas": 2.0}, "C2": {"ctr": 0.008, "roas": 0.8}, "C7": {"cpc": 0.4}}
_DEFAULT_SQL = (
    "coalesce(CASE {m} WHEN 'ctr' THEN CAST(0.01 AS DOUBLE) WHEN 'cvr' THEN 0.02 WHEN 'roas' THEN 1.0 END, "
    "CASE {m} WHEN 'ctr' THEN CAST(0.01 AS DOUBLE) WHEN 'cvr' THEN 0.01 WHEN 'roas' THEN 1.0 WHEN 'confidence' THEN 0.6 "
    "WHEN 'quality' THEN 0.7 WHEN 'roas_change' THEN 0.15 WHEN 'min_spend' THEN 100.0 END, 0.01)"
)
_FACTOR_SQL = (
    "CAST(CASE {q} WHEN 'volatile' THEN CASE {m} WHEN 'quality' THEN 0.85 ELSE 0.7 END "
    "WHEN 'stable' THEN CASE {m} WHEN 'quality' THEN 1.1 ELSE 1.2 END ELSE 1.0 END AS DOUBLE)"
)


def _resolved_sql(override: str) -> str:
    base = _DEFAULT_SQL.format(m="metric")
    factor = _FACTOR_SQL.format(m="metric", q="data_quality")
    source = (
        "CASE WHEN o IS NOT NULL THEN 'campaign' WHEN metric IN ('ctr','cvr','roas') THEN 'metric' "
        "WHEN metric IN ('confidence','quality','roas_change','min_spend') THEN 'global' ELSE 'fallback' END"
    )
    return (
        f"SELECT request_id, metric, campaign_id, data_quality, coalesce(o, {base}) AS base_threshold, {factor} AS multiplier, "
        f"round(coalesce(o, {base}) * {factor}, 9) AS threshold, {source} AS source FROM ({override})"
    )


_INLINE = "SELECT *, CAST(CASE " + " ".join(
    f"WHEN campaign_id = '{c}' AND metric = '{m}' THEN {v}" for c, ms in _OVERRIDES.items() for m, v in ms.items()
) + " END AS DOUBLE) AS o FROM requests"


@query("thresholds_resolved", t.requests_sql(t.THRESHOLD_REQUEST) + _resolved_sql(_INLINE))
def _(spark, d):
    asked = t.requests(spark, d, t.THRESHOLD_REQUEST)
    return rounded(thresholds.resolve_thresholds(asked, ThresholdConfig(campaigns=_OVERRIDES)), 9, "threshold")


_TABLE_OVERRIDES = (
    "SELECT concat('C', CAST(o_custkey % 25 AS VARCHAR(4))) AS campaign_id, 'ctr' AS metric, "
    "CAST(max(o_orderkey % 100) AS DOUBLE) / 1000 AS threshold FROM orders GROUP BY 1"
)


@query(
    "thresholds_override_table",
    t.requests_sql(t.THRESHOLD_REQUEST)
    + _resolved_sql(f"SELECT r.*, v.threshold AS o FROM requests r LEFT JOIN ({_TABLE_OVERRIDES}) v ON r.campaign_id = v.campaign_id AND r.metric = v.metric"),
)
def _(spark, d):
    orders = t.table(spark, d, "orders")
    overrides = orders.groupBy(F.expr("concat('C', CAST(o_custkey % 25 AS VARCHAR(4)))").alias("campaign_id")).agg(
        F.lit("ctr").alias("metric"), F.expr("CAST(max(o_orderkey % 100) AS DOUBLE) / 1000").alias("threshold")
    )
    asked = t.requests(spark, d, t.THRESHOLD_REQUEST)
    return rounded(thresholds.resolve_thresholds(asked, overrides=overrides), 9, "threshold")


_METRIC_SQL = (
    "CASE lower(trim(metric)) WHEN 'sales' THEN 'revenue' WHEN 'conversions' THEN 'purchases' WHEN 'cost' THEN 'spend' "
    + " ".join(f"WHEN '{m}' THEN '{m}'" for m in (*BASES, "ctr", "roas", "cvr", "cpc", "cpm"))
    + " ELSE CASE task_type WHEN 'identify_underperformers' THEN 'ctr' ELSE 'roas' END END"
)


@query(
    "requests_normalized",
    t.requests_sql(t.REQUEST)
    + f", named AS (SELECT *, {_METRIC_SQL} AS metric_used FROM requests) SELECT request_id, task_type, metric, threshold, timeframe, metric_used, "
    "CASE WHEN contains(lower(threshold), 'zero') THEN 0.0 WHEN contains(lower(threshold), 'top') THEN "
    + _DEFAULT_SQL.format(m="metric_used")
    + " ELSE coalesce(TRY_CAST(trim(threshold) AS DOUBLE), "
    + _DEFAULT_SQL.format(m="metric_used")
    + ") END AS threshold_used, coalesce(TRY_CAST(regexp_extract(timeframe, 'last_(\\d+)', 1) AS INTEGER), 7) AS days_used FROM named",
)
def _(spark, d):
    return requests.normalize_requests(t.requests(spark, d, t.REQUEST))


@query(
    "metric_bounds",
    t.requests_sql(t.THRESHOLD_REQUEST)
    + "SELECT request_id, metric, CAST(CASE metric WHEN 'ctr' THEN 0.005 WHEN 'cvr' THEN 0.01 WHEN 'roas' THEN 0.5 WHEN 'cpc' THEN 0.2 END AS DOUBLE) AS low, "
    'CAST(CASE metric WHEN \'ctr\' THEN 0.01 WHEN \'cvr\' THEN 0.02 WHEN \'roas\' THEN 1.0 WHEN \'cpc\' THEN 0.4 END AS DOUBLE) AS "default", '
    "CAST(CASE metric WHEN 'ctr' THEN 0.05 WHEN 'cvr' THEN 0.1 WHEN 'roas' THEN 2.5 WHEN 'cpc' THEN 0.8 END AS DOUBLE) AS high FROM requests",
)
def _(spark, d):
    config = ThresholdConfig(
        metrics={
            "ctr": MetricBounds(0.005, 0.01, 0.05), "cvr": MetricBounds(0.01, 0.02, 0.10),
            "roas": MetricBounds(0.5, 1.0, 2.5), "cpc": 0.4,
        }
    )
    asked = t.requests(spark, d, t.THRESHOLD_REQUEST).select("request_id", "metric")
    return thresholds.with_metric_bounds(asked, config)


@query(
    "performance_tier",
    ADS + f"SELECT *, CASE WHEN roas < 0.5 THEN 'low' WHEN roas < 2.5 THEN 'average' WHEN roas IS NOT NULL THEN 'high' END AS roas_tier, "
    f"CASE WHEN cvr < 0.01 THEN 'low' WHEN cvr < 0.1 THEN 'average' WHEN cvr IS NOT NULL THEN 'high' END AS cvr_tier FROM ({PAIRS})",
)
def _(spark, d):
    pairs = rollups.campaign_adset_rollup(t.ads(spark, d, _PAIR_COLUMNS))
    return thresholds.with_performance_tier(thresholds.with_performance_tier(pairs, "roas"), "cvr")


_CV = (
    "cv AS (SELECT count(DISTINCT campaign_name) AS sample_size, stddev_samp(ctr)/avg(ctr) AS ctr_cv, "
    "stddev_samp(roas)/avg(roas) AS roas_cv, stddev_samp(cvr)/avg(cvr) AS cvr_cv FROM ads), "
    "level AS (SELECT *, (ctr_cv + roas_cv + cvr_cv)/3 AS avg_cv, CASE WHEN (ctr_cv + roas_cv + cvr_cv)/3 > 0.5 THEN 'high' "
    "WHEN (ctr_cv + roas_cv + cvr_cv)/3 < 0.2 THEN 'low' ELSE 'medium' END AS variance_level FROM cv), "
    "quality AS (SELECT *, CASE WHEN variance_level = 'high' THEN 'volatile' WHEN variance_level = 'low' AND sample_size > 50 "
    "THEN 'stable' ELSE 'medium' END AS quality_level FROM level) "
)
_CV_COLUMNS = ["campaign_name", "ctr", "roas", "cvr"]


@query(
    "cv_quality",
    ADS + ", " + _CV + "SELECT sample_size, round(ctr_cv, 6) AS ctr_cv, round(roas_cv, 6) AS roas_cv, round(cvr_cv, 6) AS cvr_cv, "
    "round(avg_cv, 6) AS avg_cv, variance_level, quality_level FROM quality",
)
def _(spark, d):
    out = thresholds.assess_data_quality(t.ads(spark, d, _CV_COLUMNS))
    return rounded(out, 6, "ctr_cv", "roas_cv", "cvr_cv", "avg_cv")


@query(
    "cv_quality_dirty",
    ADS.rstrip() + ", n AS (SELECT count(DISTINCT campaign_name) AS sample_size FROM ads) SELECT sample_size, 'medium' AS variance_level, 'medium' AS quality_level FROM n",
)
def _(spark, d):
    """One infinite value leaves no usable variation."""
    facts = t.ads(spark, d, ["campaign_name", "impressions", "ctr", "roas"], roas="CASE WHEN impressions % 7000 = 0 THEN double('infinity') ELSE roas END")
    return thresholds.assess_data_quality(facts).select("sample_size", "variance_level", "quality_level")


@query(
    "coefficient_of_variation",
    ADS + ", " + _CV + "SELECT (SELECT count(*) FROM ads) AS total_rows, round(ctr_cv, 6) AS ctr_cv, round(roas_cv, 6) AS roas_cv, "
    "round(cvr_cv, 6) AS cvr_cv, round(avg_cv, 6) AS avg_cv FROM quality",
)
def _(spark, d):
    out = thresholds.coefficient_of_variation(t.ads(spark, d, ["ctr", "roas", "cvr"]))
    return rounded(out, 6, "ctr_cv", "roas_cv", "cvr_cv", "avg_cv")


@query(
    "quality_from_summary",
    ADS
    + "SELECT sample_size, variance_level, CASE WHEN variance_level = 'high' THEN 'volatile' ELSE 'medium' END AS quality_level FROM ("
    "SELECT count(DISTINCT campaign_name) AS sample_size, CASE WHEN count(DISTINCT campaign_name) < 10 OR avg(roas) < 0.5 OR avg(roas) > 5 "
    "THEN 'high' ELSE 'medium' END AS variance_level FROM ads)",
)
def _(spark, d):
    return thresholds.assess_quality_from_summary(rollups.dataset_summary(t.ads(spark, d, ["campaign_name", "roas"])))


@query(
    "adapted_thresholds",
    ADS + ", " + _CV + "SELECT variance_level, "
    + ", ".join(
        f"round({v} * CASE variance_level WHEN 'high' THEN 0.7 WHEN 'low' THEN 1.2 ELSE CAST(1.0 AS DOUBLE) END, 9) AS {m}_threshold"
        for m, v in (("ctr", 0.01), ("cvr", 0.02), ("roas", 1.0))
    )
    + " FROM quality",
)
def _(spark, d):
    quality = thresholds.assess_data_quality(t.ads(spark, d, _CV_COLUMNS))
    return rounded(thresholds.adapt_thresholds(quality), 9, "ctr_threshold", "cvr_threshold", "roas_threshold")


@query(
    "historical_threshold",
    ADS + "SELECT 'roas' AS metric, count(roas) AS samples, round(quantile_cont(roas, 0.25), 9) AS threshold FROM ads",
)
def _(spark, d):
    return rounded(thresholds.historical_threshold(t.ads(spark, d, ["roas"]), "roas"), 9, "threshold")


@query(
    "historical_threshold_recent",
    ADS + "SELECT 'ctr' AS metric, count(ctr) AS samples, round(quantile_cont(ctr, 0.4), 9) AS threshold FROM ads "
    "WHERE date > DATE '2000-01-01' - 365",
)
def _(spark, d):
    facts = t.ads(spark, d, ["date", "ctr"])
    out = thresholds.historical_threshold(facts, "ctr", 40, lookback_days=365, as_of="2000-01-01")
    return rounded(out, 9, "threshold")


@query(
    "historical_threshold_by_campaign",
    ADS
    + "SELECT campaign_name, adset_name, 'roas' AS metric, count(roas) AS samples, "
    "CASE WHEN count(roas) >= 380 THEN round(quantile_cont(roas, 0.25), 9) END AS threshold FROM ads GROUP BY 1, 2",
)
def _(spark, d):
    facts = t.ads(spark, d, ["campaign_name", "adset_name", "roas"])
    out = thresholds.historical_threshold(facts, "roas", min_samples=380, by=["campaign_name", "adset_name"])
    return rounded(out, 9, "threshold")


# --- baseline and drift -----------------------------------------------------------------------------
CREATED = "2024-03-01 00:00:00"
_BASE_COLUMNS = ["date", "spend", "ctr", "roas", "cvr"]


def _baseline_sql(source: str = "ads") -> str:
    parts = [
        f"SELECT '{m}' AS metric, avg(CAST({m} AS DOUBLE)) AS mean, stddev_samp(CAST({m} AS DOUBLE)) AS std, "
        f"quantile_cont(CAST({m} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({m} AS DOUBLE), 0.25) AS p25, "
        f"quantile_cont(CAST({m} AS DOUBLE), 0.75) AS p75, min(CAST({m} AS DOUBLE)) AS min, max(CAST({m} AS DOUBLE)) AS max, "
        f"count({m}) AS cnt, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, count(*) AS total_rows FROM {source}"
        for m in ("roas", "ctr", "cvr", "spend")
    ]
    return " UNION ALL ".join(parts)


_STATS = ("mean", "std", "median", "p25", "p75", "min", "max")


@query(
    "baseline_stats",
    ADS
    + "SELECT metric, start_date, end_date, total_rows, cnt, "
    + ", ".join(f"round({s}, 6) AS {s}" for s in _STATS)
    + f" FROM ({_baseline_sql()})",
)
def _(spark, d):
    out = baseline.baseline_stats(t.ads(spark, d, _BASE_COLUMNS), created_at=CREATED).drop("created_at")
    out = out.withColumns({"start_date": day("start_date"), "end_date": day("end_date")})
    return rounded(out, 6, *_STATS)


@query(
    "baseline_age",
    ADS + f"SELECT metric, cnt, 30.25 AS age_days FROM ({_baseline_sql()})".replace("30.25", "CAST(30.25 AS DOUBLE)"),
)
def _(spark, d):
    stats = baseline.baseline_stats(t.ads(spark, d, _BASE_COLUMNS), created_at=CREATED)
    return baseline.with_baseline_age(stats, "2024-03-31 06:00:00").select("metric", "cnt", "age_days")


@query("baseline_updated", ADS + f"SELECT metric, cnt, round(mean, 9) AS mean, round(median, 9) AS median FROM ({_baseline_sql()})")
def _(spark, d):
    """A second version stored over a first one of fewer rows; the newest counts."""
    path = f"{staging_dir(spark)}/baseline-{uuid.uuid4().hex}"
    facts = t.ads(spark, d, _BASE_COLUMNS)
    baseline.update_baseline(facts.where("date < '1995-01-01'"), path, created_at="2024-01-01 00:00:00")
    stored = baseline.update_baseline(facts, path, created_at=CREATED)
    return rounded(stored.select("metric", "cnt", "mean", "median"), 9, "mean", "median")


@query(
    "stored_baseline_damaged",
    ADS + f"SELECT metric, cnt, round(mean, 9) AS mean, round(median, 9) AS median, 'damaged,unfinished,whole,whole' AS states FROM ({_baseline_sql()})",
)
def _(spark, d):
    """Four versions, of which the newest is damaged and one is unfinished: the newest whole one counts."""
    path = f"{staging_dir(spark)}/baseline-{uuid.uuid4().hex}"
    facts = t.ads(spark, d, _BASE_COLUMNS)
    old = baseline.baseline_stats(facts.where("date < '1995-01-01'"), created_at="2024-01-01 00:00:00")
    baseline.write_baseline(old, path)
    baseline.update_baseline(facts, path, created_at=CREATED)
    baseline.write_baseline(old.withColumn("created_at", F.lit("2024-05-01").cast("timestamp")), path)
    newest = baseline.baseline_versions(spark, path).orderBy(F.desc("created_at")).first().version
    spark.range(1).select(F.lit("no table").alias("value")).write.mode("append").text(f"{path}/{newest}/data/baseline")
    old.write.parquet(f"{path}/v-{uuid.uuid4().hex}/data/baseline")
    stored = rounded(baseline.read_baseline(spark, path).select("metric", "cnt", "mean", "median"), 9, "mean", "median")
    states = baseline.baseline_versions(spark, path).agg(F.array_join(F.array_sort(F.collect_list("state")), ","))
    return stored.withColumn("states", states.scalar())


@query(
    "baseline_from_days",
    ADS
    + "SELECT metric, start_date, end_date, total_rows, cnt, "
    + ", ".join(f"round({s}, 6) AS {s}" for s in _STATS)
    + f" FROM ({_baseline_sql()})",
)
def _(spark, d):
    """Days added in three parts, one of them twice; the facts are not read again for the baseline."""
    path = f"{staging_dir(spark)}/baseline-days-{uuid.uuid4().hex}"
    facts = t.ads(spark, d, _BASE_COLUMNS)
    first, second = "date < '1994-06-01'", "date >= '1994-06-01' and date < '1996-01-01'"
    baseline.add_days(facts.where(first), path)
    baseline.add_days(facts.where(second).where("roas < 1"), path)
    baseline.add_days(facts.where(second), path)
    baseline.add_days(facts.where(f"not ({first}) and not ({second}) or date is null"), path)
    out = baseline.baseline_from_days(spark, path, created_at=CREATED).drop("created_at")
    out = out.withColumns({"start_date": day("start_date"), "end_date": day("end_date")})
    return rounded(out, 6, *_STATS)


def _drift_rows_sql(factors: dict[str, float], known: str = "true") -> str:
    """Drift and outlier alerts of ``ads`` with scaled metrics against ``ads``; metrics count where ``known``."""
    now = "now AS (SELECT " + ", ".join(f"CASE WHEN {known} THEN {m} * {factors.get(m, 1.0)} END AS {m}" for m in ("roas", "ctr", "cvr")) + " FROM ads)"
    parts = []
    for m, limit in (("roas", 0.5), ("ctr", 0.3), ("cvr", 0.3)):
        parts.append(
            f"SELECT '{m}' AS metric, b.mean AS base_mean, b.std AS base_std, b.median AS base_median, {limit} AS lim, "
            f"avg(n.{m}) AS now_mean, stddev_samp(n.{m}) AS now_std, quantile_cont(n.{m}, 0.5) AS now_median, count(*) AS n, "
            f"count(*) FILTER (WHERE n.{m} < b.mean * (1 - {limit})) AS below, "
            f"count(*) FILTER (WHERE abs((n.{m} - b.mean)/b.std) > 3) AS n_out, "
            f"avg(n.{m}) FILTER (WHERE abs((n.{m} - b.mean)/b.std) > 3) AS out_mean, "
            f"stddev_samp(n.{m}) FILTER (WHERE abs((n.{m} - b.mean)/b.std) > 3) AS out_std, "
            f"max(abs((n.{m} - b.mean)/b.std)) AS max_z "
            f"FROM now n, (SELECT * FROM stats WHERE metric = '{m}') b GROUP BY b.mean, b.std, b.median"
        )
    return (
        ADS
        + f", stats AS ({_baseline_sql()}), {now}, wide AS ({' UNION ALL '.join(parts)}), "
        "drift AS (SELECT *, (now_mean - base_mean)/base_mean AS c FROM wide), alerts AS ("
        "SELECT metric, 'drift' AS kind, CASE WHEN c < -lim AND abs(c) > 0.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, "
        "base_mean AS baseline_value, now_mean AS current_value, c * 100 AS change_pct, CASE WHEN c < -lim THEN below ELSE 0 END AS affected_rows, "
        "base_std AS a, now_std AS b, CASE WHEN c < -lim THEN base_median END AS e, CASE WHEN c < -lim THEN now_median END AS f "
        "FROM drift WHERE c < -lim OR c > 2 * lim UNION ALL "
        "SELECT metric, 'outlier', CASE WHEN 100.0 * n_out / n > 10 THEN 'WARNING' ELSE 'INFO' END, base_mean, out_mean, 0.0, n_out, max_z, out_mean, out_std, "
        "100.0 * n_out / n FROM wide WHERE n_out > 0) "
    )


_DRIFT_OUT = (
    "SELECT metric, kind, severity, round(baseline_value, 6) AS baseline_value, round(current_value, 6) AS current_value, "
    "round(change_pct, 6) AS change_pct, affected_rows, round(a, 6) AS detail_1, round(b, 6) AS detail_2, round(e, 6) AS detail_3, "
    "round(f, 6) AS detail_4 FROM alerts"
)


def _drift_out(df):
    det = F.col("details")
    is_drift = F.col("kind") == "drift"
    pairs = (
        ("baseline_std", "max_z_score"), ("current_std", "outlier_mean"),
        ("baseline_median", "outlier_std"), ("current_median", "outlier_pct"),
    )
    out = df.select(
        "metric", "kind", "severity", "baseline_value", "current_value", "change_pct", "affected_rows",
        *[F.when(is_drift, F.try_element_at(det, F.lit(a))).otherwise(F.try_element_at(det, F.lit(b))).alias(f"detail_{i}")
          for i, (a, b) in enumerate(pairs, 1)],
    )
    return rounded(out, 6, "baseline_value", "current_value", "change_pct", *[f"detail_{i}" for i in range(1, 5)])


def _drift_inputs(spark, d, columns=("ctr", "roas", "cvr"), **factors):
    # four rows, kept as a stored baseline would be
    base = settle(baseline.baseline_stats(t.ads(spark, d, ["date", "ctr", "roas", "cvr"]), ["roas", "ctr", "cvr"], CREATED))
    current = t.ads(spark, d, columns, **{m: f"{m} * {f}" for m, f in factors.items()})
    return current, base


@query("drift_roas_drop", _drift_rows_sql({"roas": 0.4}) + _DRIFT_OUT + " WHERE kind = 'drift'")
def _(spark, d):
    return _drift_out(drift.metric_drift(*_drift_inputs(spark, d, roas=0.4)))


_DIRTY = "impressions % 7000 <> 0"


@query("drift_dirty", _drift_rows_sql({"roas": 0.4, "ctr": 0.9}, _DIRTY) + _DRIFT_OUT)
def _(spark, d):
    """Roas partly not a number, ctr and cvr as text that partly is no number."""
    _, base = _drift_inputs(spark, d)
    current = t.ads(spark, d, ["impressions", "roas", "ctr", "cvr"]).selectExpr(
        f"CASE WHEN {_DIRTY} THEN roas * 0.4 ELSE double('NaN') END AS roas",
        f"CASE WHEN {_DIRTY} THEN cast(ctr * 0.9 AS string) ELSE 'n/a' END AS ctr",
        f"CASE WHEN {_DIRTY} THEN cast(cvr AS string) ELSE 'NaN' END AS cvr",
    )
    return _drift_out(drift.detect_drift(current, base))


@query("drift_mixed", _drift_rows_sql({"roas": 2.5, "ctr": 0.6, "cvr": 1.7}) + _DRIFT_OUT)
def _(spark, d):
    return _drift_out(drift.detect_drift(*_drift_inputs(spark, d, roas=2.5, ctr=0.6, cvr=1.7)))


@query("outlier_alerts", _drift_rows_sql({}) + _DRIFT_OUT + " WHERE kind = 'outlier'")
def _(spark, d):
    return _drift_out(drift.outliers(*_drift_inputs(spark, d)))


@query(
    "outlier_rows",
    ADS + f", stats AS ({_baseline_sql()}) "
    + " UNION ALL ".join(
        f"SELECT CAST(a.date AS VARCHAR) AS date, a.campaign_name, '{m}' AS outlier_metric, a.{m} AS outlier_value, "
        f"round((a.{m} - s.mean) / s.std, 6) AS z_score FROM ads a, stats s WHERE s.metric = '{m}' AND abs((a.{m} - s.mean) / s.std) > 3"
        for m in ("roas", "ctr", "cvr")
    ),
)
def _(spark, d):
    out = drift.outlier_rows(*_drift_inputs(spark, d, ("date", "campaign_name", "ctr", "roas", "cvr")))
    return rounded(out.select(day(), "campaign_name", "outlier_metric", "outlier_value", "z_score"), 6, "z_score")


@query(
    "drift_summary",
    _drift_rows_sql({"roas": 0.4, "ctr": 0.6})
    + "SELECT count(*) > 0 AS has_drift, count(*) AS num_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_alerts, "
    "count(*) FILTER (WHERE severity = 'WARNING') AS warning_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') > 0 AS suggest_reset FROM alerts",
)
def _(spark, d):
    current, base = _drift_inputs(spark, d, roas=0.4, ctr=0.6)
    return drift.drift_summary(drift.detect_drift(current, base, medians=False))


@query("stored_baseline_drift", _drift_rows_sql({"roas": 0.4, "ctr": 0.6}) + _DRIFT_OUT)
def _(spark, d):
    path = f"{staging_dir(spark)}/baseline-{uuid.uuid4().hex}"
    facts = t.ads(spark, d, ["date", "ctr", "roas", "cvr"])
    first = drift.check_or_create_baseline(facts, path, created_at=CREATED)
    assert first.created
    current = t.ads(spark, d, ["date", "ctr", "roas", "cvr"], roas="roas * 0.4", ctr="ctr * 0.6")
    return _drift_out(drift.check_or_create_baseline(current, path).alerts)


@query(
    "drift_digest",
    _drift_rows_sql({"roas": 2.5, "cvr": 1.7})
    + "SELECT CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS rank, metric, kind, CASE WHEN kind = 'drift' THEN "
    "printf('%s increased %.1f%% - verify data quality', upper(metric), change_pct) || printf(chr(10) || '   Baseline: %.3f' || chr(10) || '   Current: %.3f' || chr(10) || "
    "'   Change: %+.1f%%', baseline_value, current_value, change_pct) "
    "ELSE printf('%d rows (%.1f%%) have outlier %s values', affected_rows, f, upper(metric)) || CASE WHEN severity = 'INFO' THEN '' "
    "ELSE printf(chr(10) || '   Affected: %d rows', affected_rows) END END AS text FROM alerts",
)
def _(spark, d):
    current, base = _drift_inputs(spark, d, roas=2.5, cvr=1.7)
    return drift_digest(drift.detect_drift(current, base, medians=False))
