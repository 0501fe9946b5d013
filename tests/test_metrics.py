import datetime as dt

import pytest
from pyspark.sql import functions as F

from adtide.operators import rank, requests, rollups, thresholds, trends
from adtide.plans import tasks
from adtide.schema import MetricBounds, ThresholdConfig
from tests.frames import DAY, drift_frame, task_frame


def test_null_keys_form_no_group(spark):
    df = task_frame(spark).withColumn("campaign_name", F.when(F.col("clicks") != 10, F.col("campaign_name")))
    assert rollups.campaign_adset_rollup(df).count() == 4
    assert {r.value for r in rollups.value_counts(df.withColumn("platform", F.lit(None).cast("string"))).collect()} == {"Image", "Video"}


def test_summary_and_overview(spark):
    row = rollups.dataset_summary(task_frame(spark)).first()
    assert (row.total_rows, row.days, row.campaign_count, row.total_clicks, row.total_spend) == (5, 4, 5, 190, 1000.0)
    assert row.start_date == DAY and abs(row.avg_roas - 4.6) < 1e-12
    bare = rollups.dataset_summary(spark.range(3)).first()
    assert (bare.total_rows, bare.start_date, bare.total_spend, bare.avg_ctr, bare.campaign_count) == (3, None, 0.0, 0.0, 0)
    over = rollups.campaign_overview(task_frame(spark), names=3).first()
    assert over.campaign_count == 5 and over.first_names == ["c0", "c1", "c2"]


def test_trend_uses_days_with_data(spark):
    df = task_frame(spark)
    row = trends.metric_trend(df, "roas", 2).first()
    assert (row.recent_avg, row.previous_avg, row.change_pct, row.trend) == (5.0, 4.0, 25.0, "increasing")
    alone = trends.metric_trend(df, "roas", 7).first()
    assert (alone.recent_avg, alone.previous_avg, alone.change_pct, alone.trend) == (4.6, None, None, "decreasing")
    summary = trends.time_series_summary(df, "roas", 7).first()
    assert (summary.previous_avg, summary.change_pct, summary.trend) == (0.0, 0.0, "decreasing")
    values = [(r.date, r.roas) for r in trends.daily_values(df, "roas", 3).collect()]
    assert values == [(DAY + dt.timedelta(days=i), v) for i, v in ((2, 2.0), (3, 6.0), (4, 4.0))]


def test_trend_previous_shorter_than_recent(spark):
    row = trends.metric_trend(task_frame(spark), "roas", 3).first()
    assert row.recent_avg == 4.0 and row.previous_avg == 5.5


def test_underperformers_filters_and_orders(spark):
    df = task_frame(spark)
    out = rank.underperformers(df, "ctr", 0.02)
    assert [r.campaign_name for r in out.top.collect()] == ["c0", "c2", "c4"]
    assert out.total.first()["count"] == 3
    zero = rank.underperformers(df.withColumn("revenue", F.when(F.col("spend") < 180, 0.0).otherwise(F.col("revenue"))), "revenue", 0.0)
    assert [r.campaign_name for r in zero.top.collect()] == ["c2", "c0"]


def test_every_ratio_works_for_segments(spark):
    for metric in ("ctr", "roas", "cvr", "cpc", "cpm"):
        values = [r[metric] for r in rank.segment_analysis(task_frame(spark), "creative_type", metric).collect()]
        assert values == sorted(values, reverse=True) and len(values) == 2


def test_creative_lists_keep_unrated_last(spark):
    df = task_frame(spark).withColumn("ctr", F.when(F.col("clicks") != 90, F.col("ctr")))
    got = rank.creative_analysis(df)
    assert [r.creative_message for r in got.top.collect()][0] == "m1"
    assert got.top.collect()[-1].creative_message == "m3" == got.bottom.collect()[-1].creative_message
    assert rollups.creative_variant_count(df).first()[0] == 5


def test_resolution_order(spark):
    config = ThresholdConfig(campaigns={"vip": {"ctr": 0.025}}, metrics={"ctr": MetricBounds(0.005, 0.012, 0.05), "cpc": 0.4})
    asked = spark.createDataFrame(
        [("ctr", "vip", "volatile"), ("ctr", "x", "stable"), ("roas", None, None), ("confidence", None, "volatile"),
         ("quality", None, "stable"), ("cpc", None, "medium"), ("other", None, "volatile")],
        "metric string, campaign_id string, data_quality string",
    )
    got = {(r.metric, r.campaign_id): (round(r.threshold, 9), r.source) for r in thresholds.resolve_thresholds(asked, config).collect()}
    assert got == {
        ("ctr", "vip"): (0.0175, "campaign"), ("ctr", "x"): (0.0144, "metric"), ("roas", None): (1.0, "global"),
        ("confidence", None): (0.42, "global"), ("quality", None): (0.77, "global"), ("cpc", None): (0.4, "metric"),
        ("other", None): (0.007, "fallback"),
    }
    plain = thresholds.resolve_thresholds(asked, config, use_adaptive=False)
    assert plain.where("multiplier <> 1").count() == 0
    bounds = {r.metric: (r.low, r.default, r.high) for r in thresholds.with_metric_bounds(asked, config).collect()}
    assert bounds["cpc"] == (0.2, 0.4, 0.8) and bounds["roas"] == (None, None, None)


def test_historical_threshold(spark):
    df = spark.range(200).select((F.col("id") / 10).alias("roas"), (F.col("id") % 2).alias("k"), F.lit(DAY).alias("date"))
    odd = df.unionByName(spark.createDataFrame([(float("inf"), 0, DAY), (float("nan"), 1, DAY), (None, 1, DAY)], "roas double, k long, date date"))
    row = thresholds.historical_threshold(odd, "roas").first()
    assert row.samples == 200 and abs(row.threshold - 4.975) < 1e-12
    assert thresholds.historical_threshold(odd, "roas", min_samples=201).first().threshold is None
    absent = thresholds.historical_threshold(df, "nope").first()
    assert (absent.samples, absent.threshold) == (0, None)
    grouped = {r.k: r.samples for r in thresholds.historical_threshold(odd, "roas", by=["k"]).collect()}
    assert grouped == {0: 100, 1: 100}
    assert thresholds.historical_threshold(odd.where("roas < 0"), "roas").first().samples == 0


@pytest.mark.parametrize("scale, campaigns, level", [(1.0, 20, "volatile"), (0.02, 60, "stable"), (0.02, 30, "medium"), (0.35, 30, "medium")])
def test_data_quality_levels(spark, scale, campaigns, level):
    df = spark.range(campaigns * 4).select(
        F.concat(F.lit("c"), (F.col("id") % campaigns).cast("string")).alias("campaign_name"),
        *[(1 + scale * F.when(F.col("id") % 2 == 0, 0.95).otherwise(-0.95)).alias(m) for m in ("ctr", "roas", "cvr")],
    )
    row = thresholds.assess_data_quality(df).first()
    assert row.quality_level == level and row.sample_size == campaigns
    assert thresholds.adapt_thresholds(thresholds.assess_data_quality(df)).first().ctr_threshold > 0


def test_quality_without_metrics_is_medium(spark):
    assert thresholds.assess_data_quality(spark.range(3)).first().quality_level == "medium"
    summary = spark.createDataFrame([(9, 1.0), (50, 0.4), (50, 2.0)], "campaign_count long, avg_roas double")
    assert [r.quality_level for r in thresholds.assess_quality_from_summary(summary).collect()] == ["volatile", "volatile", "medium"]


def test_tiers(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (2.5,), (None,)], "roas double")
    assert [r.roas_tier for r in thresholds.with_performance_tier(df, "roas").collect()] == ["low", "average", "high", None]


def test_normalize_requests(spark):
    asked = spark.createDataFrame(
        [("identify_underperformers", " Sales ", "zero revenue", "last_30_days"), ("identify_underperformers", "bogus", "top_5", "all"),
         ("analyze_metric_trend", "bogus", None, None), ("segment_analysis", "CTR", "1_000.5", "last_month"), ("x", None, "bad", "last_0_days")],
        "task_type string, metric string, threshold string, timeframe string",
    )
    got = [(r.metric_used, r.threshold_used, r.days_used) for r in requests.normalize_requests(asked).collect()]
    assert got == [("revenue", 0.0, 30), ("ctr", 0.01, 7), ("roas", 1.0, 7), ("ctr", 1000.5, 7), ("roas", 1.0, 0)]


def test_run_tasks(spark):
    df = task_frame(spark)
    plan = tasks.default_tasks() + [{"task_type": "segment_analysis", "parameters": {"dimension": "creative_type", "metric": "cost"}},
                                    {"task_type": "creative_analysis"}, {"task_type": "nope"}]
    got = tasks.run_tasks(df, plan)
    assert [r.task_type for r in got][:2] == ["analyze_metric_trend", "identify_underperformers"]
    assert got[-1].error and got[-1].data is None
    assert tasks.trend_results(got).first().metric == "roas"
    assert [r.spend for r in got[2].data.segments.collect()] == [500.0, 500.0]
    picked = rank.creative_inputs(got)
    assert picked.best_creatives.columns == ["message", "type", "ctr"] and picked.worst_campaigns.count() == 0
    context = tasks.insight_context(df)
    assert context.summary.count() == 1 and context.dimensions.count() == 2


def test_cv_of_constant_metric(spark):
    row = thresholds.coefficient_of_variation(drift_frame(spark).withColumn("ctr", F.lit(0.0))).first()
    assert row.ctr_cv is None and abs(row.avg_cv - (row.roas_cv + row.cvr_cv) / 2) < 1e-12
