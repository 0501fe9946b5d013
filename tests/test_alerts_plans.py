import datetime as dt


from adtide.operators import alerts, quality, report
from adtide.plans import staging
from adtide.plans.analyze import analyze
from adtide.sources import files
from tests.frames import insight, task_frame

TS = dt.datetime(2025, 1, 1)


def _alerts(spark):
    rows = [
        ("CRITICAL", "evaluator", "m1", {"b": "2", "a": "1"}, "fix", "x", TS),
        ("INFO", "health", "m2", {}, None, "x", TS + dt.timedelta(hours=1)),
        ("WARNING", "health", "m3", {}, "look", "x", TS + dt.timedelta(hours=2)),
        ("INFO", "health", "m4", {}, None, None, TS + dt.timedelta(hours=3)),
    ]
    return spark.createDataFrame(rows, "severity string, source string, message string, details map<string,string>, recommendation string, alert_id string, ts timestamp")


def test_alert_tables(spark):
    df = _alerts(spark)
    row = alerts.alert_summary(df).first()
    assert (row.total_alerts, row.critical_count, row.warning_count, row.info_count, row.source_count, row.has_critical) == (4, 1, 1, 2, 2, True)
    assert alerts.filter_alerts(df, "INFO", "health").count() == 2
    assert [(r.alert_id, r.cnt) for r in alerts.recurring_alerts(df).collect()] == [("x", 3)]
    assert [r.message for r in alerts.alert_history(df, 2).collect()] == ["m4", "m3"]
    lines = alerts.alert_digest(df).orderBy("section", "rank").collect()
    assert lines[0].text == "CRITICAL: m1\n   Source: evaluator\n   a: 1\n   b: 2\n   Recommendation: fix"
    assert lines[-1].text == "fix (evaluator)" and len(lines) == 5
    assert {r.source: r.cnt for r in alerts.alert_sources(df).collect()} == {"evaluator": 1, "health": 3}


def test_health_alerts(spark):
    health = quality.run_health_checks(task_frame(spark), "2025-01-13 00:00:00")
    made = {r.alert_id: r for r in alerts.make_alerts(health=health, ts="2025-01-13").collect()}
    assert made["missing_data"].details["days_missing"] == "8" and made["data_freshness"].severity == "WARNING"
    empty = quality.run_health_checks(task_frame(spark).where("false"), "2025-01-13 00:00:00")
    (only,) = alerts.make_alerts(health=empty, ts="2025-01-13").collect()
    assert only.message == "The newest row is older than 999 days" and only.details["last_data_date"] == "unknown"
    reports = spark.createDataFrame([(0.55, 4, 1), (0.2, 4, 4), (0.9, 4, 0)], "overall_quality double, total_insights long, rejected_count long")
    got = [(r.severity, r.details["rejected"]) for r in alerts.quality_alerts(reports).collect()]
    assert got == [("WARNING", "1/4"), ("CRITICAL", "4/4")]


def test_analyze_end_to_end(spark, tmp_path):
    tasks = [
        {"task_type": "analyze_metric_trend", "parameters": {"metric": "roas", "timeframe": "last_2_days"}},
        {"task_type": "identify_underperformers", "parameters": {"metric": "ctr", "threshold": 0.02}},
    ]
    out = analyze(task_frame(spark), tasks=tasks, as_of="2025-01-06 06:00:00")
    assert out.health_summary.first().total_checks == 5 and out.drift is None
    assert out.insights.first().hypothesis == "roas moved by 25.0% against the days before"
    assert [r.campaign for r in out.creatives.collect()] == ["c0", "c2", "c4"]
    assert out.evaluation.report.first().total_insights == 1
    assert out.alerts.where("alert_id = 'quality_below_threshold'").count() == 1
    files.write_report(out.report, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "### c0" in text and "**Confidence:** 50%" in text and "Below the bar" in text
    files.write_creatives(out.creatives, str(tmp_path / "creatives"))
    assert files.read_creatives(spark, str(tmp_path / "creatives")).count() == 3


def test_analyze_without_trends(spark):
    out = analyze(task_frame(spark), tasks=[{"task_type": "creative_analysis"}], as_of="2025-01-06")
    assert out.insights.first().id == "fallback_generic" and out.creatives.count() == 0


def test_staging_writes_to_the_named_folder(spark):
    folder = staging.staging_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder and (named is None or folder == named)
    kept = staging.settle(spark.range(3))
    assert kept.count() == 3 and all(folder.split(":")[-1] in f for f in kept.inputFiles())


def test_report_fills_gaps(spark):
    rows = report.report_sections(insight(spark, {"id": "a", "evidence": ["e1", "e2"]})).collect()
    assert "### N/A" in rows[0].body and "- e1\n- e2" in rows[0].body and "**Confidence:** 0%" in rows[0].body
