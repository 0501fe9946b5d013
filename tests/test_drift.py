import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adtide.operators import alerts, baseline, drift
from tests.frames import DRIFT_SCHEMA, drift_frame, drift_rows

BASE = "2025-01-01 00:00:00"


def _base(spark):
    return baseline.baseline_stats(drift_frame(spark), created_at=BASE)


def test_baseline_matches_numpy(spark):
    got = {r.metric: r for r in _base(spark).collect()}
    assert set(got) == {"roas", "ctr", "cvr", "spend"}
    x = np.array([r[2] for r in drift_rows()])
    r = got["roas"]
    for have, want in ((r["mean"], x.mean()), (r["std"], x.std(ddof=1)), (r["median"], np.median(x)), (r["p25"], np.quantile(x, 0.25)),
                       (r["p75"], np.quantile(x, 0.75)), (r["min"], x.min()), (r["max"], x.max())):
        assert math.isclose(have, want, rel_tol=1e-12)
    assert r.cnt == r.total_rows == 100 and str(r.start_date) == "2025-01-01"


def test_baseline_skips_absent_metrics_and_single_row(spark):
    df = drift_frame(spark, n=1).select("date", "roas")
    (row,) = baseline.baseline_stats(df).collect()
    assert row.metric == "roas" and row["std"] is None and row["median"] == row["mean"]


def test_store_keeps_latest(spark, tmp_path):
    path = str(tmp_path / "base")
    assert baseline.read_baseline(spark, path) is None
    first = drift.check_or_create_baseline(drift_frame(spark), path, created_at=BASE)
    assert first.created and first.alerts.count() == 0
    again = drift.check_or_create_baseline(drift_frame(spark, roas=0.4), path)
    assert not again.created
    assert drift.drift_summary(again.alerts).first().suggest_reset
    updated = baseline.update_baseline(drift_frame(spark, roas=0.4), path, created_at="2025-02-01 12:00:00")
    assert updated.count() == 4
    after = drift.check_or_create_baseline(drift_frame(spark, roas=0.4), path)
    assert after.alerts.where("kind = 'drift'").count() == 0
    ages = {r.age_days for r in baseline.with_baseline_age(updated, "2025-02-11 00:00:00").collect()}
    assert ages == {9.5}


def test_unreadable_store_counts_as_none(spark, tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "part.parquet").write_text("garbage")
    assert baseline.read_baseline(spark, str(tmp_path / "base")) is None


def test_damaged_and_unfinished_versions_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "base")
    states = lambda: [r.state for r in baseline.baseline_versions(spark, path).collect()]
    assert states() == []
    first = drift.check_or_create_baseline(drift_frame(spark), path, created_at=BASE)
    baseline.update_baseline(drift_frame(spark, roas=0.4), path, created_at="2025-02-01 00:00:00")
    newest, older = sorted(p.name for p in (tmp_path / "base").iterdir()), None
    by_age = [r.version for r in baseline.baseline_versions(spark, path).collect()]
    assert sorted(by_age) == newest and states() == ["whole", "whole"]
    older = tmp_path / "base" / by_age[1]
    (tmp_path / "base" / by_age[0] / "data" / "baseline" / "part-x.parquet").write_text("garbage")
    assert states() == ["damaged", "whole"]
    again = drift.check_or_create_baseline(drift_frame(spark), path)
    assert not again.created and again.alerts.where("kind = 'drift'").count() == 0  # compared with the first version
    assert {tuple(r) for r in again.baseline.collect()} == {tuple(r) for r in first.baseline.collect()}
    for file in (older / "manifest").glob("part-*"):
        file.write_text("{ no json")
    assert sorted(states()) == ["damaged", "unfinished"]
    assert baseline.read_baseline(spark, path) is None
    fresh = drift.check_or_create_baseline(drift_frame(spark), path)  # a store without a whole version gets one
    assert fresh.created and fresh.baseline.count() == 4 and fresh.alerts.count() == 0
    assert not drift.check_or_create_baseline(drift_frame(spark), path).created


def test_a_version_that_lost_rows_is_damaged(spark, tmp_path):
    path = str(tmp_path / "base")
    baseline.update_baseline(drift_frame(spark), path, created_at=BASE)
    (version,) = (tmp_path / "base").iterdir()
    for file in (version / "data" / "baseline").glob("part-*.parquet"):
        file.unlink()
    assert [r.state for r in baseline.baseline_versions(spark, path).collect()] == ["damaged"]
    assert baseline.read_baseline(spark, path) is None


def test_baseline_from_days_equals_baseline_of_all_rows(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [*drift_rows(), (None, "x", 9.0, None, float("nan"), 1.0)]
    facts = spark.createDataFrame(rows, DRIFT_SCHEMA)
    baseline.add_days(facts.where("date < '2025-02-01' or date is null"), path)
    baseline.add_days(facts.where("date >= '2025-01-20'"), path)  # overlaps
    got = {r.metric: r for r in baseline.baseline_from_days(spark, path, created_at=BASE).collect()}
    for want in baseline.baseline_stats(facts, created_at=BASE).collect():
        for name, value in want.asDict().items():
            same = got[want.metric][name]
            assert same == value or math.isclose(same, value, rel_tol=1e-12), (want.metric, name)
    baseline.add_days(facts.where("date = '2025-01-05'").withColumn("roas", F.lit(1.0)), path)
    changed = facts.withColumn("roas", F.expr("if(date = '2025-01-05', 1D, roas)"))
    got = {r.metric: (r.cnt, r.median, r.p25) for r in baseline.baseline_from_days(spark, path).collect()}
    assert got == {r.metric: (r.cnt, r.median, r.p25) for r in baseline.baseline_stats(changed).collect()}


def test_infinite_and_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None), (2.0, None)], "roas double, ctr double")
    got = {r.metric: r for r in baseline.baseline_stats(df, ["roas", "ctr", "cvr"]).collect()}
    assert set(got) == {"roas", "ctr"} and got["roas"].median == 2.0 and got["roas"]["max"] == float("inf")
    assert (got["ctr"].cnt, got["ctr"].total_rows, got["ctr"].median, got["ctr"]["mean"]) == (0, 3, None, None)
    none = baseline.baseline_stats(df.limit(0), ["roas", "ctr"]).collect()
    assert [(r.cnt, r.total_rows, r.median) for r in none] == [(0, 0, None)] * 2


def test_roas_drop_is_critical(spark):
    (a,) = drift.metric_drift(drift_frame(spark, roas=0.4), _base(spark)).collect()
    assert (a.metric, a.severity) == ("roas", "CRITICAL") and abs(a.change_pct + 60) < 1e-9
    limit = np.mean([r[2] for r in drift_rows()]) * 0.5
    assert a.affected_rows == sum(r[2] * 0.4 < limit for r in drift_rows())
    assert abs(a.details["current_median"] - 0.4 * a.details["baseline_median"]) < 1e-12


def test_ctr_drop_is_warning_and_rise_is_flagged(spark):
    (a,) = drift.metric_drift(drift_frame(spark, ctr=0.6), _base(spark)).collect()
    assert (a.metric, a.severity) == ("ctr", "WARNING")
    (b,) = drift.metric_drift(drift_frame(spark, roas=2.5), _base(spark), medians=False).collect()
    assert b.severity == "WARNING" and "increased" in b.message and b.affected_rows == 0
    assert set(b.details) == {"baseline_std", "current_std"}


def test_outliers(spark):
    rows = [(*r[:2], 15.0 if i < 5 else r[2], *r[3:]) for i, r in enumerate(drift_rows())]
    df = spark.createDataFrame(rows, DRIFT_SCHEMA)
    alert = drift.outliers(df, _base(spark)).where("metric = 'roas'").first()
    assert alert.affected_rows >= 5 and alert.severity == "INFO" and alert.details["max_z_score"] > 3
    found = drift.outlier_rows(df, _base(spark)).where("outlier_metric = 'roas'")
    assert found.count() == alert.affected_rows and found.agg(F.min(F.abs("z_score"))).first()[0] > 3
    many = [(*r[:2], 15.0 if i < 30 else r[2], *r[3:]) for i, r in enumerate(drift_rows())]
    assert drift.outliers(spark.createDataFrame(many, DRIFT_SCHEMA), _base(spark)).where("metric = 'roas'").first().severity == "WARNING"


def test_constant_or_zero_baseline_gives_no_alert(spark):
    flat = drift_frame(spark).withColumn("roas", F.lit(0.0))
    base = baseline.baseline_stats(flat, ["roas"])
    assert drift.detect_drift(drift_frame(spark), base, limits={"roas": 0.5}).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=2, max_size=30))
def test_no_drift_against_itself(spark, values):
    df = spark.createDataFrame([(v, v / 200, v / 300) for v in values], "roas double, ctr double, cvr double")
    assert drift.metric_drift(df, baseline.baseline_stats(df, ["roas", "ctr", "cvr"]), medians=False).count() == 0


def test_drift_digest_orders_and_formats(spark):
    found = drift.detect_drift(drift_frame(spark, roas=0.4), _base(spark))
    lines = [r.text for r in alerts.drift_digest(found).orderBy("rank", "metric").collect()]
    assert lines[0].startswith("ROAS dropped 60.0%") and "Change: -60.0%" in lines[0] and "median" in lines[0]


def test_medians_read_the_facts_once(spark):
    facts = drift_frame(spark, roas=0.4)
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    base = baseline.baseline_stats(drift_frame(spark), ["roas"], created_at=BASE)
    base = spark.createDataFrame(base.collect(), base.schema)
    watched = spark.createDataFrame(facts.rdd.mapPartitions(count), facts.schema)
    (a,) = drift.metric_drift(watched, base).collect()
    assert abs(a.details["current_median"] - 0.4 * a.details["baseline_median"]) < 1e-12
    assert seen.value == 2 * facts.count()  # the drift numbers, then the values


def test_versions_are_told_by_the_folder(spark, tmp_path):
    path = str(tmp_path / "a store" / "v-0")
    facts = drift_frame(spark)
    baseline.add_days(facts, path)
    baseline.add_days(facts.where("date >= '2025-02-01'").withColumn("roas", F.lit(1.0)), path)
    out = baseline.baseline_from_days(spark, path, created_at=BASE)
    want = baseline.baseline_stats(facts.withColumn("roas", F.expr("if(date >= '2025-02-01', 1D, roas)")), created_at=BASE)
    assert {r.metric: (r.cnt, r.median) for r in out.collect()} == {r.metric: (r.cnt, r.median) for r in want.collect()}
