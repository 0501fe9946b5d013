import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adtide.operators import quality
from adtide.schema import QualityLimits
from adtide.sources import files
from tests.frames import DAY, task_frame

AS_OF = "2025-01-06 06:00:00"


def _full(spark):
    return task_frame(spark).withColumns({c: F.lit("x") for c in ("audience_type", "platform", "country")})


def test_profile_exact_and_approx(spark):
    df = task_frame(spark).withColumn("roas", F.when(F.col("clicks") > 20, F.col("roas")))
    exact = {r.column_name: r for r in quality.column_profile(df).collect()}
    assert (exact["roas"].non_null_count, exact["roas"].null_count, exact["roas"].unique_count) == (3, 2, 2)
    assert exact["creative_type"].unique_count == 2 and exact["date"].unique_count == 5
    sketch = {r.column_name: r.unique_count for r in quality.column_profile(df, approx=True).collect()}
    assert sketch == {c: r.unique_count for c, r in exact.items()}
    assert quality.column_profile(df.where("false")).count() == len(df.columns)


def test_ranges_and_rules(spark):
    df = _full(spark).withColumn("spend", F.col("spend") - 150).withColumn("ctr", F.col("ctr") * 50)
    got = {(r.column_name, r.violation): r.violations for r in quality.range_violations(df).collect()}
    assert got == {("spend", "below minimum"): 1, ("ctr", "above maximum"): 2}
    rules = {r.rule: r.observed for r in quality.quality_rules(_full(spark)).collect()}
    assert rules == {"min_rows": 5.0}
    wide = _full(spark).withColumn("date", F.when(F.col("clicks") == 10, F.lit(dt.date(2020, 1, 1))).otherwise(F.col("date")))
    wide = wide.withColumn("country", F.when(F.col("clicks") > 10, F.col("country")))
    found = {(r.rule, r.column_name): r.observed for r in quality.quality_rules(wide, QualityLimits(min_rows=5)).collect()}
    assert found == {("max_missing_percentage", "country"): 20.0, ("date_range_max_days", "date"): 1831.0}
    pct = {r.column_name: r.missing_pct for r in quality.column_missing_pct(wide).collect()}
    assert pct["country"] == 20.0 and pct["spend"] == 0.0


def test_validate_report(spark):
    df = _full(spark).drop("country").withColumnRenamed("revenue", "sales").withColumn("spend", F.col("spend").cast("string"))
    rows = {(r.check, r.level, r.subject): r for r in quality.validate(df).collect()}
    assert ("required_columns", "error", "revenue") in rows
    assert "sales" in rows[("required_columns", "suggestion", "revenue")].message
    assert ("data_types", "warning", "spend") in rows
    assert ("schema_drift", "drift", "sales") in rows and ("schema_drift", "drift", "country") in rows
    assert quality.schema_drift(df)["removed_optional_columns"] == ["country"]
    clean = _full(spark)
    assert [r.check for r in quality.validate(clean, limits=QualityLimits(min_rows=1)).collect()] == []


def test_rename_candidates(spark):
    names = spark.createDataFrame([(n,) for n in ("ad_cost", "link_clicks", "zzz", "revenu", "order_total", None)], "column_name string")
    got = {r.expected: (r.candidate, r.reason) for r in quality.rename_candidates(names, expected=("spend", "clicks", "revenue", "purchases", "roas", "platform")).collect()}
    assert got["spend"] == ("ad_cost", "contains cost")
    assert got["clicks"] == ("link_clicks", "contains click")
    assert got["revenue"] == ("revenu", "similarity")
    assert got["purchases"] == ("order_total", "contains order")
    assert "platform" not in got


def test_catalog_drift(spark):
    names = spark.createDataFrame([("t1", "spend"), ("t1", "extra"), ("t1", "extra"), ("t2", "country")], "t string, column_name string")
    rows = quality.catalog_drift(names, by=["t"]).collect()
    assert ("t1", "new", "extra") in [tuple(r) for r in rows] and len([r for r in rows if r.kind == "new"]) == 1
    missing = {r.t: sum(1 for x in rows if x.t == r.t and x.kind == "missing_required") for r in rows}
    assert missing == {"t1": 9, "t2": 10}


def test_health_checks(spark):
    df = _full(spark)
    rows = {r.check_name: r for r in quality.run_health_checks(df, AS_OF).collect()}
    assert len(rows) == 5 and not rows["data_freshness"].passed
    assert float(rows["data_freshness"].details["age_hours"]) == 30.0
    assert all(rows[c].passed for c in ("data_completeness", "data_validity", "schema_consistency", "metric_ranges"))
    summary = quality.health_summary(quality.run_health_checks(df, AS_OF)).first()
    assert (summary.passed, summary.failed, summary.warnings, summary.healthy, summary.all_passed) == (4, 1, 1, True, False)
    assert quality.failed_checks(quality.run_health_checks(df, AS_OF)).count() == 1
    assert quality.check_freshness(df, "2025-01-05 20:00:00").first().passed


def test_health_of_bad_and_empty_tables(spark):
    bad = _full(spark).withColumns({"spend": F.col("spend") - 150, "impressions": F.lit(0), "roas": F.lit(2000.0)})
    rows = {r.check_name: r for r in quality.run_health_checks(bad.drop("clicks"), AS_OF).collect()}
    assert rows["data_validity"].details["negative_spend"] == "1" and rows["data_validity"].details["unshown_spend"] == "3"
    assert rows["schema_consistency"].severity == "CRITICAL" and rows["metric_ranges"].passed
    assert not quality.health_summary(quality.check_required(bad, ["nope"])).first().healthy
    empty = quality.run_health_checks(_full(spark).where(F.col("date") < DAY), AS_OF)
    got = {r.check_name: (r.passed, r.severity) for r in empty.collect()}
    assert got["data_completeness"] == (False, "CRITICAL") and got["data_freshness"] == (False, "WARNING")


def test_type_mismatches_on_text(spark):
    raw = spark.createDataFrame([("2025-01-01", "1", "x"), ("nope", "1.5e2", None), (None, "abc", "2")], "date string, spend string, clicks string")
    got = {r.column_name: r.bad_values for r in quality.type_mismatches(raw).collect()}
    assert got == {"date": 1, "spend": 1, "clicks": 1}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.55, 0.8, 1.0])
def test_similar_names_are_all_found(spark, least):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcä ") for _ in range(n))
    left = [word(rng.randrange(12)) for _ in range(80)] + ["aaaaaaaa", "", None, "Sale Campaign", "sale campaign"]
    right = [word(rng.randrange(12)) for _ in range(60)] + ["aaaaaaa", "aaaabaaaa", "", None, "SALE campaing", *left[:10]]
    make = lambda names: spark.createDataFrame([(n, 1) for n in names], "name string, size int")
    got = {(r.left, r.right): (r.distance, round(r.score, 9)) for r in quality.similar_names(make(left), make(right), min_similarity=least).collect()}
    want = {}
    for a in {n.lower() for n in left if n is not None}:
        for b in {n.lower() for n in right if n is not None}:
            longer, edits = max(len(a), len(b)), _distance(a, b)
            if longer == 0 or edits <= (1 - least) * longer + 1e-9:
                want[a, b] = (edits, round(1 - edits / longer if longer else 1.0, 9))
    assert got == want
    assert quality.similar_names(make([]), make(right)).count() == 0


def test_profiles_of_days_merge(spark, tmp_path):
    rows = [(f"2025-01-0{1 + k % 3}", k % 700, f"n{k % 40}" if k % 5 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "date string, `a.b` int, s string")
    path = str(tmp_path / "sketches")
    files.write_profile_sketches(df.where("date < '2025-01-03'"), path)
    files.write_profile_sketches(df.where("date >= '2025-01-02'"), path)  # one day twice
    merged = {r.column_name: r for r in quality.merged_profile(files.read_profile_sketches(spark, path)).collect()}
    whole = {r.column_name: r for r in quality.merged_profile(quality.profile_sketches(df)).collect()}
    assert {c: tuple(r) for c, r in merged.items()} == {c: tuple(r) for c, r in whole.items()}
    assert (merged["s"].non_null_count, merged["s"].null_count, merged["s"].unique_count) == (4800, 1200, 32)
    assert abs(merged["a.b"].unique_count - 700) <= quality.SKETCH_ERROR * 700
    first = quality.merged_profile(quality.profile_sketches(df), ["day"]).where("day = '2025-01-01' and column_name = 's'").first()
    assert first.non_null_count + first.null_count == 2000
