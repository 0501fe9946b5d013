import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from adtide.operators.logs import log_summary
from adtide.schema import ADS_TEXT_SCHEMA
from adtide.sources import ads, files
from tests.frames import insight, task_frame
from workload import tables

HEADER = "date,campaign_name,adset_name,spend,impressions,clicks,ctr,purchases,revenue,roas,creative_type"


def test_read_ads_cleans_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + "\n2025-01-01,  men  COMFORT-max ,A1, 1.5 ,1e3,12,0.01,3,inf,nan,Video\nbad,x,A2,abc,,9,,2,10.25,2.0,\"a, b\"\n"
    )
    rows = {r.adset_name: r for r in ads.read_ads(spark, str(tmp_path / "a.csv")).collect()}
    a, b = rows["A1"], rows["A2"]
    assert a.date == dt.date(2025, 1, 1) and b.date is None
    assert (float(a.spend), a.impressions, a.clicks, a.purchases, float(a.revenue)) == (1.5, 1000, 12, 3, 0.0)
    assert (float(b.spend), b.impressions, float(b.revenue)) == (0.0, 0, 10.25)
    assert a.roas is None and b.ctr is None and b.roas == 2.0
    assert a.campaign_name_clean == "Men Comfort-Max" and a.campaign_name.strip() == "men  COMFORT-max"
    assert b.creative_type == "a, b"


def test_read_ads_directory_and_parquet(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(HEADER + f"\n2025-01-0{i + 1},c,a,1,1,1,0.1,1,1,1,x\n")
    df = ads.read_ads(spark, str(tmp_path / "*.csv"))
    assert df.count() == 3
    df.write.parquet(str(tmp_path / "out.parquet"))
    again = ads.read_ads(spark, str(tmp_path / "out.parquet"), format="parquet")
    assert sorted(again.collect()) == sorted(df.collect())


def test_missing_and_empty_sources(spark, tmp_path):
    with pytest.raises(ads.MissingSourceError):
        ads.read_ads(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ads.EmptySourceError):
        ads.read_ads(spark, str(tmp_path / "empty.csv"))


def test_clean_ads_keeps_ratio_gaps(spark):
    raw = spark.createDataFrame([("2025-01-01", None, None)], "date string, spend string, ctr string")
    row = ads.clean_ads(raw).first()
    assert float(row.spend) == 0.0 and row.ctr is None
    assert "spend" in ADS_TEXT_SCHEMA.fieldNames()


def test_sample_is_repeatable_and_whole(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    one = sorted(r.id for r in ads.sample_rows(df, 50).collect())
    two = sorted(r.id for r in ads.sample_rows(df.repartition(7), 50).collect())
    assert one == two and len(set(one)) == 50
    assert sorted(r.id for r in ads.sample_rows(df, 50, seed=7).collect()) != one
    assert ads.sample_rows(df, 1000).count() == 500


def test_execution_log_events(spark, tmp_path):
    lines = [
        {"timestamp": "2025-01-01T10:00:00", "event": "session_start", "session_id": "s", "message": "="},
        {"timestamp": "2025-01-01T10:00:01", "agent": "planner", "event": "complete", "duration_seconds": 1.5, "output": {"n": 2}},
        {"timestamp": "2025-01-01T10:00:02", "agent": "planner", "event": "complete", "duration_seconds": 0.5},
        {"timestamp": "2025-01-01T10:00:03", "agent": "planner", "event": "error", "error_type": "X", "attempt": 1, "stack_trace": ["a"]},
        {"timestamp": "2025-01-01T10:00:04", "agent": "planner", "event": "retry_attempt", "attempt": 2, "max_attempts": 3},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    log = files.read_execution_log(spark, str(tmp_path / "log.jsonl")).cache()
    assert log.count() == 6
    assert log.where("_corrupt_record = 'not json'").count() == 1
    assert log.where("get_json_object(output, '$.n') = '2'").count() == 1
    got = {r.event: r for r in log_summary(log).collect()}
    assert set(got) == {"complete", "error", "retry_attempt"}
    assert (got["complete"].cnt, got["complete"].avg_duration, got["complete"].max_duration) == (2, 1.0, 1.5)
    assert got["error"].error_count == 1 and got["retry_attempt"].retry_count == 1


def test_insight_and_snapshot_sinks(spark, tmp_path):
    rows = insight(spark, {"id": "i1", "hypothesis": "h", "evidence": ["a", "b"], "confidence": 0.5})
    files.write_insights(rows, str(tmp_path / "ins"))
    assert files.read_insights(spark, str(tmp_path / "ins")).collect() == rows.collect()
    files.write_schema_snapshot(task_frame(spark), str(tmp_path / "snap"), approx=False)
    snap = {r.column_name: r for r in spark.read.json(str(tmp_path / "snap")).collect()}
    assert snap["ctr"].unique_count == 3 and snap["ctr"].column_type == "double" and snap["date"].non_null_count == 5


def test_csv_headers_are_not_mixed_up(spark, tmp_path):
    for name, header, row in (("a", "campaign_name,spend,revenue", "x,1,2"), ("b", "campaign_name,revenue,spend", '"y\nz",2,1')):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n{row}\n")
    one, two = (str(tmp_path / f"{n}.csv") for n in "ab")
    rows = {r.campaign_name: (float(r.spend), float(r.revenue)) for r in ads.read_ads(spark, [one, two]).collect()}
    assert rows == {"x": (1.0, 2.0), "y\nz": (1.0, 2.0)}
    both = ads.read_ads(spark, str(tmp_path / "*.csv")).collect()  # each file by its own header
    assert {r.campaign_name: (float(r.spend), float(r.revenue)) for r in both} == rows


def test_a_folder_of_files_with_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    texts = {
        "a b.csv": "\ufeffdate,campaign_name,spend\n2025-01-01,x,1\n2025-01-02,y,2\n",
        "c.csv": 'campaign_name,"spend",date,spend,\n"p\nq",3,2025-01-03,9,z\n',
        "d%20.csv": "\n\nspend,campaign_name\n4,r\n",
        "only-header.csv": "spend,impressions\n",
        "empty.csv": "",
        "broken-name.csv": '"camp\naign",spend\nu,6\n',
    }
    for name, text in texts.items():
        (folder / name).write_text(text)
    df = ads.read_ads(spark, str(tmp_path / "in put*"))
    got = {(str(r.date), r.campaign_name, float(r.spend)) for r in df.collect()}
    assert got == {("2025-01-01", "x", 1.0), ("2025-01-02", "y", 2.0), ("2025-01-03", "p\nq", 3.0), ("None", "r", 4.0), ("None", None, 6.0)}
    assert {"spend3", "_c4", "impressions", "camp\naign"} <= set(df.columns)


def test_files_without_quotes_are_split(spark, tmp_path):
    rows = "".join(f"2025-01-01,c{k},{k}\n" for k in range(5000))
    (tmp_path / "plain.csv").write_text("date,campaign_name,spend\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = ads.read_ads(spark, str(tmp_path / "plain.csv"))
        assert df.rdd.getNumPartitions() > 2 and df.count() == 5000
        assert df.agg(F.sum("spend")).first()[0] == sum(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


WIDE = "date,campaign_name,spend,revenue,impressions,clicks\n2025-01-01,a,1e30,0.00000000001,9223372036854775808,5\n2025-01-02,b,2.5,abc,7,9223372036854775807\n"


def test_numbers_that_do_not_fit_are_kept(spark, tmp_path):
    (tmp_path / "w.csv").write_text(WIDE)
    rows = {r.campaign_name: r for r in ads.read_ads(spark, str(tmp_path / "w.csv")).collect()}
    assert (rows["a"].spend, rows["a"].revenue, rows["a"].impressions, rows["a"].clicks) == (1e30, 1e-11, 2.0**63, 5)
    assert (rows["b"].spend, rows["b"].revenue, rows["b"].impressions, rows["b"].clicks) == (2.5, 0.0, 7.0, 2**63 - 1)
    strict = {r.campaign_name: r for r in ads.read_ads(spark, str(tmp_path / "w.csv"), exact=True).collect()}
    assert (strict["a"].spend, strict["a"].revenue, strict["a"].impressions) == (None, None, None)  # missing, not 0
    assert (float(strict["b"].spend), float(strict["b"].revenue), strict["b"].impressions) == (2.5, 0.0, 7)
    loose = ads.read_ads(spark, str(tmp_path / "w.csv"), exact=False)
    assert dict(loose.dtypes)["clicks"] == "double"
    (tmp_path / "fits.csv").write_text("spend,impressions\n0.1234567891234,1e3\n-1.5,2.7\n,\n")
    fits = ads.read_ads(spark, str(tmp_path / "fits.csv"))
    assert dict(fits.dtypes) == {"spend": "decimal(38,10)", "impressions": "bigint"}
    assert sorted((float(r.spend), r.impressions) for r in fits.collect()) == [(-1.5, 2), (0.0, 0), (0.1234567891, 1000)]


def test_sample_of_large_and_equal_cells(spark, monkeypatch):
    monkeypatch.setattr(ads, "_SAMPLE_ROWS", 3)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id")).otherwise(-1).alias("v"))
    for n in (1, 10, 500, 2500, 2999, 3000, 5000):
        got = [r.v for r in ads.sample_rows(df.repartition(5), n).collect()]
        assert len(got) == min(n, 3000)
        whole = sorted((r.h, r.v) for r in df.select(F.md5(F.concat_ws("|", F.lit("42"), F.col("v").cast("string")).cast("binary")).alias("h"), "v").collect())
        assert sorted(got) == sorted(v for _, v in whole[:n])


def test_wide_numbers_dates_and_cvr(spark):
    raw = spark.createDataFrame(
        [("12/31/2024", "1e15", "n/a"), ("2024/01/05", "0.00004", "0.5"), ("2024-02-03", "NaN", "nan")], "date string, spend string, cvr string"
    )
    rows = ads.clean_ads(raw).collect()
    assert [str(r.date) for r in rows] == ["2024-12-31", "2024-01-05", "2024-02-03"]
    assert [float(r.spend) for r in rows] == [1e15, 0.00004, 0.0] and [r.cvr for r in rows] == [None, 0.5, None]


def test_sample_of_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], ["cost.usd", "two words"])
    assert ads.sample_rows(df, 1).count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_is_compiled_in_pieces(spark):
    texts = ["abc", "", " 1.5 ", "1e3", "n/a", "1e400", "0.00000000001", "9223372036854775808", "-12.7", "nan", "inf", None]
    columns = ["spend", "revenue", "impressions", "clicks", "purchases", "ctr"]
    raw = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lit("2025-01-01").alias("date"), *[F.col("t").alias(c) for c in columns])
    rows = {r.t: r for r in ads.clean_ads(raw).collect()}
    got = {t: (r.spend if r.spend is None else float(r.spend), r.clicks) for t, r in rows.items()}
    assert got == {
        "abc": (0, 0), "": (0, 0), " 1.5 ": (1.5, 1), "1e3": (1000, 1000), "n/a": (0, 0), "1e400": (0, 0), "0.00000000001": (None, 0),
        "9223372036854775808": (9223372036854775808, None), "-12.7": (-12.7, -12), "nan": (0, 0), "inf": (0, 0), None: (0, 0),
    }
    # every text is read as a double in a step of its own, once, and not in the step that uses the number
    assert _plan(ads.clean_ads(raw)).count("as double") < 20 and "transform(" in _plan(ads.clean_ads(raw))


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path):
    for i in range(40):
        body = "\n" * (i % 3) + ("a,b\n" if i % 2 else '"b",a\n') + "".join(f"{k},{i}\n" for k in range(50))
        (tmp_path / f"{i:02}.csv").write_text(body)
    found = ads._headers(spark, str(tmp_path))
    assert "SortAggregate" not in _plan(found) and "ObjectHashAggregate" in _plan(found)
    got = {r.file[-6:-4]: (r.header, r.quoted) for r in found.collect()}
    assert got == {f"{i:02}": ("a,b", False) if i % 2 else ('"b",a', True) for i in range(40)}


def test_what_hangs_on_a_dimension_is_joined_to_it(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("lineitem", [(1, 10), (2, 11), (None, None), (9, 10)], "l_orderkey long, l_partkey long")
    put("orders", [(1, 5, "high"), (1, 6, "low"), (2, None, "x"), (None, 5, "y")], "o_orderkey long, o_custkey long, o_orderpriority string")
    put("customer", [(5, 1, "a"), (5, 2, "b"), (None, 1, "c")], "c_custkey long, c_nationkey long, c_mktsegment string")
    put("nation", [(1, "N")], "n_nationkey long, n_name string")
    put("part", [(10, "p", "q", "r"), (10, "s", "t", "u")], "p_partkey long, p_brand string, p_type string, p_name string")
    columns = ["l_orderkey", "o_orderpriority", "c_mktsegment", "n_name", "p_brand"]
    out = tables._joined(spark, str(tmp_path), {"creative_type", "audience_type", "country", "campaign_name"}).select(*columns)
    got = sorted(out.collect(), key=str)
    first = [(1, "high", "a", "N"), (1, "high", "b", None), (1, "low", None, None), (9, None, None, None)]
    want = [(*r, p) for r in first for p in ("p", "s")] + [(2, "x", None, None, None), (None, None, None, None, None)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(spark_row(columns, r)))
    assert set(tables._joined(spark, str(tmp_path), {"creative_type"}).columns) == {"l_orderkey", "l_partkey", "o_orderkey", "o_custkey", "o_orderpriority"}
    top = out._jdf.queryExecution().optimizedPlan().children().head()  # under the projection
    left = top.left().toString()
    assert "p_brand" not in left and "n_name" in left


def spark_row(names, values):
    return Row(**dict(zip(names, values, strict=True)))
