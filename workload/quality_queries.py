"""Ingest, profile, schema, data-quality and health queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adtide.operators import quality
from adtide.plans.staging import staging_dir
from adtide.schema import RENAME_KEYWORDS
from adtide.sources import ads as source
from adtide.sources import files
from workload import tables as t
from workload.registry import ORACLE, day, query, rounded

TEXT = t.text_ads_sql()


def _num(column: str) -> str:
    """SQL twin of text to finite number."""
    value = f"TRY_CAST(trim({column}) AS DOUBLE)"
    return f"CASE WHEN contains({column}, '_') OR isnan({value}) THEN NULL ELSE {value} END"


_LONGS = ("impressions", "clicks", "purchases")
_MONEY = ("spend", "revenue")
_PARSED = (
    [f"CAST(floor({_num(c)}) AS BIGINT) AS {c}" for c in _LONGS]
    + [f"CAST(TRY_CAST(trim({c}) AS DECIMAL(18,4)) AS DOUBLE) AS {c}" for c in _MONEY]
    + [f"{_num(c)} AS {c}" for c in ("ctr", "roas")]
)


# --- ingest --------------------------------------------------------------------------
_CSV = {  # odd ones among the facts: large and small money, as text
    "spend": "CASE WHEN impressions % 7000 = 0 THEN '1e15' WHEN impressions % 11000 = 0 THEN '0.00004' ELSE CAST(spend AS {0}) END",
    "revenue": "CAST(revenue AS {0})",
}


@query(
    "read_ads_csv",
    t.ads_sql()
    + "SELECT campaign_name || chr(10) || adset_name AS campaign_name, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day, count(*) AS row_count, "
    "CAST(sum(CAST(CASE WHEN impressions % 7000 = 0 THEN 1000000000000000 WHEN impressions % 11000 = 0 THEN 0 ELSE spend END AS DECIMAL(38,10))) AS DOUBLE) AS spend, "
    "count(*) FILTER (WHERE impressions % 7000 <> 0 AND impressions % 11000 = 0) AS small_spend, CAST(sum(revenue) AS DOUBLE) AS revenue, "
    "CAST(sum(clicks) AS BIGINT) AS clicks, round(avg(cvr), 9) AS cvr FROM ads GROUP BY 1",
)
def _(spark, d):
    """Facts written as CSV by two systems (other column order, date form and a
    quoted line break) and read back."""
    facts = t.ads(spark, d, ["date", "campaign_name", "adset_name", "spend", "impressions", "clicks", "revenue", "cvr"])
    text = facts.selectExpr(
        "date", "concat(campaign_name, '\n', adset_name) AS campaign_name", *[f"{e.format('string')} AS {c}" for c, e in _CSV.items()],
        "cast(impressions AS string) AS impressions", "cast(clicks AS string) AS clicks", "coalesce(cast(cvr AS string), 'n/a') AS cvr",
    )
    folder = f"{staging_dir(spark)}/csv-{uuid.uuid4().hex}"
    iso = text.where("cast(clicks AS long) % 2 = 0").withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    iso.write.option("header", True).option("escape", '"').csv(f"{folder}/a")
    other = text.where("cast(clicks AS long) % 2 = 1").select("revenue", "spend", F.date_format("date", "MM/dd/yyyy").alias("date"), "campaign_name", "cvr", "clicks", "impressions")
    other.write.option("header", True).option("escape", '"').csv(f"{folder}/b")
    ads = source.read_ads(spark, [f"{folder}/a", f"{folder}/b"])
    small = (F.col("spend") == F.lit("0.00004").cast("decimal(38,10)"))
    out = ads.groupBy("campaign_name").agg(
        F.min(day()).alias("first_day"), F.max(day()).alias("last_day"), F.count("*").alias("row_count"),
        F.sum(F.when(small, 0).otherwise(F.col("spend"))).cast("double").alias("spend"), F.count_if(small).alias("small_spend"),
        F.sum("revenue").cast("double").alias("revenue"), F.sum("clicks").alias("clicks"), F.avg("cvr").alias("cvr"),
    )
    return rounded(out, 9, "cvr")


@query(
    "read_ads_headers",
    t.ads_sql()
    + "SELECT campaign_name, count(*) AS row_count, count(*) FILTER (WHERE clicks % 3 <> 2) AS with_adset, CAST(sum(spend) AS DOUBLE) AS spend, "
    "CAST(sum(CASE WHEN clicks % 3 = 1 THEN 0 ELSE revenue END) AS DOUBLE) AS revenue, CAST(sum(clicks) AS BIGINT) AS clicks FROM ads GROUP BY 1",
)
def _(spark, d):
    """One folder of CSV files with three column orders, two of which lack a column."""
    facts = t.ads(spark, d, ["date", "campaign_name", "adset_name", "spend", "clicks", "revenue"])
    folder = f"{staging_dir(spark)}/csv-{uuid.uuid4().hex}"
    orders = (
        ["date", "campaign_name", "adset_name", "spend", "clicks", "revenue"],
        ["clicks", "adset_name", "spend", "campaign_name", "date"],
        ["revenue", "spend", "campaign_name", "clicks"],
    )
    for kind, columns in enumerate(orders):
        facts.where(f"clicks % 3 = {kind}").select(*columns).write.mode("append").option("header", True).csv(folder)
    ads = source.read_ads(spark, folder)
    return ads.groupBy("campaign_name").agg(
        F.count("*").alias("row_count"), F.count("adset_name").alias("with_adset"), F.sum("spend").cast("double").alias("spend"),
        F.sum("revenue").cast("double").alias("revenue"), F.sum("clicks").alias("clicks"),
    )


@query(
    "read_ads_wide",
    t.ads_sql()
    + "SELECT campaign_name, count(*) FILTER (WHERE k = 0) AS huge, count(*) FILTER (WHERE k = 1) AS tiny, CAST(sum(CASE WHEN k > 1 THEN spend ELSE 0 END) AS DOUBLE) AS spend, "
    "max(CASE WHEN k = 2 THEN CAST(9223372036854775808 AS DOUBLE) ELSE CAST(impressions AS DOUBLE) END) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks "
    "FROM (SELECT *, impressions % 7 AS k FROM ads) GROUP BY 1",
)
def _(spark, d):
    """Numbers that neither the decimal nor the whole number type can hold stay what they are."""
    facts = t.ads(spark, d, ["campaign_name", "spend", "impressions", "clicks"]).withColumn("k", F.col("impressions") % 7)
    text = facts.select(
        "campaign_name",
        F.expr("CASE k WHEN 0 THEN '1e30' WHEN 1 THEN '0.00000000001' ELSE cast(spend AS string) END").alias("spend"),
        F.expr("CASE k WHEN 2 THEN '9223372036854775808' ELSE cast(impressions AS string) END").alias("impressions"),
        "clicks",
    )
    folder = f"{staging_dir(spark)}/csv-{uuid.uuid4().hex}"
    text.write.option("header", True).csv(folder)
    ads = source.read_ads(spark, folder)
    usual = ~F.col("spend").isin(1e30, 1e-11)
    # exact again: the doubles stand for decimals of four places
    spend = F.sum(F.when(usual, F.col("spend").cast("decimal(18,4)")).otherwise(F.lit(0).cast("decimal(18,4)"))).cast("double")
    return ads.groupBy("campaign_name").agg(
        F.count_if(F.col("spend") == 1e30).alias("huge"), F.count_if(F.col("spend") == 1e-11).alias("tiny"), spend.alias("spend"),
        F.max("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
    )


@query("coerce_numeric", TEXT + f"SELECT row_key, {', '.join(_PARSED)} FROM text_ads")
def _(spark, d):
    raw = t.text_ads(spark, d, ["row_key", *_LONGS, *_MONEY, "ctr", "roas"])
    out = source.coerce_numeric(raw)
    return out.withColumns({c: F.col(c).cast("double") for c in _MONEY})


_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(trim(campaign_name), '\\s+', ' ', 'g')), "
    "'\\p{L}+|\\P{L}+'), lambda w: upper(w[1]) || w[2:]), '')"
)


@query("clean_campaign_name", TEXT + f"SELECT row_key, campaign_name, {_TITLE} AS campaign_name_clean FROM text_ads")
def _(spark, d):
    return source.with_clean_campaign_name(t.text_ads(spark, d, ["row_key", "campaign_name"]))


@query(
    "clean_ads_rows",
    TEXT
    + f"SELECT row_key, CAST(TRY_CAST(date AS DATE) AS VARCHAR) AS date, {_TITLE} AS campaign_name_clean, "
    + ", ".join(f"coalesce(CAST(floor({_num(c)}) AS BIGINT), 0) AS {c}" for c in _LONGS)
    + ", "
    + ", ".join(f"coalesce(CAST(TRY_CAST(trim({c}) AS DECIMAL(18,4)) AS DOUBLE), 0) AS {c}" for c in _MONEY)
    + f", {_num('ctr')} AS ctr, {_num('roas')} AS roas FROM text_ads",
)
def _(spark, d):
    out = source.clean_ads(t.text_ads(spark, d)).withColumns({c: F.col(c).cast("double") for c in _MONEY})
    return out.withColumn("date", day()).drop("campaign_name")


@query(
    "type_mismatches",
    TEXT
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        [
            "SELECT 'date' AS column_name, 'date' AS expected, count(*) FILTER (WHERE date IS NOT NULL AND TRY_CAST(date AS DATE) IS NULL) AS bad_values FROM text_ads"
        ]
        + [
            f"SELECT '{c}', '{k}', count(*) FILTER (WHERE {c} IS NOT NULL AND ({_num(c)}) IS NULL) FROM text_ads"
            for c, k in [(c, "decimal") for c in _MONEY] + [(c, "integer") for c in _LONGS] + [("ctr", "float"), ("roas", "float")]
        ]
    )
    + ") WHERE bad_values > 0",
)
def _(spark, d):
    return quality.type_mismatches(t.text_ads(spark, d))


# --- profile and rules ------------------------------------------------------------------
GAPS = {
    "country": "CASE WHEN clicks % 7 = 0 THEN NULL ELSE country END",
    "roas": "CASE WHEN clicks % 3 = 0 THEN NULL ELSE roas END",
    "platform": "CASE WHEN impressions % 13000 = 0 THEN NULL ELSE platform END",
    "spend": "CAST(spend - 100 AS DECIMAL(18,4))",
    "clicks": "clicks - 5",
    "ctr": "ctr * 40",
    "impressions": "CASE WHEN clicks % 50 = 0 THEN 0 ELSE impressions END",
}
BAD = t.ads_sql(**GAPS)


def _bad(spark, d, columns=t.ADS_FIELDS):
    return t.ads(spark, d, columns, **{c: e for c, e in GAPS.items() if c in columns})


_TYPES = {
    "date": "date", "spend": "decimal(18,4)", "revenue": "decimal(18,4)", "impressions": "bigint", "clicks": "bigint",
    "purchases": "bigint", "ctr": "double", "roas": "double", "cvr": "double",
}


@query(
    "column_profile",
    t.ads_sql(**{c: GAPS[c] for c in ("country", "roas", "platform")})
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{_TYPES.get(c, 'string')}' AS column_type, count({c}) AS non_null_count, "
        f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM ads"
        for c in t.ADS_FIELDS
    ),
)
def _(spark, d):
    return quality.column_profile(t.ads(spark, d, **{c: GAPS[c] for c in ("country", "roas", "platform")}))


@query(
    "column_missing_pct",
    BAD
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, (count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*) AS missing_pct FROM ads"
        for c in t.ADS_FIELDS
    ),
)
def _(spark, d):
    return quality.column_missing_pct(_bad(spark, d))


@query(
    "column_missing_dotted",
    BAD
    + " UNION ALL ".join(
        f"SELECT '{shown}' AS column_name, count(*) - count({c}) AS missing, (count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*) AS missing_pct FROM ads"
        for c, shown in (("spend", "cost.usd"), ("roas", "return on spend"))
    ),
)
def _(spark, d):
    odd = _bad(spark, d).select(F.col("spend").alias("cost.usd"), F.col("roas").alias("return on spend"))
    return quality.column_missing_pct(odd)


_RANGES = (
    [("spend", "below", 0), ("impressions", "below", 0), ("clicks", "below", 0), ("purchases", "below", 0), ("revenue", "below", 0)]
    + [("ctr", "below", 0), ("ctr", "above", 1), ("roas", "below", 0)]
)


def _ranges_sql(columns: str) -> str:
    return " UNION ALL ".join(columns.format(c=c, side=s, word="minimum" if s == "below" else "maximum", op="<" if s == "below" else ">", v=v) for c, s, v in _RANGES)


@query(
    "range_violations",
    BAD
    + "SELECT * FROM ("
    + _ranges_sql("SELECT '{c}' AS column_name, '{side} {word}' AS violation, CAST({v} AS DOUBLE) AS limit_value, count(*) FILTER (WHERE {c} {op} {v}) AS violations FROM ads")
    + ") WHERE violations > 0",
)
def _(spark, d):
    return quality.range_violations(_bad(spark, d, ["spend", "impressions", "clicks", "purchases", "revenue", "ctr", "roas"]))


_RULES = (
    "SELECT 'max_missing_percentage' AS rule, column_name, missing_pct AS observed, CAST(10 AS DOUBLE) AS limit_value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*) AS missing_pct FROM ads" for c in t.ADS_FIELDS
    )
    + ") WHERE missing_pct > 10 UNION ALL SELECT 'date_range_max_days', 'date', CAST(max(date) - min(date) AS DOUBLE), 365 FROM ads "
    "HAVING max(date) - min(date) > 365 UNION ALL SELECT 'min_rows', NULL, CAST(count(*) AS DOUBLE), 100 FROM ads HAVING count(*) < 100"
)


@query("quality_rules", BAD + _RULES)
def _(spark, d):
    return quality.quality_rules(_bad(spark, d))


@query(
    "validation_report",
    BAD
    + "SELECT 'value_ranges' AS \"check\", 'error' AS level, column_name AS subject, CAST(violations AS DOUBLE) AS observed FROM ("
    + _ranges_sql("SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} {op} {v}) AS violations FROM ads")
    + f") WHERE violations > 0 UNION ALL SELECT 'data_quality', 'warning', column_name, observed FROM ({_RULES}) "
    "UNION ALL SELECT 'schema_drift', 'drift', 'cvr', 1.0",
)
def _(spark, d):
    return quality.validate(_bad(spark, d)).drop("message")


@query(
    "validation_missing_columns",
    BAD
    + "SELECT 'required_columns' AS \"check\", 'error' AS level, c AS subject, CAST(1 AS DOUBLE) AS observed FROM (VALUES ('revenue'), ('clicks')) v(c) "
    "UNION ALL SELECT 'required_columns', 'suggestion', 'clicks', 0.9 UNION ALL SELECT 'required_columns', 'suggestion', 'revenue', 0.9 "
    "UNION ALL SELECT 'schema_drift', 'drift', c, 1.0 FROM (VALUES ('sales_total'), ('link_click')) v(c) "
    "UNION ALL SELECT 'data_quality', 'warning', 'date', CAST(max(date) - min(date) AS DOUBLE) FROM ads "
    "UNION ALL SELECT 'data_quality', 'warning', c, p FROM (SELECT 'roas' AS c, (count(*) - count(roas)) * CAST(100 AS DOUBLE) / count(*) AS p FROM ads "
    "UNION ALL SELECT 'country', (count(*) - count(country)) * CAST(100 AS DOUBLE) / count(*) FROM ads) WHERE p > 10 "
    "UNION ALL SELECT 'value_ranges', 'error', 'spend', CAST(count(*) AS DOUBLE) FROM ads WHERE spend < 0 "
    "UNION ALL SELECT 'value_ranges', 'error', 'ctr', CAST(count(*) AS DOUBLE) FROM ads WHERE ctr > 1",
)
def _(spark, d):
    facts = _bad(spark, d, [c for c in t.ADS_FIELDS if c != "cvr"])
    facts = facts.withColumnsRenamed({"revenue": "sales_total", "clicks": "link_click"})
    return quality.validate(facts).drop("message")


# --- health -------------------------------------------------------------------------------
AS_OF = "2001-11-06 12:00:00"
_AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(max(date) AS TIMESTAMP))) / 3600"
_CELLS = " + ".join(f"(count(*) - count({c}))" for c in t.ADS_FIELDS)
HEALTH_SQL = (
    f"SELECT 'data_freshness' AS check_name, {_AGE} <= 24 AS passed, CASE WHEN {_AGE} <= 24 THEN 'INFO' ELSE 'WARNING' END AS severity, "
    f"{_AGE} AS value_1, CAST(NULL AS DOUBLE) AS value_2, CAST(NULL AS DOUBLE) AS value_3 FROM ads UNION ALL "
    f"SELECT 'data_completeness', ({_CELLS}) * 100.0 / (count(*) * {len(t.ADS_FIELDS)}) <= 5, "
    f"CASE WHEN ({_CELLS}) * 100.0 / (count(*) * {len(t.ADS_FIELDS)}) <= 5 THEN 'INFO' ELSE 'WARNING' END, "
    f"count(*), ({_CELLS}) * CAST(100 AS DOUBLE) / (count(*) * {len(t.ADS_FIELDS)}), NULL FROM ads UNION ALL "
    "SELECT 'data_validity', count(*) FILTER (WHERE spend < 0 OR roas < 0 OR (impressions = 0 AND spend > 0)) = 0, "
    "CASE WHEN count(*) FILTER (WHERE spend < 0 OR roas < 0 OR (impressions = 0 AND spend > 0)) = 0 THEN 'INFO' ELSE 'WARNING' END, "
    "count(*) FILTER (WHERE spend < 0), count(*) FILTER (WHERE roas < 0), count(*) FILTER (WHERE impressions = 0 AND spend > 0) FROM ads UNION ALL "
    "SELECT 'schema_consistency', true, 'INFO', NULL, NULL, NULL UNION ALL "
    "SELECT 'metric_ranges', true, 'INFO', max(roas), max(ctr), max(CAST(spend AS DOUBLE)) FROM ads"
)
_DETAIL = {
    "data_freshness": ("age_hours", None, None),
    "data_completeness": ("total_rows", "missing_pct", None),
    "data_validity": ("negative_spend", "negative_roas", "unshown_spend"),
    "metric_ranges": ("max_roas", "max_ctr", "max_spend"),
}


def _health_out(df):
    out = df
    for i in range(3):
        value = F.lit(None).cast("double")
        for check, names in _DETAIL.items():
            if names[i]:
                value = F.when(F.col("check_name") == check, F.try_element_at("details", F.lit(names[i])).cast("double")).otherwise(value)
        out = out.withColumn(f"value_{i + 1}", value)
    out = out.select("check_name", "passed", "severity", "value_1", "value_2", "value_3")
    return rounded(out, 6, "value_1", "value_2", "value_3")


_HEALTH_ROUND = "SELECT check_name, passed, severity, round(value_1, 6) AS value_1, round(value_2, 6) AS value_2, round(value_3, 6) AS value_3 FROM ({})"


@query("health_checks", BAD + _HEALTH_ROUND.format(HEALTH_SQL))
def _(spark, d):
    return _health_out(quality.run_health_checks(_bad(spark, d), AS_OF))


@query("health_validity", BAD + _HEALTH_ROUND.format(HEALTH_SQL) + " WHERE check_name = 'data_validity'")
def _(spark, d):
    return _health_out(quality.check_validity(_bad(spark, d, ["spend", "roas", "impressions", "clicks"])))


@query("health_freshness", BAD + _HEALTH_ROUND.format(HEALTH_SQL) + " WHERE check_name = 'data_freshness'")
def _(spark, d):
    return _health_out(quality.check_freshness(_bad(spark, d, ["date"]), AS_OF))


@query("health_completeness", BAD + _HEALTH_ROUND.format(HEALTH_SQL) + " WHERE check_name = 'data_completeness'")
def _(spark, d):
    return _health_out(quality.check_completeness(_bad(spark, d)))


@query("health_metric_ranges", BAD + _HEALTH_ROUND.format(HEALTH_SQL) + " WHERE check_name = 'metric_ranges'")
def _(spark, d):
    return _health_out(quality.check_metric_ranges(_bad(spark, d, ["roas", "ctr", "spend", "clicks"])))


@query(
    "health_summary",
    BAD
    + f", health AS ({HEALTH_SQL}) SELECT count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, "
    "count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') AS critical_failures, count(*) FILTER (WHERE NOT passed AND severity = 'WARNING') AS warnings, "
    "count(*) FILTER (WHERE NOT passed) = 0 AS all_passed, count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') = 0 AS healthy FROM health",
)
def _(spark, d):
    return quality.health_summary(quality.run_health_checks(_bad(spark, d), AS_OF))


# --- column catalogs ----------------------------------------------------------------------------
_CATALOG_NAME = "CASE event_type WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'purchases' WHEN 'view' THEN 'platform' ELSE event_type END"
_REQUIRED = ("date", "campaign_name", "adset_name", "spend", "impressions", "clicks", "purchases", "revenue", "ctr", "roas")
_OPTIONAL = ("creative_type", "creative_message", "audience_type", "platform", "country")
_EXPECTED_VALUES = ", ".join(
    [f"('{c}', 'missing_required')" for c in _REQUIRED] + [f"('{c}', 'removed_optional')" for c in _OPTIONAL]
)


@query(
    "schema_drift",
    f"WITH columns AS (SELECT user_id AS table_id, {_CATALOG_NAME} AS column_name FROM events), expected(name, kind) AS (VALUES {_EXPECTED_VALUES}) "
    "SELECT DISTINCT table_id, 'new' AS kind, column_name FROM columns WHERE column_name NOT IN (SELECT name FROM expected) UNION ALL "
    "SELECT t.table_id, e.kind, e.name FROM (SELECT DISTINCT table_id FROM columns) t, expected e "
    "WHERE NOT EXISTS (SELECT 1 FROM columns c WHERE c.table_id = t.table_id AND c.column_name = e.name)",
)
def _(spark, d):
    catalog = t.table(spark, d, "events").selectExpr("user_id AS table_id", f"{_CATALOG_NAME} AS column_name")
    return quality.catalog_drift(catalog, by=["table_id"])


_EXPECTED = (*RENAME_KEYWORDS, "platform", "roas")
_KEYWORD_VALUES = ", ".join(f"('{e}', '{k}', {i})" for e, ks in RENAME_KEYWORDS.items() for i, k in enumerate(ks))


@query(
    "rename_candidates",
    "WITH names AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT p_name FROM part UNION SELECT c_mktsegment FROM customer), "
    f"expected(e) AS (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in _EXPECTED)}), words(e, k, i) AS (VALUES {_KEYWORD_VALUES}), "
    "hits AS (SELECT e.e, n.name, (SELECT min_by(k, i) FROM words w WHERE w.e = e.e AND contains(lower(n.name), w.k)) AS word, "
    "1 - CAST(levenshtein(lower(n.name), e.e) AS DOUBLE) / CAST(greatest(length(n.name), length(e.e)) AS DOUBLE) AS alike FROM expected e, names n), "
    "scored AS (SELECT e, name, word, CASE WHEN word IS NOT NULL THEN CAST(0.9 AS DOUBLE) WHEN alike >= 0.3 THEN alike END AS score FROM hits), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY CASE WHEN word IS NULL THEN 1 ELSE 0 END, score DESC, name) AS rn FROM scored WHERE score IS NOT NULL) "
    "SELECT e AS expected, name AS candidate, round(score, 9) AS score, CASE WHEN word IS NULL THEN 'similarity' ELSE concat('contains ', word) END AS reason FROM ranked WHERE rn = 1",
)
def _(spark, d):
    names = (
        t.table(spark, d, "events").selectExpr("event_type AS column_name")
        .unionByName(t.table(spark, d, "part").selectExpr("p_name AS column_name"))
        .unionByName(t.table(spark, d, "customer").selectExpr("c_mktsegment AS column_name"))
    )
    return rounded(quality.rename_candidates(names, expected=_EXPECTED), 9, "score")


_NAME = "concat(p_name, ' ', p_brand, ' ', p_type)"
_TYPED = "CASE p_partkey % 4 WHEN 0 THEN concat(substr(p_name, 1, 3), substr(p_name, 5), ' ', lower(p_brand), ' ', p_type) WHEN 1 THEN concat(p_type, ' ', p_name, ' ', p_brand) " \
    "WHEN 2 THEN concat(p_name, 's  ', replace(p_brand, '#', '-'), ' ', substr(p_type, 1, 4)) ELSE concat(p_name, p_brand, ' ', upper(p_type)) END"


@query(
    "similar_campaign_names",
    f"WITH l AS (SELECT DISTINCT lower({_NAME}) AS a FROM part), r AS (SELECT DISTINCT lower({_TYPED}) AS b FROM part) "
    "SELECT a AS \"left\", b AS \"right\", CAST(levenshtein(a, b) AS INTEGER) AS distance, round(1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)), 9) AS score "
    "FROM l, r WHERE 1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) >= 0.8 - 1e-9",
)
def _(spark, d):
    """Campaign names against names typed by hand: all pairs at least 0.8 alike."""
    part = t.table(spark, d, "part")
    out = quality.similar_names(part.selectExpr(f"{_NAME} AS name"), part.selectExpr(f"{_TYPED} AS name"))
    return rounded(out, 9, "score")


@query("schema_snapshot", ORACLE["column_profile"])
def _(spark, d):
    """The profile written as JSON lines and read back."""
    path = f"{staging_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    files.write_schema_snapshot(t.ads(spark, d, **{c: GAPS[c] for c in ("country", "roas", "platform")}), path, approx=False)
    return spark.read.schema("column_name string, column_type string, non_null_count bigint, null_count bigint, unique_count bigint").json(path)


_SKETCHED = ("campaign_name", "adset_name", "spend", "clicks", "country")


@query(
    "profile_sketches_merged",
    t.ads_sql(**{"country": GAPS["country"]})
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, true AS within_error FROM ads" for c in _SKETCHED),
)
def _(spark, d):
    """Sketches of days stored in two parts, merged: counts are exact, distinct counts within the stated error."""
    path = f"{staging_dir(spark)}/sketches-{uuid.uuid4().hex}"
    facts = t.ads(spark, d, ["date", *_SKETCHED], country=GAPS["country"])
    month = facts.withColumn("date", F.trunc("date", "month"))
    files.write_profile_sketches(month.where("date < '1995-01-01'"), path)
    files.write_profile_sketches(month.where("date >= '1995-01-01' or date is null"), path)
    merged = quality.merged_profile(files.read_profile_sketches(spark, path))
    exact = quality.column_profile(facts.drop("date")).select("column_name", F.col("unique_count").alias("exact"))
    within = F.abs(F.col("unique_count") - F.col("exact")) <= F.lit(quality.SKETCH_ERROR) * F.col("exact")
    return merged.join(exact, "column_name").select("column_name", "non_null_count", "null_count", within.alias("within_error"))
