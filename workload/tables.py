"""Test tables shaped as ad-performance tables.

The same expression text is used for Spark and for the SQL twin.  Dimension
tables are joined only when one of their columns is asked for: their keys are
unique and the joins are outer, so leaving one out changes no other column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Money in units of 1/10000 as whole numbers: price in cents times a rate in
# hundredths.  Sums and ratios of these are exact and cheap.
_CENTS = "CAST(floor(l_extendedprice*100 + 0.5) AS BIGINT)"
_SPENT = f"{_CENTS} * CAST(floor(l_discount*100 + 0.5) AS BIGINT)"
_EARNED = f"CASE WHEN l_returnflag='R' THEN CAST(0 AS BIGINT) ELSE {_CENTS} * CAST(floor(l_tax*100 + 0.5) AS BIGINT) END"


def _money(units: str) -> str:
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4))"


BASE = {
    "date": "CAST(l_shipdate AS DATE)",
    "campaign_name": "p_brand",
    "adset_name": "p_type",
    "spend": _money(_SPENT),
    "impressions": "CAST(l_quantity*1000 AS BIGINT)",
    "clicks": "CAST(l_quantity*(l_orderkey % 40) AS BIGINT)",
    "purchases": "CAST(floor(l_quantity*(l_orderkey % 40)*(l_linenumber % 4)/20) AS BIGINT)",
    "revenue": _money(_EARNED),
    "creative_type": "o_orderpriority",
    "creative_message": "p_name",
    "audience_type": "c_mktsegment",
    "platform": "l_linestatus",
    "country": "n_name",
}
# Expressions the row ratios divide.
_PARTS = {"clicks": BASE["clicks"], "impressions": BASE["impressions"], "purchases": BASE["purchases"], "spent": _SPENT, "earned": _EARNED}
RATIOS = {
    "ctr": ("clicks", "impressions"),
    "roas": ("earned", "spent"),
    "cvr": ("purchases", "clicks"),
}
ADS_FIELDS = (
    "date", "campaign_name", "adset_name", "spend", "impressions", "clicks", "purchases", "revenue",
    "ctr", "roas", "cvr", "creative_type", "creative_message", "audience_type", "platform", "country",
)
# dimension table -> (join condition, table it hangs on).  What hangs on a dimension is joined to that, not to
# the facts, and the part with its long texts comes last: the facts are shuffled twice, the first time as they are.
_JOINS = {
    "orders": ("l_orderkey = o_orderkey", "lineitem"),
    "customer": ("o_custkey = c_custkey", "orders"),
    "nation": ("c_nationkey = n_nationkey", "customer"),
    "part": ("l_partkey = p_partkey", "lineitem"),
}
_COLUMN_TABLE = {
    "campaign_name": "part",
    "adset_name": "part",
    "creative_message": "part",
    "creative_type": "orders",
    "audience_type": "customer",
    "country": "nation",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratio(name: str) -> str:
    top, bottom = RATIOS[name]
    return f"CAST(part_{top} AS DOUBLE) / nullif(CAST(part_{bottom} AS DOUBLE), CAST(0 AS DOUBLE))"


def _joined(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    tables = {t for c in needed if (t := _COLUMN_TABLE.get(c))}
    for t in tuple(tables):
        while (t := _JOINS[t][1]) != "lineitem":
            tables.add(t)

    def whole(name: str) -> DataFrame:
        out = table(spark, sf_dir, name)
        for other, (condition, on) in _JOINS.items():
            if on == name and other in tables:
                out = out.join(whole(other), F.expr(condition), "left")
        return out

    return whole("lineitem")


def ads(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ADS_FIELDS, **replace: str) -> DataFrame:
    """The fact table with the given columns; ``replace`` puts another
    expression in place of a column's own."""
    needed = set(columns)
    parts = {p for name, pair in RATIOS.items() if name in needed for p in pair}
    base = _joined(spark, sf_dir, needed).selectExpr(
        *[f"{BASE[c]} AS {c}" for c in BASE if c in needed], *[f"{e} AS part_{p}" for p, e in _PARTS.items() if p in parts]
    )
    out = base.selectExpr("*", *[f"{_ratio(r)} AS {r}" for r in RATIOS if r in needed])
    return out.selectExpr(*[f"{replace.get(c, c)} AS {c}" for c in columns])


_FROM = (
    "FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey "
    "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
)


def ads_sql(**replace: str) -> str:
    """WITH clause defining ``ads`` (same ``replace`` meaning as in :func:`ads`)."""
    base = ", ".join([f"{e} AS {c}" for c, e in BASE.items()] + [f"{e} AS part_{p}" for p, e in _PARTS.items()])
    ratios = ", ".join(f"{_ratio(r)} AS {r}" for r in RATIOS)
    final = ", ".join(f"{replace.get(c, c)} AS {c}" for c in ADS_FIELDS)
    return (
        f"WITH base AS (SELECT {base} {_FROM}), full_rows AS (SELECT *, {ratios} FROM base), "
        f"ads AS (SELECT {final} FROM full_rows) "
    )


# --- the fact table as badly typed text -----------------------------------------------
_N = "l_orderkey"
TEXT = {
    "row_key": "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))",
    "date": f"CASE {_N} % 23 WHEN 0 THEN 'bad-date' WHEN 1 THEN '2025-02-30' WHEN 2 THEN NULL "
    "ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) END",
    "campaign_name": "CASE l_linenumber % 4 WHEN 0 THEN concat('  ', upper(p_name), ' ') "
    "WHEN 1 THEN replace(p_name, ' ', '   ') WHEN 2 THEN replace(upper(p_name), ' ', '-') "
    "ELSE concat(p_name, '''S 3d LAUNCH') END",
    "spend": f"CASE {_N} % 17 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN concat(' ', CAST({BASE['spend']} AS VARCHAR(30)), ' ') "
    f"WHEN 3 THEN NULL ELSE CAST({BASE['spend']} AS VARCHAR(30)) END",
    "impressions": f"CASE {_N} % 19 WHEN 0 THEN '1e3' WHEN 1 THEN 'n/a' WHEN 2 THEN '1_000' ELSE CAST({BASE['impressions']} AS VARCHAR(30)) END",
    "clicks": f"CASE {_N} % 29 WHEN 0 THEN '' ELSE CAST({BASE['clicks']} AS VARCHAR(30)) END",
    "purchases": f"CAST({BASE['purchases']} AS VARCHAR(30))",
    "revenue": f"CASE {_N} % 31 WHEN 0 THEN 'none' ELSE CAST({BASE['revenue']} AS VARCHAR(30)) END",
    "ctr": f"CASE {_N} % 13 WHEN 0 THEN 'nan' WHEN 1 THEN '-' ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR(10)) END",
    "roas": f"CASE {_N} % 11 WHEN 0 THEN ' 1.5 ' ELSE CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR(10)) END",
}


def text_ads(spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(TEXT)) -> DataFrame:
    return _joined(spark, sf_dir, set(columns)).selectExpr(*[f"{TEXT[c]} AS {c}" for c in columns])


def text_ads_sql() -> str:
    return "WITH text_ads AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in TEXT.items()) + f" {_FROM}) "


# --- insights from documents: every line of the text is an evidence item -----------------
INSIGHT = {
    "id": "CAST(doc_id AS VARCHAR(20))",
    "category": "lang",
    "hypothesis": "concat('ROAS changed ', CAST(doc_id % 60 AS VARCHAR(4)), '% in ', lang)",
    "confidence": "CAST((doc_id*37) % 101 AS DOUBLE)/100",
    "reasoning": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END",
    "recommendation": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END",
}
BATCHES = ("click", "error", "purchase", "signup", "view")
BATCH = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BATCHES)) + " END"


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return docs.selectExpr(*[f"{e} AS {c}" for c, e in INSIGHT.items()], f"{BATCH} AS batch", "text").withColumn(
        "evidence", lines
    ).drop("text")


INSIGHTS_SQL = (
    "WITH insights AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in INSIGHT.items())
    + f", {BATCH} AS batch, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS evidence FROM documents) "
)

# --- observed changes: one per user and event type -------------------------------------------
_CHANGE = "(max(value) - min(value)) / nullif(count(*), 0) - 1"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("batch"), "user_id").agg(F.expr(_CHANGE).alias("change_pct"))


RESULTS_SQL = f"results AS (SELECT event_type AS batch, user_id, {_CHANGE} AS change_pct FROM events GROUP BY 1, 2) "

# --- alerts and log entries from events -----------------------------------------------------------
ALERT = {
    "severity": "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END",
    "source": "event_type",
    "message": "concat('event of user ', CAST(user_id AS VARCHAR(20)))",
    "recommendation": "CASE WHEN user_id % 2 = 0 THEN 'look into it' END",
    "alert_id": "CAST(user_id AS VARCHAR(20))",
}


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return events.selectExpr(*[f"{e} AS {c}" for c, e in ALERT.items()], "map('event', CAST(event_id AS STRING)) AS details", "ts").withColumn(
        "ts", ts
    )


ALERTS_SQL = (
    "WITH alerts AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ALERT.items()) + ", event_id, ts FROM events) "
)
LOG_EVENT = (
    "CASE event_id % 6 WHEN 0 THEN 'start' WHEN 1 THEN 'complete' WHEN 2 THEN 'error' WHEN 3 THEN 'llm_call' "
    "WHEN 4 THEN 'retry_attempt' ELSE 'complete' END"
)


def execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "ts AS timestamp", "event_type AS agent", f"{LOG_EVENT} AS event", "value AS duration_seconds"
    )


# --- analysis requests from orders ------------------------------------------------------------------
REQUEST = {
    "request_id": "o_orderkey",
    "task_type": "CASE o_orderkey % 4 WHEN 0 THEN 'analyze_metric_trend' WHEN 1 THEN 'identify_underperformers' "
    "WHEN 2 THEN 'segment_analysis' ELSE 'unknown_task' END",
    "metric": "CASE o_custkey % 9 WHEN 0 THEN ' CTR ' WHEN 1 THEN 'Sales' WHEN 2 THEN 'roas' WHEN 3 THEN 'profit' WHEN 4 THEN NULL "
    "WHEN 5 THEN 'cost' WHEN 6 THEN 'cvr' WHEN 7 THEN 'conversions' ELSE 'cpm' END",
    "threshold": "CASE o_orderkey % 8 WHEN 0 THEN 'zero' WHEN 1 THEN 'Top_10' WHEN 2 THEN '0.02' WHEN 3 THEN 'low' WHEN 4 THEN NULL "
    "WHEN 5 THEN ' 1e-2 ' WHEN 6 THEN '-3' ELSE CAST(o_custkey AS VARCHAR(20)) END",
    "timeframe": "CASE o_orderkey % 5 WHEN 0 THEN concat('last_', CAST(o_custkey % 60 AS VARCHAR(4)), '_days') WHEN 1 THEN 'last_month' "
    "WHEN 2 THEN 'this_week' WHEN 3 THEN NULL ELSE 'last_14_days' END",
}
THRESHOLD_REQUEST = {
    "request_id": "o_orderkey",
    "metric": "CASE o_orderkey % 8 WHEN 0 THEN 'ctr' WHEN 1 THEN 'cvr' WHEN 2 THEN 'roas' WHEN 3 THEN 'confidence' WHEN 4 THEN 'quality' "
    "WHEN 5 THEN 'roas_change' WHEN 6 THEN 'min_spend' ELSE 'cpc' END",
    "campaign_id": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('C', CAST(o_custkey % 50 AS VARCHAR(4))) END",
    "data_quality": "CASE o_custkey % 4 WHEN 0 THEN 'volatile' WHEN 1 THEN 'stable' WHEN 2 THEN 'medium' ELSE NULL END",
}


def requests(spark: SparkSession, sf_dir: str, fields: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in fields.items()])


def requests_sql(fields: dict[str, str]) -> str:
    return "WITH requests AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in fields.items()) + " FROM orders) "
