"""Insight, contract, alert, log, report and end-to-end queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adtide.operators import alerts as alert_ops
from adtide.operators import contracts, insights, quality, rank, report, trends
from adtide.operators import logs as log_ops
from adtide.operators.thresholds import assess_data_quality
from adtide.plans.analyze import analyze
from adtide.plans.staging import staging_dir
from adtide.plans.tasks import insight_context
from adtide.sources import files
from workload import quality_queries as qq
from workload import tables as t
from workload.metric_queries import _CV, ADS, BASES, PAIRS, _drift_inputs, _drift_rows_sql, _trend_sql
from workload.registry import query, rounded

_DIGIT = "[\\p{Nd}\\x{00B2}\\x{00B3}\\x{00B9}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}]"
_CLAIM = "TRY_CAST(nullif(regexp_extract(hypothesis, '(\\d+)%', 1), '') AS DOUBLE)"


def _checked_sql(confidence: str = "0.6", evidence: str = "2", same_batch: bool = False) -> str:
    batch = "r.batch = i.batch AND " if same_batch else ""
    return (
        t.INSIGHTS_SQL
        + ", "
        + t.RESULTS_SQL
        + f", checked AS (SELECT i.*, coalesce(length(hypothesis) > 0, false) AS has_hypothesis, len(evidence) >= {evidence} AS has_evidence, "
        f"confidence IS NOT NULL AS has_confidence, confidence BETWEEN 0 AND 1 AS confidence_in_range, confidence >= {confidence} AS meets_threshold, "
        "coalesce(length(reasoning) > 0, false) AS has_reasoning, coalesce(length(recommendation) > 0, false) AS has_recommendation, "
        f"len(list_filter(evidence, lambda e: regexp_matches(e, '{_DIGIT}'))) > 0 AS evidence_is_quantitative, "
        f"{_CLAIM} IS NULL OR EXISTS (SELECT 1 FROM results r WHERE {batch}abs({_CLAIM} - abs(r.change_pct)) / greatest(abs(r.change_pct), 1) < 0.1) AS numerically_grounded "
        "FROM insights i), valid AS (SELECT *, has_hypothesis AND has_evidence AND has_confidence AND confidence_in_range AND meets_threshold AND has_reasoning AS is_valid, "
        "CAST(" + " + ".join(f"CAST({c} AS INTEGER)" for c in insights.CHECKS) + " AS DOUBLE) / 9 AS completeness FROM checked) "
    )


_QUALITY = "completeness * CAST(0.3 AS DOUBLE) + confidence * CAST(0.5 AS DOUBLE) + CAST(len(evidence) AS DOUBLE) / 5 * CAST(0.2 AS DOUBLE)"
_REASON = "CASE WHEN is_valid THEN NULL WHEN NOT meets_threshold THEN 'confidence below threshold' WHEN NOT has_evidence THEN 'insufficient evidence' ELSE 'failed basic checks' END"


def _checked(spark, d, **options):
    return insights.validate_insights(t.insights(spark, d), results=t.results(spark, d), **options)


@query(
    "insight_checks",
    _checked_sql() + f"SELECT id, {', '.join(insights.CHECKS)}, is_valid, round(completeness, 9) AS completeness, "
    "round(CAST(len(evidence) AS DOUBLE) / 5, 9) AS evidence_strength FROM valid",
)
def _(spark, d):
    out = _checked(spark, d).select("id", *insights.CHECKS, "is_valid", "completeness", "evidence_strength")
    return rounded(out, 9, "completeness", "evidence_strength")


@query("insight_rejections", _checked_sql() + f"SELECT id, confidence, {_REASON} AS rejection_reason FROM valid WHERE NOT is_valid")
def _(spark, d):
    return _checked(spark, d).where(~F.col("is_valid")).select("id", "confidence", "rejection_reason")


@query(
    "insight_quality_score",
    _checked_sql() + f"SELECT category, round(coalesce(avg({_QUALITY}) FILTER (WHERE is_valid), 0), 9) AS overall_quality FROM valid GROUP BY 1",
)
def _(spark, d):
    return rounded(insights.quality_score(_checked(spark, d), ["category"]), 9, "overall_quality")


@query("insight_grounding", _checked_sql() + f"SELECT id, {_CLAIM} AS claimed, numerically_grounded FROM valid")
def _(spark, d):
    out = insights.with_numeric_grounding(t.insights(spark, d), t.results(spark, d))
    return out.select("id", insights.claimed_pct(F.col("hypothesis")).alias("claimed"), "numerically_grounded")


@query("insight_grounding_by_batch", _checked_sql(same_batch=True) + "SELECT id, batch, numerically_grounded FROM valid")
def _(spark, d):
    out = insights.with_numeric_grounding(t.insights(spark, d), t.results(spark, d), ["batch"])
    return out.select("id", "batch", "numerically_grounded")


_REPORT = (
    "count(*) AS total_insights, count(*) FILTER (WHERE is_valid) AS validated_count, count(*) FILTER (WHERE NOT is_valid) AS rejected_count, "
    f"round(coalesce(avg({_QUALITY}) FILTER (WHERE is_valid), 0), 9) AS overall_quality"
)


def _report_out(df):
    return rounded(df, 9, "overall_quality", "min_confidence", "min_quality")


@query(
    "insight_evaluation",
    _checked_sql("0.42", "3")
    + f"SELECT *, overall_quality >= min_quality AS pass_threshold, validated_count < 2 OR overall_quality < 0.5 AS requires_retry FROM (SELECT {_REPORT}, "
    "CAST(0.42 AS DOUBLE) AS min_confidence, CAST(0.595 AS DOUBLE) AS min_quality, CAST(3 AS INTEGER) AS evidence_needed FROM valid)",
)
def _(spark, d):
    level = assess_data_quality(t.ads(spark, d, ["campaign_name", "ctr", "roas", "cvr"])).select("quality_level").scalar()
    return _report_out(insights.evaluate(t.insights(spark, d), t.results(spark, d), level).report)


_LEVEL = "CASE batch WHEN 'click' THEN 'volatile' WHEN 'view' THEN 'stable' ELSE 'medium' END"


@query(
    "insight_evaluation_by_batch",
    _checked_sql(
        "CASE i.batch WHEN 'click' THEN 0.42 WHEN 'view' THEN 0.72 ELSE 0.6 END",
        "CASE i.batch WHEN 'click' THEN 3 ELSE 2 END",
        same_batch=True,
    )
    + "SELECT *, overall_quality >= min_quality AS pass_threshold, validated_count < 2 OR overall_quality < 0.5 AS requires_retry FROM (SELECT batch, "
    + _REPORT
    + ", CAST(CASE batch WHEN 'click' THEN 0.42 WHEN 'view' THEN 0.72 ELSE 0.6 END AS DOUBLE) AS min_confidence, "
    "CAST(CASE batch WHEN 'click' THEN 0.595 WHEN 'view' THEN 0.77 ELSE 0.7 END AS DOUBLE) AS min_quality, "
    "CAST(CASE batch WHEN 'click' THEN 3 ELSE 2 END AS INTEGER) AS evidence_needed FROM valid GROUP BY batch)",
)
def _(spark, d):
    evaluation = insights.evaluate(t.insights(spark, d), t.results(spark, d), F.expr(_LEVEL), by=["batch"])
    return _report_out(evaluation.report)


_LOW = "SELECT id, confidence, CASE WHEN len(evidence) < 2 THEN 'insufficient evidence' ELSE 'volatile data' END AS reason FROM insights WHERE confidence < 0.5"


@query("low_confidence", t.INSIGHTS_SQL + _LOW)
def _(spark, d):
    return insights.low_confidence(t.insights(spark, d)).select("id", "confidence", "reason")


@query(
    "confidence_stats",
    t.INSIGHTS_SQL + "SELECT category, count(*) AS insight_count, round(avg(confidence), 9) AS avg_confidence, min(confidence) AS min_confidence, "
    "max(confidence) AS max_confidence FROM insights GROUP BY 1",
)
def _(spark, d):
    return rounded(insights.confidence_stats(t.insights(spark, d), ["category"]), 9, "avg_confidence")


def _changed_sql() -> str:
    one = {m: _trend_sql(m, n).replace(ADS, "", 1) for m, n in (("roas", 7), ("ctr", 30), ("cvr", 14))}
    # each trend query carries its own WITH parts; wrap them as sub-queries over ads
    return ADS + ", " + ", ".join(f"t_{m} AS (WITH {s.lstrip(', ')})" for m, s in one.items()) + " "


@query(
    "fallback_insights",
    _changed_sql()
    + "SELECT 'fallback_1' AS id, 'metric_change' AS category, printf('%s moved by %.1f%% against the days before', metric, change_pct) AS hypothesis, "
    "printf('mean of the recent days %.2f', recent_avg) AS evidence, CAST(0.5 AS DOUBLE) AS confidence FROM (SELECT * FROM t_roas UNION ALL SELECT * FROM t_ctr UNION ALL SELECT * FROM t_cvr)",
)
def _(spark, d):
    facts = t.ads(spark, d, ["date", *BASES])
    rows = trends.metric_trend(facts, "roas", 7)
    for metric, days in (("ctr", 30), ("cvr", 14)):
        rows = rows.unionByName(trends.metric_trend(facts, metric, days))
    out = insights.fallback_insights(rows)
    return out.select("id", "category", "hypothesis", F.array_join("evidence", "|").alias("evidence"), "confidence")


@query(
    "fallback_creatives",
    ADS
    + "SELECT campaign_name AS campaign, adset_name AS adset, printf('click-through rate of %.2f%%', ctr * 100) AS current_issue, 1 AS variations, "
    f"'Shop Now' AS cta FROM (SELECT * FROM ({PAIRS}) WHERE ctr < 0.0195 ORDER BY ctr, campaign_name, adset_name LIMIT 3)",
)
def _(spark, d):
    top = rank.underperformers(t.ads(spark, d, ["campaign_name", "adset_name", *BASES]), "ctr", 0.0195).top
    out = insights.fallback_creatives(top)
    return out.select(
        "campaign", "adset", "current_issue", F.size("creative_variations").alias("variations"), F.col("creative_variations")[0]["cta"].alias("cta")
    )


# --- raw model text ---------------------------------------------------------------------------
_SHAPE = "CASE WHEN turn % 2 = 1 THEN 'raw' WHEN conv_id % 5 = 0 THEN 'other' WHEN conv_id % 3 = 0 THEN 'plain' WHEN conv_id % 3 = 1 THEN 'tagged' ELSE 'fenced' END"


def _responses(spark, d):
    conversations = t.table(spark, d, "conversations")
    item = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("hypothesis"),
        F.array("role", "text").alias("evidence"),
        (F.col("conv_id") % 100 / 100.0).alias("confidence"),
    )
    body = F.to_json(F.struct(F.array(item).alias("insights")))
    shape = F.expr(_SHAPE)
    response = (
        F.when(shape == "raw", F.col("text"))
        .when(shape == "other", F.lit('{"note": 1}'))
        .when(shape == "plain", body)
        .when(shape == "tagged", F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nDone.")))
        .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))
    )
    return conversations.select("conv_id", "turn", response.alias("response"))


@query(
    "parsed_responses",
    f"SELECT conv_id, turn, shape = 'raw' AS is_fallback, CASE WHEN shape <> 'raw' THEN concat(conv_id, '-', turn) END AS id, "
    "CASE WHEN shape <> 'raw' THEN text END AS hypothesis, CASE WHEN shape <> 'raw' THEN 2 END AS evidence_items, "
    f"CASE WHEN shape <> 'raw' THEN round(CAST(conv_id % 100 AS DOUBLE) / 100, 9) END AS confidence FROM (SELECT *, {_SHAPE} AS shape FROM conversations) WHERE shape <> 'other'",
)
def _(spark, d):
    out = insights.response_items(_responses(spark, d), "response")
    out = out.select("conv_id", "turn", "is_fallback", "id", "hypothesis", F.size("evidence").alias("evidence_items"), "confidence")
    return rounded(out, 9, "confidence")


_ODD = "CASE conv_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'twice' WHEN 2 THEN 'text' ELSE 'cut' END"


def _odd_responses(spark, d, key, item):
    """Responses of four kinds around a JSON ``item`` with the place @ for a number: the number is
    NaN, the list and the field come twice, the number is text, or the response is cut short."""
    shape = F.expr(_ODD)
    number = F.format_string("%.2f", F.col("conv_id") % 100 / 100.0)
    fill = lambda value: F.replace(item, F.lit("@"), value)
    listed = lambda x: F.concat(F.lit(f'{{"{key}": ['), x, F.lit("]}"))
    response = (
        F.when(shape == "nan", listed(fill(F.lit("NaN"))))
        .when(shape == "twice", F.concat(F.lit(f'{{"{key}": [{{"task_id": 1}}], "{key}": ['), fill(F.concat(F.lit("0, \"confidence\": "), number)), F.lit(', "odd"]}')))
        .when(shape == "text", listed(fill(F.concat(F.lit('"'), number, F.lit('"')))))
        .otherwise(F.substring_index(listed(fill(number)), "]", 1))
    )
    return t.table(spark, d, "conversations").select("conv_id", "turn", response.alias("response"))


_KEY_SQL = "concat(conv_id, '-', turn)"


def _key():
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


@query(
    "parsed_responses_odd",
    f"SELECT conv_id, turn, o = 'cut' AS is_fallback, CASE WHEN o <> 'cut' THEN {_KEY_SQL} END AS id, CASE WHEN o <> 'cut' THEN role END AS evidence, "
    f"CASE WHEN o IN ('twice', 'text') THEN CAST(conv_id % 100 AS DOUBLE) / 100 END AS confidence FROM (SELECT *, {_ODD} AS o FROM conversations)",
)
def _(spark, d):
    """NaN, repeated keys, numbers and single items given as text."""
    item = F.concat(F.lit('{"id": "'), _key(), F.lit('", "evidence": "'), F.col("role"), F.lit('", "confidence": @}'))
    out = insights.response_items(_odd_responses(spark, d, "insights", item), "response")
    return out.select("conv_id", "turn", "is_fallback", "id", F.array_join("evidence", "|").alias("evidence"), "confidence")


@query(
    "parsed_recommendations_odd",
    f"SELECT conv_id, turn, o = 'cut' AS is_fallback, CASE WHEN o <> 'cut' THEN {_KEY_SQL} END AS campaign, CASE WHEN o <> 'cut' THEN role END AS headline, "
    "CASE o WHEN 'nan' THEN 'NaN' WHEN 'twice' THEN '0' WHEN 'text' THEN printf('%.2f', CAST(conv_id % 100 AS DOUBLE) / 100) END AS variation_id "
    f"FROM (SELECT *, {_ODD} AS o FROM conversations)",
)
def _(spark, d):
    """A single variation in place of a list, with a number for its name."""
    item = F.concat(F.lit('{"campaign": "'), _key(), F.lit('", "creative_variations": {"headline": "x", "headline": "'), F.col("role"), F.lit('", "variation_id": @}}'))
    out = insights.response_items(_odd_responses(spark, d, "recommendations", item), "response", "recommendations")
    first = F.col("creative_variations")[0]
    return out.select("conv_id", "turn", "is_fallback", "campaign", first["headline"].alias("headline"), first["variation_id"].alias("variation_id"))


@query(
    "parsed_subtasks_odd",
    f"SELECT conv_id, turn, o = 'cut' AS is_fallback, CASE WHEN o <> 'cut' THEN {_KEY_SQL} END AS task_id, CASE WHEN o <> 'cut' THEN role END AS metric, "
    "CASE o WHEN 'nan' THEN 'NaN' WHEN 'twice' THEN '0' WHEN 'text' THEN printf('%.2f', CAST(conv_id % 100 AS DOUBLE) / 100) END AS threshold "
    f"FROM (SELECT *, {_ODD} AS o FROM conversations)",
)
def _(spark, d):
    item = F.concat(F.lit('{"task_id": "'), _key(), F.lit('", "parameters": {"metric": 5, "metric": "'), F.col("role"), F.lit('", "threshold": @}}'))
    out = insights.response_items(_odd_responses(spark, d, "subtasks", item), "response", "subtasks")
    return out.select("conv_id", "turn", "is_fallback", "task_id", F.col("parameters")["metric"].alias("metric"), F.col("parameters")["threshold"].alias("threshold"))


# --- contracts -----------------------------------------------------------------------------------
_ITEM_SQL = "SELECT id, unnest(evidence) AS item, generate_subscripts(evidence, 1) - 1 AS pos FROM insights"
_CONTRACT_PARTS = [
    "SELECT id, 'insights.recommendation' AS path, 'required' AS rule FROM insights WHERE recommendation IS NULL",
    "SELECT id, 'insights.category', 'enum' FROM insights WHERE category NOT IN ('performance','creative_fatigue','audience','timing','budget','targeting')",
    "SELECT id, 'insights.evidence', 'minItems' FROM insights WHERE len(evidence) < 2",
    f"SELECT id, concat('insights.evidence[', pos, ']'), 'minLength' FROM ({_ITEM_SQL}) WHERE length(item) < 10",
]
for _name, _low, _high in (("hypothesis", 10, 300), ("reasoning", 20, 500), ("recommendation", 10, 300)):
    _CONTRACT_PARTS.append(f"SELECT id, 'insights.{_name}', 'minLength' FROM insights WHERE length({_name}) < {_low}")
    _CONTRACT_PARTS.append(f"SELECT id, 'insights.{_name}', 'maxLength' FROM insights WHERE length({_name}) > {_high}")


@query("contract_violations", t.INSIGHTS_SQL + " UNION ALL ".join(_CONTRACT_PARTS))
def _(spark, d):
    found = contracts.contract_violations(t.insights(spark, d), contracts.INSIGHTS_CONTRACT, "insights", ["id"])
    return found.select("id", "path", "rule")


@query(
    "contract_size",
    t.INSIGHTS_SQL + "SELECT category, 'maxItems' AS rule FROM insights GROUP BY category HAVING count(*) > 10",
)
def _(spark, d):
    found = contracts.contract_size_violations(t.insights(spark, d), contracts.INSIGHTS_CONTRACT, "insights", ["category"])
    return found.select("category", "rule")


@query(
    "contract_evidence_rule",
    t.INSIGHTS_SQL + "SELECT id, 'confidence_evidence_correlation' AS rule, confidence, CAST(len(evidence) AS INTEGER) AS evidence_count FROM insights WHERE confidence > 0.8 AND len(evidence) < 3",
)
def _(spark, d):
    return contracts.evidence_rule(t.insights(spark, d))


@query(
    "contract_evaluation_rules",
    _checked_sql(same_batch=True)
    + f", reports AS (SELECT batch, count(*) FILTER (WHERE is_valid) AS validated_count, coalesce(avg({_QUALITY}) FILTER (WHERE is_valid), 0) - 0.5 AS q, "
    "count(*) FILTER (WHERE is_valid AND has_recommendation) AS s FROM valid GROUP BY batch) "
    "SELECT batch, 'quality_threshold_validation' AS rule FROM reports WHERE q < 0.7 UNION ALL SELECT batch, 'validated_count_consistency' FROM reports WHERE validated_count <> s",
)
def _(spark, d):
    valid = _checked(spark, d, by=["batch"])
    score = insights.quality_score(valid, ["batch"]).select("batch", (F.col("overall_quality") - 0.5).alias("overall_quality"))
    counts = valid.groupBy("batch").agg(
        F.count_if("is_valid").alias("validated_count"),
        F.count_if(F.col("is_valid") & F.col("has_recommendation")).alias("validated_size"),
    )
    reports = score.join(counts, "batch").withColumn("pass_threshold", F.lit(True))
    return contracts.evaluation_rules(reports, ["batch"])


# --- alerts ------------------------------------------------------------------------------------------
@query(
    "alert_summary",
    t.ALERTS_SQL
    + "SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'WARNING') AS warning_count, "
    "count(*) FILTER (WHERE severity = 'INFO') AS info_count, count(DISTINCT source) AS source_count, count(*) FILTER (WHERE severity = 'CRITICAL') > 0 AS has_critical FROM alerts",
)
def _(spark, d):
    return alert_ops.alert_summary(t.alerts(spark, d))


@query("alert_sources", t.ALERTS_SQL + "SELECT source, count(*) AS cnt FROM alerts GROUP BY 1")
def _(spark, d):
    return alert_ops.alert_sources(t.alerts(spark, d))


@query("alerts_recurring", t.ALERTS_SQL + "SELECT alert_id, count(*) AS cnt FROM alerts GROUP BY 1 HAVING count(*) >= 65")
def _(spark, d):
    return alert_ops.recurring_alerts(t.alerts(spark, d), 65)


@query(
    "alert_history",
    t.ALERTS_SQL + "SELECT severity, source, alert_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM alerts ORDER BY ts DESC, alert_id, severity, source, message LIMIT 100",
)
def _(spark, d):
    out = alert_ops.alert_history(t.alerts(spark, d))
    return out.select("severity", "source", "alert_id", F.unix_micros("ts").alias("ts_us"))


@query("alerts_filtered", t.ALERTS_SQL + "SELECT event_id, alert_id, message FROM alerts WHERE severity = 'WARNING' AND source = 'purchase'".replace("event_id", "CAST(event_id AS VARCHAR) AS event_id"))
def _(spark, d):
    out = alert_ops.filter_alerts(t.alerts(spark, d), "WARNING", "purchase")
    return out.select(F.col("details")["event"].alias("event_id"), "alert_id", "message")


@query(
    "alert_digest",
    t.ALERTS_SQL
    + "SELECT 0 AS section, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS rank, source, alert_id, "
    "concat(severity, ': ', message, chr(10), '   Source: ', source, chr(10), '   event: ', event_id, "
    "CASE WHEN recommendation IS NOT NULL THEN concat(chr(10), '   Recommendation: ', recommendation) ELSE '' END) AS text FROM alerts UNION ALL "
    "SELECT 1, 0, source, alert_id, concat(recommendation, ' (', source, ')') FROM alerts WHERE severity = 'CRITICAL' AND recommendation IS NOT NULL",
)
def _(spark, d):
    return alert_ops.alert_digest(t.alerts(spark, d))


_MADE_DAYS = "CAST(floor((epoch(TIMESTAMP '2001-11-16 12:00:00') - epoch(CAST(max(date) AS TIMESTAMP))) / 86400) AS BIGINT)"
_MADE_HOURS = "(epoch(TIMESTAMP '2001-11-16 12:00:00') - epoch(CAST(max(date) AS TIMESTAMP))) / 3600"


@query(
    "alerts_made",
    _checked_sql(same_batch=True)
    + f", low AS ({_LOW}), reports AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE NOT is_valid) AS rej, "
    f"coalesce(avg({_QUALITY}) FILTER (WHERE is_valid), 0) - 0.5 AS q FROM valid GROUP BY batch), ads AS (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem) "
    "SELECT 'WARNING' AS severity, 'insight_agent' AS source, concat('low_confidence_', id) AS alert_id, "
    "printf('Insight ''%s'' is weakly supported (%.2f < 0.50)', id, confidence) AS message, reason AS detail FROM low UNION ALL "
    "SELECT CASE WHEN q < 0.5 THEN 'CRITICAL' ELSE 'WARNING' END, 'evaluator', 'quality_below_threshold', printf('Mean insight quality %.2f is under 0.60', q), "
    "concat(rej, '/', n) FROM reports WHERE q < 0.6 UNION ALL "
    f"SELECT 'CRITICAL', 'health_checker', 'missing_data', concat('The newest row is older than ', {_MADE_DAYS}, ' days'), CAST({_MADE_DAYS} AS VARCHAR) FROM ads HAVING {_MADE_DAYS} >= 7 UNION ALL "
    f"SELECT 'WARNING', 'health_checker', 'data_freshness', printf('data is %.1f hours old (limit 24)', {_MADE_HOURS}), printf('%.1f', {_MADE_HOURS}) FROM ads HAVING {_MADE_HOURS} > 24",
)
def _(spark, d):
    checked = _checked(spark, d, by=["batch"])
    report_rows = checked.groupBy("batch").agg(
        F.count("*").alias("total_insights"), F.count_if(~F.col("is_valid")).alias("rejected_count"),
        (F.coalesce(F.avg(F.when(F.col("is_valid"), insights.insight_quality())), F.lit(0.0)) - 0.5).alias("overall_quality"),
    )
    health = quality.check_freshness(t.ads(spark, d, ["date"]), "2001-11-16 12:00:00")
    made = alert_ops.make_alerts(insights.low_confidence(t.insights(spark, d)), report_rows, health, ts="2024-01-01")
    detail = F.coalesce(*[F.try_element_at("details", F.lit(k)) for k in ("reason", "rejected", "days_missing", "age_hours")])
    return made.select("severity", "source", "alert_id", "message", detail.alias("detail"))


# --- log and report -------------------------------------------------------------------------------------
@query(
    "log_summary",
    f"SELECT agent, event, count(*) AS cnt, round(avg(dur), 9) AS avg_duration, max(dur) AS max_duration, count(*) FILTER (WHERE event = 'error') AS error_count, "
    f"count(*) FILTER (WHERE event = 'retry_attempt') AS retry_count FROM (SELECT event_type AS agent, {t.LOG_EVENT} AS event, value AS dur FROM events) GROUP BY 1, 2",
)
def _(spark, d):
    return rounded(log_ops.log_summary(t.execution_log(spark, d)), 9, "avg_duration")


@query(
    "log_summary_read",
    f"SELECT agent, event, count(*) AS cnt, round(avg(dur), 9) AS avg_duration, max(dur) AS max_duration, count(*) FILTER (WHERE event = 'error') AS error_count "
    f"FROM (SELECT event_type AS agent, {t.LOG_EVENT} AS event, value AS dur FROM events) GROUP BY 1, 2",
)
def _(spark, d):
    """The log written as JSON lines and read back by the log source."""
    path = f"{staging_dir(spark)}/log-{uuid.uuid4().hex}"
    t.execution_log(spark, d).write.json(path)
    return rounded(log_ops.log_summary(files.read_execution_log(spark, path)), 9, "avg_duration").drop("retry_count")


@query(
    "insights_written",
    t.INSIGHTS_SQL + "SELECT id, category, hypothesis, len(evidence) AS evidence_count, confidence, reasoning, recommendation FROM insights",
)
def _(spark, d):
    path = f"{staging_dir(spark)}/insights-{uuid.uuid4().hex}"
    files.write_insights(t.insights(spark, d), path)
    return files.read_insights(spark, path).withColumn("evidence_count", F.size("evidence").cast("long")).drop("evidence")


_NL = " || chr(10) || "


@query(
    "report_sections",
    _checked_sql()
    + "SELECT 1 AS section_order, 'insight' AS section, id AS key, "
    + _NL.join(
        [
            "'### ' || hypothesis", "''", "printf('**Confidence:** %.0f%%', confidence * 100)", "'**Category:** ' || category", "''", "'**Evidence:**'",
            "array_to_string(list_transform(evidence, lambda e: '- ' || e), chr(10))", "''", "'**Reasoning:** ' || coalesce(reasoning, 'N/A')", "''",
            "'**Recommendation:** ' || coalesce(recommendation, 'N/A')", "''", "'---'",
        ]
    )
    + " AS body FROM insights UNION ALL SELECT 3, 'quality', '', "
    + _NL.join(
        [
            "'## Quality of the insights'", "''", "'- **Insights:** ' || count(*)", "'- **Accepted:** ' || count(*) FILTER (WHERE is_valid)",
            f"printf('- **Mean quality:** %.2f/1.00', coalesce(avg({_QUALITY}) FILTER (WHERE is_valid), 0))",
            f"'- **Result:** ' || CASE WHEN coalesce(avg({_QUALITY}) FILTER (WHERE is_valid), 0) >= 0.7 THEN 'Passed' ELSE 'Below the bar' END",
        ]
    )
    + " FROM valid",
)
def _(spark, d):
    rows = t.insights(spark, d)
    return report.report_sections(rows, None, insights.evaluate(rows, t.results(spark, d)).report)


_CREATIVE_BODY = _NL.join(
    [
        "'### ' || campaign_name", "''", "printf('**Problem:** click-through rate of %.2f%%', ctr * 100)", "''", "'**Proposed creatives:**'", "''",
        "'#### Variation fallback_1'", "''", "'- **Type:** UGC'", "'- **Headline:** See what customers pick first'",
        "'- **Message:** Rated by people who wear it every day'", "'- **CTA:** Shop Now'",
        "'- **Rationale:** Template text, to be adapted to the product by hand'", "'- **Expected effect:** Not estimated'", "''",
        "'**How to test:** Run next to the current creative with an even split'", "''", "'---'",
    ]
)


@query(
    "creative_sections",
    ADS
    + "SELECT 2 AS section_order, 'creative' AS section, concat(campaign_name, ' / ', adset_name) AS key, "
    + _CREATIVE_BODY
    + f" AS body FROM (SELECT * FROM ({PAIRS}) WHERE ctr < 0.0195 ORDER BY ctr, campaign_name, adset_name LIMIT 3)",
)
def _(spark, d):
    top = rank.underperformers(t.ads(spark, d, ["campaign_name", "adset_name", *BASES]), "ctr", 0.0195).top
    return report.creative_sections(insights.fallback_creatives(top))


# --- end to end ------------------------------------------------------------------------------------------
@query(
    "analyze_evaluation",
    ADS
    + ", "
    + _CV
    + "SELECT CAST(1 AS BIGINT) AS total_insights, CAST(0 AS BIGINT) AS validated_count, CAST(1 AS BIGINT) AS rejected_count, CAST(0 AS DOUBLE) AS overall_quality, "
    "CAST(CASE quality_level WHEN 'volatile' THEN 0.42 WHEN 'stable' THEN 0.72 ELSE 0.6 END AS DOUBLE) AS min_confidence, "
    "CAST(CASE quality_level WHEN 'volatile' THEN 0.595 WHEN 'stable' THEN 0.77 ELSE 0.7 END AS DOUBLE) AS min_quality, "
    "CAST(CASE quality_level WHEN 'volatile' THEN 3 ELSE 2 END AS INTEGER) AS evidence_needed, false AS pass_threshold, true AS requires_retry FROM quality",
)
def _(spark, d):
    return _report_out(analyze(t.ads(spark, d), as_of=qq.AS_OF).evaluation.report)


@query(
    "analyze_report",
    ADS
    + ", t_roas AS (WITH "
    + _trend_sql("roas", 7).replace(ADS, "", 1).lstrip(", ")
    + "), worst AS (SELECT * FROM ("
    + PAIRS
    + ") WHERE ctr < 0.0195 ORDER BY ctr, campaign_name, adset_name LIMIT 3) "
    "SELECT 1 AS section_order, 'fallback_1' AS key, printf('### roas moved by %.1f%% against the days before', change_pct) AS headline FROM t_roas UNION ALL "
    "SELECT 2, concat(campaign_name, ' / ', adset_name), concat('### ', campaign_name) FROM worst UNION ALL SELECT 3, '', '## Quality of the insights'",
)
def _(spark, d):
    tasks = [
        {"task_type": "analyze_metric_trend", "parameters": {"metric": "roas", "timeframe": "last_7_days"}},
        {"task_type": "identify_underperformers", "parameters": {"metric": "ctr", "threshold": "0.0195"}},
        {"task_type": "no_such_task"},
    ]
    out = analyze(t.ads(spark, d), tasks=tasks, as_of=qq.AS_OF).report
    return out.select("section_order", "key", F.substring_index("body", "\n", 1).alias("headline"))


_FACTORS = {"roas": 2.5, "ctr": 0.6, "cvr": 1.7}
_SHOWN = "printf(chr(10) || '   Baseline: %.3f' || chr(10) || '   Current: %.3f' || chr(10) || '   Change: %+.1f%%', baseline_value, current_value, change_pct)"
_DRIFT_MESSAGE = (
    "CASE WHEN kind = 'outlier' THEN printf('%d rows (%.1f%%) have outlier %s values', affected_rows, f, upper(metric)) "
    "WHEN change_pct < 0 THEN printf('%s dropped %.1f%%', upper(metric), -change_pct) ELSE printf('%s increased %.1f%% - verify data quality', upper(metric), change_pct) END"
)
_DRIFT_LINES = (
    f"{_DRIFT_MESSAGE} || CASE WHEN kind = 'drift' THEN {_SHOWN} || CASE WHEN severity = 'CRITICAL' THEN printf(chr(10) || '   Affected: %d rows' || chr(10) || "
    "'   Baseline median: %.3f' || chr(10) || '   Current median: %.3f', affected_rows, e, f) ELSE '' END "
    "WHEN severity = 'INFO' THEN '' ELSE printf(chr(10) || '   Affected: %d rows', affected_rows) END"
)
_HOURS = qq._AGE


@query(
    "analyze_with_drift",
    _drift_rows_sql(_FACTORS)
    + ", t_roas AS (WITH "
    + _trend_sql("roas", 7).replace(ADS, "", 1).lstrip(", ")
    + f"), worst AS (SELECT * FROM ({PAIRS}) WHERE ctr < 0.0195 ORDER BY ctr, campaign_name, adset_name LIMIT 3) "
    "SELECT 'report' AS part, 'title' AS name, '' AS key, '# Ad performance' AS body UNION ALL SELECT 'report', 'heading', '', unnest(['## Insights', '## Creatives', '## Drift']) UNION ALL "
    "SELECT 'report', 'insight', 'fallback_1', "
    + _NL.join(
        [
            "printf('### roas moved by %.1f%% against the days before', change_pct)", "''", "'**Confidence:** 50%'", "'**Category:** metric_change'", "''", "'**Evidence:**'",
            "printf('- mean of the recent days %.2f', recent_avg)", "''", "'**Reasoning:** Taken from the period comparison alone'", "''",
            "'**Recommendation:** Break the change down by campaign and creative'", "''", "'---'",
        ]
    )
    + f" FROM t_roas UNION ALL SELECT 'report', 'creative', concat(campaign_name, ' / ', adset_name), {_CREATIVE_BODY} FROM worst UNION ALL SELECT 'report', 'quality', '', "
    + _NL.join(["'## Quality of the insights'", "''", "'- **Insights:** 1'", "'- **Accepted:** 0'", "'- **Mean quality:** 0.00/1.00'", "'- **Result:** Below the bar'"])
    + " UNION ALL SELECT 'report', 'drift', concat(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, ' ', metric, ' ', kind), "
    f"'- ' || {_DRIFT_LINES} FROM alerts UNION ALL "
    "SELECT 'alert', source, alert_id, concat(severity, ': ', message, ' > ', coalesce(advice, '-')) FROM ("
    f"SELECT 'drift_detector' AS source, concat(kind, '_', metric) AS alert_id, severity, {_DRIFT_MESSAGE} AS message, CASE severity "
    "WHEN 'CRITICAL' THEN 'Find the cause, and store a new baseline once the change is meant to stay' WHEN 'WARNING' THEN 'Check the data of this metric' END AS advice FROM alerts UNION ALL "
    "SELECT 'evaluator', 'quality_below_threshold', 'CRITICAL', 'Mean insight quality 0.00 is under 0.60', 'Look at why insights were rejected, or lower the bar on purpose' UNION ALL "
    f"SELECT 'health_checker', 'missing_data', 'CRITICAL', concat('The newest row is older than ', CAST(floor({_HOURS} / 24) AS BIGINT), ' days'), "
    f"'Find out why the load brings no new days' FROM ads HAVING floor({_HOURS} / 24) >= 7 UNION ALL "
    f"SELECT 'health_checker', 'data_freshness', 'WARNING', printf('data is %.1f hours old (limit 24)', {_HOURS}), 'Load newer data or allow an older state' FROM ads HAVING {_HOURS} > 24)",
)
def _(spark, d):
    """The flagship with a stored baseline: the whole report and all alerts."""
    _, base = _drift_inputs(spark, d)
    tasks = [
        {"task_type": "analyze_metric_trend", "parameters": {"metric": "roas", "timeframe": "last_7_days"}},
        {"task_type": "identify_underperformers", "parameters": {"metric": "ctr", "threshold": "0.0195"}},
    ]
    facts = t.ads(spark, d, **{m: f"{m} * {f}" for m, f in _FACTORS.items()})
    out = analyze(facts, base, tasks, as_of=qq.AS_OF, title="Ad performance")
    rows = out.report.select(F.lit("report").alias("part"), F.col("section").alias("name"), "key", "body")
    body = F.concat("severity", F.lit(": "), "message", F.lit(" > "), F.coalesce("recommendation", F.lit("-")))
    return rows.unionByName(out.alerts.select(F.lit("alert").alias("part"), F.col("source").alias("name"), F.col("alert_id").alias("key"), body.alias("body")))


# --- sinks, context and fallbacks -----------------------------------------------------------------------
@query(
    "creatives_written",
    ADS
    + "SELECT campaign_name AS campaign, adset_name AS adset, printf('click-through rate of %.2f%%', ctr * 100) AS current_issue, "
    "'See what customers pick first' AS headline, 'Run next to the current creative with an even split' AS testing_strategy "
    f"FROM (SELECT * FROM ({PAIRS}) WHERE ctr < 0.0195 ORDER BY ctr, campaign_name, adset_name LIMIT 3)",
)
def _(spark, d):
    path = f"{staging_dir(spark)}/creatives-{uuid.uuid4().hex}"
    top = rank.underperformers(t.ads(spark, d, ["campaign_name", "adset_name", *BASES]), "ctr", 0.0195).top
    files.write_creatives(insights.fallback_creatives(top), path)
    out = files.read_creatives(spark, path)
    return out.select("campaign", "adset", "current_issue", F.col("creative_variations")[0]["headline"].alias("headline"), "testing_strategy")


@query(
    "insight_context",
    ADS
    + "SELECT 'summary' AS part, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM ads UNION ALL SELECT 'summary', 'spend', CAST(sum(spend) AS DOUBLE) FROM ads UNION ALL "
    "SELECT 'summary', 'campaigns', CAST(count(DISTINCT campaign_name) AS DOUBLE) FROM ads UNION ALL SELECT 'summary', 'roas', round(avg(roas), 9) FROM ads UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', {c}, CAST(count(*) AS DOUBLE) FROM ads WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("creative_type", "platform", "country", "audience_type")
    )
    + " UNION ALL SELECT 'time_series', x.name, x.value FROM (SELECT unnest([{'name': 'recent', 'value': recent_avg}, {'name': 'previous', 'value': previous_avg}]) AS x FROM (WITH "
    + _trend_sql("roas", 7, zero=True).replace(ADS, "", 1).lstrip(", ")
    + "))",
)
def _(spark, d):
    context = insight_context(t.ads(spark, d))
    named = lambda part, df, **cols: df.select(F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in cols.items()])))
    summary = named("summary", context.summary, rows=F.col("total_rows"), spend=F.col("total_spend"), campaigns=F.col("campaign_count"), roas=F.round("avg_roas", 9))
    series = named("time_series", context.time_series, recent=F.round("recent_avg", 9), previous=F.round("previous_avg", 9))
    counts = context.dimensions.select(F.col("dimension").alias("part"), F.col("value").alias("name"), F.col("cnt").cast("double").alias("value"))
    return summary.unionByName(series).unionByName(counts)


@query(
    "fallback_generic",
    ADS
    + ", t_roas AS (WITH "
    + _trend_sql("roas", 100000).replace(ADS, "", 1).lstrip(", ")
    + ") SELECT 'fallback_generic' AS id, 'No metric could be compared between periods' AS hypothesis, CAST(0.3 AS DOUBLE) AS confidence FROM t_roas WHERE change_pct IS NULL",
)
def _(spark, d):
    """A period longer than the data leaves nothing to compare with."""
    rows = trends.metric_trend(t.ads(spark, d, ["date", *BASES]), "roas", 100000)
    return insights.fallback_insights(rows).select("id", "hypothesis", "confidence")


@query(
    "required_columns_missing",
    ADS
    + "SELECT 'schema_consistency' AS check_name, count(*) < 0 AS passed, 'CRITICAL' AS severity, 'missing required columns: campaign, audience' AS message, 'campaign, audience' AS missing FROM ads",
)
def _(spark, d):
    out = quality.check_required(t.ads(spark, d, ["date", "campaign_name", "spend"]), ["date", "campaign", "audience", "spend"])
    return out.select("check_name", "passed", "severity", "message", F.col("details")["missing"].alias("missing"))
