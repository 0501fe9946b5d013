"""Fixed values of the ad-performance data model: columns, metric names, rule
limits and default thresholds.  Everything here is a plain constant; the
operators take it as a default argument so a caller can pass another one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 10)  # exact sums; 28 digits before the point

# --- metric vocabulary (fixed values) ---------------------------------------
BASE_METRICS = ("spend", "impressions", "clicks", "purchases", "revenue")
# ratio name -> (numerator, denominator, scale)
RATIO_METRICS = {
    "ctr": ("clicks", "impressions", 1),
    "roas": ("revenue", "spend", 1),
    "cvr": ("purchases", "clicks", 1),
    "cpc": ("spend", "clicks", 1),
    "cpm": ("spend", "impressions", 1000),
}
METRICS = BASE_METRICS + tuple(RATIO_METRICS)
METRIC_ALIASES = {"sales": "revenue", "conversions": "purchases", "cost": "spend"}

# --- task types and the metric each falls back to (fixed values) -------------
TASK_DEFAULT_METRIC = {
    "analyze_metric_trend": "roas",
    "identify_underperformers": "ctr",
    "segment_analysis": "roas",
    "creative_analysis": "ctr",
}
DEFAULT_TREND_DAYS = 7


# --- fact table ----------------------------------------------------------------
@dataclass(frozen=True)
class ColumnRule:
    """One expected column of the fact table."""

    name: str
    kind: str  # date | string | decimal | integer | float
    required: bool = True
    minimum: float | None = None
    maximum: float | None = None


# Expected columns, their kinds and value limits.
ADS_COLUMNS = (
    ColumnRule("date", "date"),
    ColumnRule("campaign_name", "string"),
    ColumnRule("adset_name", "string"),
    ColumnRule("spend", "decimal", minimum=0),
    ColumnRule("impressions", "integer", minimum=0),
    ColumnRule("clicks", "integer", minimum=0),
    ColumnRule("purchases", "integer", minimum=0),
    ColumnRule("revenue", "decimal", minimum=0),
    ColumnRule("ctr", "float", minimum=0, maximum=1),
    ColumnRule("roas", "float", minimum=0),
    ColumnRule("creative_type", "string", required=False),
    ColumnRule("creative_message", "string", required=False),
    ColumnRule("audience_type", "string", required=False),
    ColumnRule("platform", "string", required=False),
    ColumnRule("country", "string", required=False),
)
DIMENSIONS = ("creative_type", "platform", "country", "audience_type")

_SPARK_TYPES = {
    "date": T.DateType(),
    "string": T.StringType(),
    "decimal": MONEY,
    "integer": T.LongType(),
    "float": T.DoubleType(),
}
ADS_SCHEMA = T.StructType([T.StructField(c.name, _SPARK_TYPES[c.kind]) for c in ADS_COLUMNS])
# The same columns as they stand in a text file, before any conversion.
ADS_TEXT_SCHEMA = T.StructType([T.StructField(c.name, T.StringType()) for c in ADS_COLUMNS])


@dataclass(frozen=True)
class QualityLimits:
    """Data-quality limits of the fact table (fixed default values)."""

    min_rows: int = 100
    max_missing_pct_per_column: float = 10.0
    max_date_span_days: int = 365
    max_age_hours: float = 24.0
    max_missing_pct_overall: float = 5.0
    roas_unusual_above: float = 1000.0
    ctr_unusual_above: float = 0.5
    spend_unusual_above: float = 100000.0


# Words that mark a column name as a likely rename.
RENAME_KEYWORDS = {
    "revenue": ("sales", "amount", "income", "earnings"),
    "spend": ("cost", "budget", "expense"),
    "clicks": ("click", "tap"),
    "impressions": ("impression", "views", "reach"),
    "purchases": ("conversion", "order", "transaction", "buy"),
}
RENAME_KEYWORD_SCORE = 0.9
RENAME_MIN_SIMILARITY = 0.3


# --- thresholds ------------------------------------------------------------------
@dataclass(frozen=True)
class MetricBounds:
    low: float | None
    default: float | None
    high: float | None


@dataclass(frozen=True)
class ThresholdConfig:
    """Default threshold tree (fixed default values).

    ``metrics`` maps a metric either to bounds or to a single number;
    ``campaigns`` maps campaign -> {metric: threshold} and may instead be passed
    as a DataFrame to ``resolve_thresholds`` when it is large.
    """

    global_defaults: dict[str, float] = field(
        default_factory=lambda: {
            "ctr": 0.01,
            "cvr": 0.01,
            "roas": 1.0,
            "confidence": 0.6,
            "quality": 0.7,
            "roas_change": 0.15,
            "min_spend": 100.0,
        }
    )
    metrics: dict[str, MetricBounds | float] = field(
        default_factory=lambda: {
            "ctr": MetricBounds(0.005, 0.01, 0.05),
            "cvr": MetricBounds(0.01, 0.02, 0.10),
            "roas": MetricBounds(0.5, 1.0, 2.5),
        }
    )
    campaigns: dict[str, dict[str, float]] = field(default_factory=dict)
    fallback: float = 0.01
    # (metric or "*" for every other metric, quality level) -> multiplier
    multipliers: dict[tuple[str, str], float] = field(
        default_factory=lambda: {
            ("confidence", "volatile"): 0.7,
            ("confidence", "stable"): 1.2,
            ("quality", "volatile"): 0.85,
            ("quality", "stable"): 1.1,
            ("*", "volatile"): 0.7,
            ("*", "stable"): 1.2,
        }
    )
    high_variance_cv: float = 0.5
    low_variance_cv: float = 0.2
    stable_min_campaigns: int = 50
    min_evidence: int = 2
    volatile_extra_evidence: int = 1

    def metric_default(self, metric: str) -> float | None:
        entry = self.metrics.get(metric)
        return entry.default if isinstance(entry, MetricBounds) else entry


# --- drift (fixed default values) ---------------------------------------------
DRIFT_DROP_LIMITS = {"roas": 0.5, "ctr": 0.3, "cvr": 0.3}
CRITICAL_DROP = 0.5
OUTLIER_Z = 3.0
OUTLIER_WARNING_PCT = 10.0
BASELINE_METRICS = ("roas", "ctr", "cvr", "spend")

BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("p25", T.DoubleType()),
        T.StructField("p75", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("cnt", T.LongType()),
    ]
)

# --- alerts, insights, creatives, log ------------------------------------------
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
LOW_CONFIDENCE = 0.5
QUALITY_ALERT_BELOW = 0.6
QUALITY_CRITICAL_BELOW = 0.5
MIN_DATA_DAYS = 7
NO_DATA_DAYS = 999
ALERT_HISTORY_SIZE = 100

INSIGHT_TYPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("hypothesis", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("recommendation", T.StringType()),
    ]
)
VARIATION_TYPE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "variation_id", "creative_type", "headline", "message", "cta",
            "rationale", "expected_improvement",
        )
    ]
)
CREATIVE_TYPE = T.StructType(
    [
        T.StructField("campaign", T.StringType()),
        T.StructField("adset", T.StringType()),
        T.StructField("current_issue", T.StringType()),
        T.StructField("creative_variations", T.ArrayType(VARIATION_TYPE)),
        T.StructField("testing_strategy", T.StringType()),
    ]
)
SUBTASK_TYPE = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Union of the fields of all event kinds; a field an event lacks reads as NULL.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("max_attempts", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("next_delay_seconds", T.DoubleType()),
        T.StructField("recoverable", T.BooleanType()),
        T.StructField("stack_trace", T.ArrayType(T.StringType())),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_length", T.LongType()),
        T.StructField("system_prompt_length", T.LongType()),
        T.StructField("response_length", T.LongType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("prompt_preview", T.StringType()),
        T.StructField("response_preview", T.StringType()),
        T.StructField("validation_type", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("details", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("summary_type", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
