"""Markdown report sections as rows.

Each section is one row keyed by (section_order, key); the report is the rows
read in that order.  Nothing is concatenated across rows, so a report over many
insights is as distributed as the insights are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.operators.alerts import drift_digest


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), _text(x))), "\n")


def insight_sections(insights: DataFrame) -> DataFrame:
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0)) * 100
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), _text(F.col("hypothesis"))),
        F.lit(""),
        F.format_string("**Confidence:** %.0f%%", confidence),
        F.concat(F.lit("**Category:** "), _text(F.col("category"))),
        F.lit(""),
        F.lit("**Evidence:**"),
        F.coalesce(_bullets(F.col("evidence")), F.lit("")),
        F.lit(""),
        F.concat(F.lit("**Reasoning:** "), _text(F.col("reasoning"))),
        F.lit(""),
        F.concat(F.lit("**Recommendation:** "), _text(F.col("recommendation"))),
        F.lit(""),
        F.lit("---"),
    )
    return insights.select(
        F.lit(1).alias("section_order"), F.lit("insight").alias("section"), _text(F.col("id")).alias("key"), body.alias("body")
    )


def _variation(v: Column) -> Column:
    lines = (
        ("Type", "creative_type"), ("Headline", "headline"), ("Message", "message"), ("CTA", "cta"),
        ("Rationale", "rationale"), ("Expected effect", "expected_improvement"),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("#### Variation "), _text(v["variation_id"])),
        F.lit(""),
        *[F.concat(F.lit(f"- **{label}:** "), _text(v[name])) for label, name in lines],
    )


def creative_sections(creatives: DataFrame) -> DataFrame:
    variations = F.array_join(F.transform("creative_variations", _variation), "\n\n")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), _text(F.col("campaign"))),
        F.lit(""),
        F.concat(F.lit("**Problem:** "), _text(F.col("current_issue"))),
        F.lit(""),
        F.lit("**Proposed creatives:**"),
        F.lit(""),
        F.coalesce(variations, F.lit("")),
        F.lit(""),
        F.concat(F.lit("**How to test:** "), _text(F.col("testing_strategy"))),
        F.lit(""),
        F.lit("---"),
    )
    key = F.concat_ws(" / ", F.col("campaign"), F.col("adset"))
    return creatives.select(
        F.lit(2).alias("section_order"), F.lit("creative").alias("section"), key.alias("key"), body.alias("body")
    )


def quality_section(report: DataFrame) -> DataFrame:
    status = F.when(F.coalesce(F.col("pass_threshold"), F.lit(False)), "Passed").otherwise("Below the bar")
    body = F.concat_ws(
        "\n",
        F.lit("## Quality of the insights"),
        F.lit(""),
        F.format_string("- **Insights:** %d", F.col("total_insights")),
        F.format_string("- **Accepted:** %d", F.col("validated_count")),
        F.format_string("- **Mean quality:** %.2f/1.00", F.col("overall_quality")),
        F.concat(F.lit("- **Result:** "), status),
    )
    return report.select(
        F.lit(3).alias("section_order"), F.lit("quality").alias("section"), F.lit("").alias("key"), body.alias("body")
    )


def drift_sections(drift: DataFrame) -> DataFrame:
    """A row per drift or outlier alert, the most severe first."""
    text = drift_digest(drift)
    key = F.concat_ws(" ", F.col("rank").cast("string"), F.col("metric"), F.col("kind"))
    return text.select(F.lit(4).alias("section_order"), F.lit("drift").alias("section"), key.alias("key"), F.concat(F.lit("- "), F.col("text")).alias("body"))


def _headings(df: DataFrame, title: str, drift: bool) -> DataFrame:
    """The title and the heading of each part; their empty key sorts them before the part's rows."""
    parts = [(0, "title", f"# {title}"), (1, "heading", "## Insights"), (2, "heading", "## Creatives")]
    if drift:
        parts.append((4, "heading", "## Drift"))
    rows = F.array(*[F.struct(F.lit(o).alias("section_order"), F.lit(s).alias("section"), F.lit("").alias("key"), F.lit(b).alias("body")) for o, s, b in parts])
    return df.sparkSession.range(1).select(F.inline(rows))


def report_sections(
    insights: DataFrame, creatives: DataFrame | None = None, evaluation: DataFrame | None = None, drift: DataFrame | None = None, title: str | None = None
) -> DataFrame:
    """(section_order, section, key, body) rows of the whole report; with a ``title``,
    it and the parts' headings are rows too."""
    out = insight_sections(insights)
    if creatives is not None:
        out = out.unionByName(creative_sections(creatives))
    if evaluation is not None:
        out = out.unionByName(quality_section(evaluation))
    if drift is not None:
        out = out.unionByName(drift_sections(drift))
    if title is not None:
        out = out.unionByName(_headings(insights, title, drift is not None))
    return out
