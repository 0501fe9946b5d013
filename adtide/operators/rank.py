"""Top-k reports.  ``orderBy().limit(k)`` becomes TakeOrderedAndProject: each
task keeps its best k rows and only those meet.  Group keys break ties."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.operators.rollups import campaign_adset_rollup, creative_rollup, segment_rollup

_PAIR = ("campaign_name", "adset_name")


def _order(metric: str, keys: tuple[str, ...], descending: bool) -> list[Column]:
    first = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return [first, *[F.col(k).asc() for k in keys]]


class Underperformers(NamedTuple):
    """``pairs``: every pair below the threshold; ``total``: one-row count;
    ``top``: the worst k."""

    pairs: DataFrame
    total: DataFrame
    top: DataFrame


def below_threshold(df: DataFrame, metric: str = "ctr", threshold: float | Column = 0.01) -> DataFrame:
    """Campaign/ad-set pairs under the threshold, unordered.

    Money and purchase counts use ``<=`` so that a threshold of zero finds the
    pairs that earned nothing; every other metric uses ``<``.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    value = F.col(metric)
    low = value <= limit if metric in ("revenue", "purchases") else value < limit
    return campaign_adset_rollup(df).where(low)


def underperformers(
    df: DataFrame, metric: str = "ctr", threshold: float | Column = 0.01, k: int = 10
) -> Underperformers:
    """Pairs below the threshold: by spend (largest first) for revenue and
    purchases, else by the metric (smallest first)."""
    pairs = below_threshold(df, metric, threshold)
    order = _order("spend", _PAIR, True) if metric in ("revenue", "purchases") else _order(metric, _PAIR, False)
    return Underperformers(pairs, pairs.agg(F.count("*").alias("count")), pairs.orderBy(*order).limit(k))


def segment_analysis(df: DataFrame, dimension: str = "creative_type", metric: str = "roas") -> DataFrame:
    """All segments of a dimension, best first."""
    return segment_rollup(df, dimension).orderBy(*_order(metric, (dimension,), True))


class CreativeAnalysis(NamedTuple):
    top: DataFrame
    bottom: DataFrame


def creative_analysis(df: DataFrame, k: int = 10) -> CreativeAnalysis:
    """Best and worst ``k`` creatives by mean row CTR; creatives without a CTR
    come last in both lists."""
    rated = creative_rollup(df)
    keys = ("creative_type", "creative_message")
    return CreativeAnalysis(
        rated.orderBy(*_order("ctr", keys, True)).limit(k),
        rated.orderBy(*_order("ctr", keys, False)).limit(k),
    )


class CreativeInputs(NamedTuple):
    worst_campaigns: DataFrame | None
    best_creatives: DataFrame | None


def creative_inputs(results: list, k: int = 5) -> CreativeInputs:
    """From a list of task results pick the rows that feed creative work; when
    several results of one kind are present the last one counts."""
    worst = best = None
    for result in results:
        data = getattr(result, "data", result)
        data = getattr(data, "analysis", data)
        if isinstance(data, Underperformers):
            worst = data.top
        if isinstance(data, CreativeAnalysis):
            best = data.top
    if worst is not None:
        order = [F.col("ctr").asc_nulls_last(), *[F.col(c) for c in _PAIR]]
        worst = worst.orderBy(*order).limit(k).select(
            F.col("campaign_name").alias("campaign"), F.col("adset_name").alias("adset"), "ctr", "spend"
        )
    if best is not None:
        best = best.orderBy(*_order("ctr", ("creative_type", "creative_message"), True)).limit(k).select(
            F.col("creative_message").alias("message"), F.col("creative_type").alias("type"), "ctr"
        )
    return CreativeInputs(worst, best)
