"""Group-by roll-ups of the fact table.

All of them are sums, counts and means, so Spark aggregates within each task
before anything is shuffled: a key holding a third of the rows still sends one
row per task.  Rows whose key is NULL belong to no group and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.functions.ratios import metric_value, with_ratio_metrics
from adtide.schema import BASE_METRICS, DIMENSIONS


def base_sums() -> list[Column]:
    """Sums of the base metrics; decimals add up exactly and leave as double."""
    out = []
    for name in BASE_METRICS:
        total = F.sum(name)
        out.append((total.cast("double") if name in ("spend", "revenue") else total).alias(name))
    return out


def rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base sums and the five ratios for every combination of ``keys``."""
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return with_ratio_metrics(known.groupBy(*keys).agg(*base_sums()))


def daily_rollup(df: DataFrame) -> DataFrame:
    return rollup(df, ["date"])


def campaign_adset_rollup(df: DataFrame) -> DataFrame:
    return rollup(df, ["campaign_name", "adset_name"])


def segment_rollup(df: DataFrame, dimension: str) -> DataFrame:
    return rollup(df, [dimension])


def creative_rollup(df: DataFrame) -> DataFrame:
    """Base sums per creative plus the unweighted means of the row ratios."""
    known = df.where(F.col("creative_type").isNotNull() & F.col("creative_message").isNotNull())
    return known.groupBy("creative_type", "creative_message").agg(
        *base_sums(), F.avg("ctr").alias("ctr"), F.avg("roas").alias("roas")
    )


def creative_variant_count(df: DataFrame) -> DataFrame:
    """Number of distinct (creative_type, creative_message) pairs."""
    known = df.where(F.col("creative_type").isNotNull() & F.col("creative_message").isNotNull())
    return known.select("creative_type", "creative_message").distinct().agg(
        F.count("*").alias("total_creative_variants")
    )


def creative_type_ctr(df: DataFrame) -> DataFrame:
    known = df.where(F.col("creative_type").isNotNull())
    return known.groupBy("creative_type").agg(F.avg("ctr").alias("avg_ctr"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: size, date range, totals and unweighted mean ratios, in one scan.

    A metric column the table lacks reports 0, a missing date column NULL.
    """
    have = set(df.columns)
    first, last = F.min("date"), F.max("date")
    if "date" in have:
        dates = [
            first.alias("start_date"),
            last.alias("end_date"),
            F.date_diff(last, first).cast("int").alias("days"),
        ]
    else:
        dates = [
            F.lit(None).cast("date").alias("start_date"),
            F.lit(None).cast("date").alias("end_date"),
            F.lit(None).cast("int").alias("days"),
        ]
    metrics = []
    for name in BASE_METRICS:
        kind = "double" if name in ("spend", "revenue") else "long"
        total = F.coalesce(F.sum(name).cast(kind), F.lit(0).cast(kind)) if name in have else F.lit(0).cast(kind)
        metrics.append(total.alias(f"total_{name}"))
    for name in ("ctr", "roas"):
        metrics.append((F.avg(name) if name in have else F.lit(0.0)).alias(f"avg_{name}"))
    campaigns = F.count_distinct("campaign_name") if "campaign_name" in have else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("total_rows"), *dates, campaigns.alias("campaign_count"), *metrics)


def campaign_overview(df: DataFrame, names: int = 5) -> DataFrame:
    """Distinct campaigns and the first ``names`` of them by name (a table has
    no row order to take the first ones from)."""
    distinct = df.where(F.col("campaign_name").isNotNull()).select("campaign_name").distinct()
    count = distinct.agg(F.count("*").alias("campaign_count"))
    first = distinct.orderBy("campaign_name").limit(names)
    listed = first.agg(F.array_sort(F.collect_list("campaign_name")).alias("first_names"))
    return count.withColumn("first_names", listed.scalar())


def value_counts(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows per value of each dimension the table has: (dimension, value, cnt).

    All dimensions are counted in one scan; read it by ``dimension`` and
    descending ``cnt``.  It stays a table of rows rather than one map, because
    the number of values is not bounded.
    """
    present = [d for d in dimensions if d in df.columns]
    pairs = ", ".join(f"'{d}', cast(`{d}` as string)" for d in present)
    long = df.select(F.expr(f"stack({len(present)}, {pairs}) as (dimension, value)"))
    return long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count("*").alias("cnt"))


def daily_metric(df: DataFrame, metric: str) -> DataFrame:
    """(date, value) of one metric per day; reads only the columns it needs."""
    known = df.where(F.col("date").isNotNull()).groupBy("date").agg(*base_sums())
    return known.select("date", metric_value(metric).alias("value"))


def shared_rollup(df: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Roll-ups by several sets of keys in one scan: ``key_set`` (its place in the list), the keys,
    row count, sums of the base metrics and means of the row ratios.

    The rows of one set, read with ``key_set_rows``, serve every operator that groups by these keys
    in place of the facts: a group of them has one row.
    """
    keys = list(dict.fromkeys(k for keys in key_sets for k in keys))
    sums = [F.sum(c).alias(c) for c in BASE_METRICS if c in df.columns]
    means = [F.avg(c).alias(c) for c in ("ctr", "roas") if c in df.columns]
    # one number per set: the bit of a key is set where the set lacks it
    number = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own): place for place, own in enumerate(key_sets)}
    place = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.col("_id").cast("int"))
    grouped = df.groupingSets([[F.col(k) for k in own] for own in key_sets], *keys)
    return grouped.agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("row_count"), *sums, *means).withColumn("key_set", place).drop("_id")


def key_set_rows(shared: DataFrame, place: int, keys: Sequence[str]) -> DataFrame:
    """The rows of one key set of a ``shared_rollup``, with the columns of facts."""
    values = [c for c in (*BASE_METRICS, "ctr", "roas") if c in shared.columns]
    return shared.where(F.col("key_set") == place).select(*keys, *values)
