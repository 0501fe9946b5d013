"""Statistical baseline of the key metrics and its store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtide.functions.quantiles import count_cells, percentiles, select_ranks
from adtide.plans.staging import settle
from adtide.schema import BASELINE_METRICS, BASELINE_SCHEMA
from adtide.sources.versions import newest_version, version_states, write_version


def number(df: DataFrame, name: str) -> Column:
    """Column as double; NaN, and text that is no number, count as missing."""
    value = F.col(f"`{name}`")
    value = value.try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else value.cast("double")
    return F.when(~F.isnan(value), value)


def metric_rows(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, value) rows of the named columns, values as double."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return df.select(*[number(df, m).alias(m) for m in metrics]).select(F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))


def _timestamp(value: str | None) -> Column:
    return F.lit(value).cast("timestamp") if value else F.current_timestamp()


_QUARTILES = (0.25, 0.5, 0.75)
#: Aggregates of the values ``_v`` that can be merged, given their number.
_PARTS = (("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))


def _dated_rows(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(date, metric, value) rows of the present metrics; missing values stay."""
    date = F.col("date").cast("date") if "date" in df.columns else F.lit(None).cast("date")
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    named = df.select(date.alias("date"), *[number(df, m).alias(m) for m in metrics])
    return named.select("date", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))


def _merged(parts: DataFrame) -> DataFrame:
    """One row per metric from ``parts`` (metric, cnt, mean, var, min, max, total_rows, start_date, end_date).

    The variance is what parts vary inside plus how far their means lie apart, so nothing cancels."""
    middle = parts.groupBy("metric").agg(F.sum(F.col("cnt") * F.col("mean")).alias("_sum"), F.sum("cnt").alias("_all"))
    middle = middle.select("metric", F.try_divide("_sum", "_all").alias("_middle"))  # a row per metric
    apart = F.sum(F.col("cnt") * (F.col("var") + (F.col("mean") - F.col("_middle")) ** 2))
    count = F.sum("cnt")
    return parts.join(F.broadcast(middle), "metric").groupBy("metric").agg(
        F.max("_middle").alias("mean"), F.when(count > 1, F.sqrt(apart / (count - 1))).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"),
        count.alias("cnt"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.sum("total_rows").alias("total_rows"),
    )


def _stats(spark: SparkSession, moments: DataFrame, quartiles: DataFrame, metrics: Sequence[str], created_at: str | None) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in metrics]).cast("array<string>")).alias("metric"))
    named = quartiles.select("metric", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"))
    joined = names.join(F.broadcast(moments), "metric", "left").join(F.broadcast(named), "metric", "left")  # a row per metric on all sides
    return joined.na.fill(0, ["cnt", "total_rows"]).select(_timestamp(created_at).alias("created_at"), *BASELINE_SCHEMA.fieldNames()[1:])


def baseline_stats(
    df: DataFrame,
    metrics: Sequence[str] = BASELINE_METRICS,
    created_at: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row per present metric: mean, sample deviation, quartiles, range,
    count, and the data window.

    The first counting pass of the quartiles also gives the moments, per cell and then
    merged, so that the table is read three times in all (once with ``approx``).
    """
    present = [m for m in metrics if m in df.columns]
    rows = _dated_rows(df, present)
    dates = [F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    cells = count_cells(rows, "value", ["metric"], [F.count("_v").alias("cnt"), *[f("_v").alias(n) for n, f in _PARTS], *dates])
    moments = _merged(cells.withColumnRenamed("_n", "total_rows"))
    if approx:
        quartiles = percentiles(rows, "value", _QUARTILES, ["metric"], approx)
    else:
        quartiles = select_ranks(rows, cells, "value", _QUARTILES, ["metric"])
    return _stats(df.sparkSession, moments, quartiles, present, created_at)


_STORED = {"baseline": BASELINE_SCHEMA}


def write_baseline(baseline: DataFrame, path: str) -> None:
    """Add a baseline version; earlier versions stay, the newest whole one counts."""
    rows = settle(baseline.select(*BASELINE_SCHEMA.fieldNames()).coalesce(1))  # a row per metric, with one time of creation
    newest = rows.agg(F.max("created_at").cast("string")).first()[0]
    write_version(baseline.sparkSession, path, {"baseline": rows}, newest)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest baseline version that is whole, or None when there is none.

    A version that is damaged (a file that cannot be read, rows that its manifest does not
    state) or unfinished is passed over for the one before it; ``baseline_versions`` names it.
    """
    found = newest_version(spark, path, _STORED)
    return found and found.tables["baseline"]


def baseline_versions(spark: SparkSession, path: str) -> DataFrame:
    """``(version, created_at, state)`` of all versions of a store: ``whole``, ``damaged`` or ``unfinished``."""
    return version_states(spark, path, _STORED)


def update_baseline(
    df: DataFrame, path: str, metrics: Sequence[str] = BASELINE_METRICS, created_at: str | None = None
) -> DataFrame | None:
    """Compute and store a new baseline; returns it as stored."""
    write_baseline(baseline_stats(df, metrics, created_at), path)
    return read_baseline(df.sparkSession, path)


# --- a baseline kept up to date from partial results per day -------------------------------------
_DAY_MOMENTS = "date date, metric string, cnt bigint, mean double, var double, min double, max double, total_rows bigint, start_date date, end_date date"
_DAY_VALUES = "date date, metric string, value double, times bigint"


def add_days(df: DataFrame, path: str, metrics: Sequence[str] = BASELINE_METRICS) -> None:
    """Add the days of ``df`` to the partial results at ``path``: per day and metric the
    moments, and how often each value occurs.  Only ``df`` is read, twice.

    A day that is there already is replaced as a whole.  Rows without a date count as one
    day of their own.
    """
    rows = _dated_rows(df, [m for m in metrics if m in df.columns])
    day = [F.col("date").alias("date"), "metric"]
    parts = [F.count("value").alias("cnt"), *[f("value").alias(n) for n, f in _PARTS]]
    moments = rows.groupBy(*day).agg(*parts, F.count(F.lit(1)).alias("total_rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    values = rows.where("value is not null").groupBy(*day, "value").agg(F.count(F.lit(1)).alias("times"))
    write_version(df.sparkSession, path, {"moments": moments, "values": values})


def _folder(file: Column, up: int) -> Column:
    """The folder ``up`` levels over a file; no pattern, as it is worked out for every row."""
    return F.substring_index(F.substring_index(file, "/", -(up + 1)), "/", 1)


def baseline_from_days(spark: SparkSession, path: str, metrics: Sequence[str] = BASELINE_METRICS, created_at: str | None = None) -> DataFrame:
    """The baseline of all days kept at ``path``: equal to ``baseline_stats`` over their rows, of which none is read.

    Of each day the newest version counts."""
    base = f"{path}/*/data"
    file = F.col("_metadata.file_path")
    made = spark.read.schema("created_at timestamp").json(f"{path}/*/manifest").select(_folder(file, 2).alias("version"), "created_at")
    version = _folder(file, 3)
    moments = spark.read.schema(_DAY_MOMENTS).parquet(f"{base}/moments").select(version.alias("version"), "*").join(F.broadcast(made), "version")  # a row per version
    newest = moments.groupBy("date").agg(F.max(F.struct("created_at", "version")).alias("_newest")).select(F.col("date").alias("_date"), F.col("_newest.version").alias("_version"))
    newest = F.broadcast(newest)  # a row per day
    current = F.col("date").eqNullSafe(F.col("_date")) & (F.col("version") == F.col("_version"))
    moments = moments.join(newest, current, "left_semi").where(F.col("metric").isin(*metrics))
    values = spark.read.schema(_DAY_VALUES).parquet(f"{base}/values").select(version.alias("version"), "*").where(F.col("metric").isin(*metrics))
    values = values.join(newest, current, "left_semi")
    quartiles = select_ranks(values, count_cells(values, "value", ["metric"], weight="times"), "value", _QUARTILES, ["metric"], "times")
    merged = _merged(moments)
    present = [r.metric for r in merged.select("metric").collect()]  # a row per metric
    return _stats(spark, merged, quartiles, [m for m in metrics if m in present], created_at)


def with_baseline_age(baseline: DataFrame, as_of: str | None = None) -> DataFrame:
    """Add ``age_days``, counted from ``created_at`` to ``as_of`` (default now)."""
    seconds = _timestamp(as_of).cast("double") - F.col("created_at").cast("double")
    return baseline.withColumn("age_days", seconds / 86400)
