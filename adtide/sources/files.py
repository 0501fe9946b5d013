"""Log source and the file sinks for insights, creatives, reports and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtide.operators.quality import column_profile, profile_sketches
from adtide.schema import CREATIVE_TYPE, INSIGHT_TYPE, LOG_SCHEMA


def read_execution_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The JSON-lines event log under the union schema of all event kinds.

    A line that is no JSON object is kept with its text in ``_corrupt_record``.
    """
    reader = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_insights(insights: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Insights as JSON lines; columns beyond the insight fields are kept."""
    insights.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_creatives(creatives: DataFrame, path: str, mode: str = "overwrite") -> None:
    creatives.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSIGHT_TYPE).json(path)


def read_creatives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CREATIVE_TYPE).json(path)


def write_report(sections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report sections as text, range-partitioned so that the files in name
    order read as the report."""
    ordered = sections.orderBy("section_order", "key")
    ordered.select(F.col("body").alias("value")).write.mode(mode).text(path)


def write_schema_snapshot(df: DataFrame, path: str, approx: bool = True, mode: str = "overwrite") -> None:
    """The table's column profile as JSON lines."""
    column_profile(df, approx).write.mode(mode).json(path)


def write_profile_sketches(df: DataFrame, path: str, day: str = "date") -> None:
    """Mergeable profiles of the table's days, a folder per day; days that are there already are replaced."""
    sketches = profile_sketches(df, day)
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_profile_sketches(spark: SparkSession, path: str) -> DataFrame:
    kinds = "column_name string, column_type string, non_null_count bigint, null_count bigint, sketch binary, day string"
    return spark.read.schema(kinds).parquet(path)
