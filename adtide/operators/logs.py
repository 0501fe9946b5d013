"""Roll-up of the execution log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_summary(log: DataFrame) -> DataFrame:
    """Per agent and event: number of entries, mean and longest duration, errors
    and retries.  Entries without an agent (session marks, metrics) belong to
    no group and are left out, like NULL keys everywhere else."""
    known = log.where(F.col("agent").isNotNull() & F.col("event").isNotNull())
    return known.groupBy("agent", "event").agg(
        F.count("*").alias("cnt"),
        F.avg("duration_seconds").alias("avg_duration"),
        F.max("duration_seconds").alias("max_duration"),
        F.count_if(F.col("event") == "error").alias("error_count"),
        F.count_if(F.col("event") == "retry_attempt").alias("retry_count"),
    )
