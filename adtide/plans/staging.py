"""Running a small intermediate result once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder.  A cluster session without one is
    refused: executors cannot read each other's files, and a machine-local folder would not
    survive the loss of one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="adtide-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, keep it as a table in the staging folder and go on from that table.

    Meant for results that several later steps read.  The tables may be deleted once nothing
    is read from them any more.
    """
    path = f"{staging_dir(df.sparkSession)}/adtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
