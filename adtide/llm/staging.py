"""Tables that cut lineage, in the folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
#: Whole-number keys (8 bytes each) that may be sent to all tasks; more are joined by shuffle.
BROADCAST_KEYS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a session that names none (a local
    test) gets a folder of its own; a cluster session without one is refused, as
    executors could not read each other's files."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adtide-llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and go on from the files.

    The files outlive lost executors, and a later step starts from them.  They
    may be deleted once nothing is read from the result any more.
    """
    path = f"{shared_dir(df.sparkSession)}/adtide-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leave_out(docs: DataFrame, named: DataFrame, key: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``named``; rows with a null key stay.

    Up to ``most`` whole-number keys are sent to all tasks, so that documents
    go through no shuffle.  More keys, or keys of another type, are joined by shuffle.
    """
    named = settle(named.select(key).filter(F.col(key).isNotNull()).distinct(), "left-out")
    if isinstance(named.schema[key].dataType, T.IntegralType) and named.count() <= most:
        named = F.broadcast(named)
    return docs.join(named, key, "left_anti")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), whose workers import it to run its functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="adtide-code-"), "adtide-code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)  # Spark serves the file to executors
    _shipped.add(context.applicationId)


_held: dict[object, Any] = {}


def hold(key: object, make: Callable[[], Any]) -> Any:
    """``make()``, once per worker process.  A worker serves one operator after the other and holds the
    model of the last one only: what others left is let go first, and its memory given back."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop the models that former tasks left in this worker process."""
    if _held:
        _held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)
