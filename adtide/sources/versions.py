"""Small tables kept in versions, so that a damaged or half-written one does no harm.

A version is a folder of its own under the store's path: ``<version>/data/<table>``
holds its tables, ``<version>/manifest`` is written last and states their row counts and
hashes.  A folder without a manifest is unfinished, one that differs from its
manifest or cannot be read is damaged; neither is ever used or written to.
All files are listed and read through Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "created_at timestamp, tables array<struct<name: string, rows: bigint, hash: bigint>>"
_STATES = "version string, created_at timestamp, state string"


class Version(NamedTuple):
    name: str
    created_at: object
    tables: dict[str, DataFrame]


def _content(df: DataFrame) -> Row:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*[f"`{c}`" for c in df.columns])), F.lit(0)).alias("hash")).first()


def write_version(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], created_at: str | None = None) -> str:
    """Add a version and return its name; earlier ones stay."""
    version = f"v-{uuid.uuid4().hex}"
    facts = []
    for name, df in tables.items():
        place = f"{path}/{version}/data/{name}"
        df.write.parquet(place)
        facts.append((name, *_content(spark.read.schema(df.schema).parquet(place))))
    when = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    manifest = spark.createDataFrame([(facts,)], "tables array<struct<name: string, rows: bigint, hash: bigint>>").select(when.alias("created_at"), "tables")
    manifest.coalesce(1).write.json(f"{path}/{version}/manifest")
    return version


def _unless_unreadable(read: Callable[[], Any]) -> Any:
    """The result of ``read``, or None where a file is missing or damaged; other failures of a job are raised."""
    try:
        return read()
    except AnalysisException:
        return None
    except Py4JJavaError as error:
        if "FAILED_READ_FILE" not in str(error.java_exception):
            raise
        return None


def _manifests(spark: SparkSession, path: str) -> list[Row]:
    """(version, created_at, tables) of each folder, the newest first; without a usable manifest the latter are None."""

    def folders() -> list[str]:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")  # names only, no contents
        found = files.select(F.regexp_extract("path", r"/(v-[0-9a-f]{32})/", 1).alias("version")).where("version <> ''").distinct()
        return [r.version for r in found.collect()]  # a row per version

    def read(versions: str) -> list[Row]:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/(v-[0-9a-f]{32})/manifest/", 1)
        return spark.read.schema(_MANIFEST).json(f"{path}/{versions}/manifest").select(name.alias("version"), "*").collect()

    found = _unless_unreadable(folders) or []
    rows = _unless_unreadable(lambda: read("*"))
    if rows is None:  # one of them cannot be read
        rows = [r for v in found for r in _unless_unreadable(lambda v=v: read(v)) or ()]
    known = {r.version: r for r in rows}
    out = [known.get(v, Row(version=v, created_at=None, tables=None)) for v in found]
    return sorted(out, key=lambda r: (r.created_at is not None, r.created_at and r.created_at.timestamp(), r.version), reverse=True)


def _load(spark: SparkSession, path: str, manifest: Row, schemas: Mapping[str, T.StructType]) -> dict[str, DataFrame] | None:
    """The tables of a version, or None when one is missing, unreadable or not as stated."""
    stated = {t.name: (t.rows, t.hash) for t in manifest.tables or ()}

    def load() -> dict[str, DataFrame] | None:
        out = {n: spark.read.schema(schema).parquet(f"{path}/{manifest.version}/data/{n}") for n, schema in schemas.items()}
        return out if all(stated.get(n) == tuple(_content(df)) for n, df in out.items()) else None

    return _unless_unreadable(load)


def newest_version(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> Version | None:
    """The newest version that is whole, or None when there is none."""
    for manifest in _manifests(spark, path):
        tables = _load(spark, path, manifest, schemas) if manifest.created_at else None
        if tables is not None:
            return Version(manifest.version, manifest.created_at, tables)
    return None


def version_states(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """``(version, created_at, state)``: ``whole``, ``damaged`` or ``unfinished``, a row per version."""
    rows = []
    for manifest in _manifests(spark, path):
        whole = manifest.created_at and _load(spark, path, manifest, schemas) is not None
        rows.append((manifest.version, manifest.created_at, "whole" if whole else "damaged" if manifest.created_at else "unfinished"))
    return spark.createDataFrame(rows, _STATES)
