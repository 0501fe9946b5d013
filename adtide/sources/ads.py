"""Reading and cleaning the daily ad-performance fact table."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtide.functions.text import clean_campaign_name
from adtide.schema import ADS_TEXT_SCHEMA, BASE_METRICS, MONEY

_NUMERIC = {
    "spend": MONEY,
    "revenue": MONEY,
    "impressions": T.LongType(),
    "clicks": T.LongType(),
    "purchases": T.LongType(),
    "ctr": T.DoubleType(),
    "roas": T.DoubleType(),
    "cvr": T.DoubleType(),
}
#: Date forms that are tried in order after ISO dates and timestamps.
DATE_FORMATS = ("yyyy/MM/dd", "M/d/yyyy")


class EmptySourceError(ValueError):
    """The source exists but holds no rows and no header."""


class MissingSourceError(FileNotFoundError):
    """The source path does not exist."""


def _number(text: Column, target: T.DataType, wide: Column | None = None) -> Column:
    """Text to number; anything that is no number of the type is NULL.

    Whole numbers and decimals are read as such first and by way of a double
    (exponents, fractions) only where that fails.  ``wide`` is the text as double, if there is
    a column of it already.
    """
    wide = text.try_cast("double") if wide is None else wide
    if isinstance(target, T.DoubleType):
        return F.nullif(wide, F.lit(float("nan")))
    if isinstance(target, T.LongType):  # the double next to the largest whole number is beyond it
        wide = F.when((wide < 2.0**63) & (wide >= -(2.0**63)), wide)
    return F.coalesce(text.try_cast(target), wide.try_cast(target))


def parse_dates(df: DataFrame, column: str = "date", formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Date text to date: ISO first, then ``formats`` in order; a bad date becomes
    NULL and is counted by the quality report."""
    if column not in df.columns or isinstance(df.schema[column].dataType, T.DateType):
        return df
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.col(column).cast("date"))
    text = F.trim(F.col(column))
    other = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return df.withColumn(column, F.coalesce(F.try_to_date(text), text.try_cast("timestamp").cast("date"), *other))


def coerce_numeric(df: DataFrame, columns: Sequence[str] = tuple(_NUMERIC), wide: Sequence[str] = ()) -> DataFrame:
    """Convert the metric columns, those in ``wide`` to double; a value that is no number becomes NULL."""
    present = [c for c in columns if c in df.columns]
    changes = {}
    for name in present:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            changes[name] = _number(F.col(name), T.DoubleType() if name in wide else _NUMERIC.get(name, T.DoubleType()))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            changes[name] = F.when(~F.isnan(name), F.col(name))
    return df.withColumns(changes) if changes else df


def fill_metrics(df: DataFrame) -> DataFrame:
    """Missing base metrics count as 0; ratio columns keep their gaps."""
    present = [c for c in BASE_METRICS if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in present})


def with_clean_campaign_name(df: DataFrame) -> DataFrame:
    """Add ``campaign_name_clean`` next to the original name."""
    if "campaign_name" not in df.columns:
        return df
    return df.withColumn("campaign_name_clean", clean_campaign_name(F.col("campaign_name")))


def clean_ads(df: DataFrame, wide: Sequence[str] = ()) -> DataFrame:
    """Dates, numbers, gaps and campaign names in one narrow projection.

    Gaps in the base metrics become 0, but not a number that does not fit its column's type: it is
    NULL (see ``wide_columns`` for columns to read as double instead)."""
    texts = {c: _NUMERIC[c] for c in BASE_METRICS if c in df.columns and c not in wide and isinstance(df.schema[c].dataType, T.StringType)}
    rest = [c for c in _NUMERIC if c not in texts]
    read = _with_numbers(parse_dates(df), texts)
    filled = fill_metrics(coerce_numeric(read.withColumns({c: F.col(f"_held_{c}") for c in texts}), rest, wide))
    kept = {c: F.when(~n, F.col(c)) for c, n in _unfit_numbers(texts).items()}
    return with_clean_campaign_name((filled.withColumns(kept) if kept else filled).drop("_wide", *[f"_held_{c}" for c in texts]))


def _with_numbers(df: DataFrame, texts: dict[str, T.DataType]) -> DataFrame:
    """Add the text columns as doubles (``_wide``, an array) and as their types (``_held_<c>``).

    So each text is parsed once however often its number is used: one that is no number costs an exception
    each time.  As an array the doubles are a step of their own, so that what stands before and after it
    is compiled apart: in one piece it is too long for the JVM's compiler and runs several times slower."""
    if not texts:
        return df
    doubles = df.withColumn("_wide", F.transform(F.array(*[F.col(c) for c in texts]), lambda x: x.try_cast("double")))
    return doubles.withColumns({f"_held_{c}": _number(F.col(c), k, F.col("_wide")[i]) for i, (c, k) in enumerate(texts.items())})


def _unfit_numbers(texts: dict[str, T.DataType]) -> dict[str, Column]:
    """``unfit_number`` of the columns that ``_with_numbers`` has parsed."""
    return {c: _unfit(F.col("_wide")[i], F.col(f"_held_{c}"), k) for i, (c, k) in enumerate(texts.items())}


def unfit_number(text: Column, target: T.DataType) -> Column:
    """Whether a text is a finite number that ``target`` cannot hold: too large, or too small
    to be more than zero (or a fraction of it) there."""
    return _unfit(text.try_cast("double"), _number(text, target), target)


def _unfit(wide: Column, held: Column, target: T.DataType) -> Column:
    """As ``unfit_number``, of a text as double and as ``target``."""
    whole = F.signum(wide) * F.floor(F.abs(wide)).cast("double") if isinstance(target, T.LongType) else wide
    near = F.abs(held.cast("double") - whole) <= F.abs(wide) * 1e-9
    return F.coalesce((F.abs(wide) < float("inf")) & ~F.coalesce(near, F.lit(False)), F.lit(False))


def wide_columns(df: DataFrame) -> list[str]:
    """Money and count columns, still text, with a number that their type cannot hold (one scan)."""
    kinds = {c: k for c, k in _NUMERIC.items() if c in df.columns and isinstance(df.schema[c].dataType, T.StringType) and not isinstance(k, T.DoubleType)}
    if not kinds:
        return []
    read = _with_numbers(df.select(*kinds), kinds)
    found = read.agg(*[F.max(n).alias(c) for c, n in _unfit_numbers(kinds).items()]).first()
    return [c for c in kinds if found[c]]


class _File(NamedTuple):
    path: str
    names: tuple[str, ...]
    quoted: bool


def _names(header: str) -> tuple[str, ...]:
    """Column names of a header line; a blank name, or one that came before, gets its place."""
    out: list[str] = []
    for place, name in enumerate(next(csv.reader([header.lstrip("\ufeff")]))):
        out.append(name if name and name.lower() not in {n.lower() for n in out} else f"{name or '_c'}{place}")
    return tuple(out)


def _headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header, quoted) of the files that have a header line, from one scan of the lines.

    The set of at most two answers keeps the aggregate's state as objects, one per file: without it Spark
    sorts all lines by file before it aggregates, as the state holds a text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.withColumn("at", F.struct("block", F.monotonically_increasing_id())).where(F.trim("value") != "")
    quoted = F.array_contains(F.collect_set(F.col("value").contains('"')), True)
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), quoted.alias("quoted"))


def _files(spark: SparkSession, path: str | list[str], options: dict) -> list[_File]:
    """The header of each file that has one, and whether the file holds a quote."""
    out = []
    for r in _headers(spark, path).orderBy("file").collect():  # a row per file, as many as the reader lists
        file = re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(r.file))
        if r.header.count('"') % 2:  # a name with a line break
            names = tuple(spark.read.options(**options, multiLine=True).csv(file).columns)
        else:
            names = _names(r.header)
        out.append(_File(file, names, r.quoted))
    return out


def _read_csv(spark: SparkSession, path: str | list[str], multiline: bool) -> DataFrame:
    """All columns as text, each file by its own header.

    Files with one header are one scan.  Only files that hold a quote can have a line break
    inside of a field; all others are split over tasks."""
    options = {"header": True, "escape": '"'}
    files = _files(spark, path, options)
    if not files:
        raise EmptySourceError(f"source is empty: {path}")
    parts = []
    for names, quoted in dict.fromkeys((f.names, f.quoted and multiline) for f in files):
        paths = [f.path for f in files if (f.names, f.quoted and multiline) == (names, quoted)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(spark.read.options(**options, multiLine=quoted).schema(schema).csv(paths))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_ads(spark: SparkSession, path: str | list[str], format: str = "csv", multiline: bool = True, exact: bool | None = None) -> DataFrame:
    """The cleaned fact table from CSV (header row) or parquet files.

    ``path`` may be a file, a directory, a glob or a list of these.  Each CSV file is read by
    its own header: files are brought together by column name, whatever the order, and a column
    that one lacks is NULL there.  ``multiline`` lets quoted fields hold line breaks; a file
    that holds a quote is then read by one task.

    Money is read as decimal and counts as whole numbers, so that sums are exact.  A column in which a
    number does not fit is read as double instead, so that no number is lost: ``exact=None`` looks
    (one more scan of CSV), ``exact=True`` keeps the types and makes such numbers NULL, ``exact=False``
    reads doubles.  Columns outside the schema are kept as text.  A missing path raises
    :class:`MissingSourceError`, a CSV source without a header :class:`EmptySourceError`.
    """
    try:
        raw = _read_csv(spark, path, multiline) if format == "csv" else spark.read.format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            kind = MissingSourceError if error.getCondition() == "PATH_NOT_FOUND" else EmptySourceError
            raise kind(f"cannot read {path}") from error
        raise
    wide = wide_columns(raw) if exact is None else [] if exact else [c for c, k in _NUMERIC.items() if not isinstance(k, T.DoubleType)]
    return clean_ads(raw, wide)


def text_columns() -> list[str]:
    """Names of the text-file columns in file order."""
    return ADS_TEXT_SCHEMA.fieldNames()


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """A repeatable random sample of ``n`` rows; all rows when there are fewer.

    Rows are ordered by a hash of ``keys`` and the seed, so the choice does not depend on
    partitioning.  A histogram of the hashes' leading digits is counted first (one scan, now): all
    rows under the cell that holds the last place are taken where they are, and only the rows of that
    cell are put in order.  A cell of more than ``_SAMPLE_ROWS`` rows is counted by its next digits, so
    no task takes more than that (but for rows that are equal in all keys) whatever ``n`` is.
    """
    keys = list(keys or df.columns)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("~")) for k in keys])
    mark = _free_name("_mark", df.columns)
    marked = df.withColumn(mark, F.md5(text.cast("binary")))
    digits, left, prefix = 0, n, ""
    taken: Column = F.lit(False)
    while True:
        digits += _SAMPLE_DIGITS
        cell = F.substring(mark, 1, digits)
        inside = marked.where(F.col(mark).startswith(prefix)) if prefix else marked
        counts = sorted((r.cell, r.n) for r in inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most _SAMPLE_CELLS rows
        border = None
        for name, size in counts:
            if size > left:
                border = (name, size)
                break
            left -= size
        if border is None:  # all rows of the cell are in the sample
            return marked.where(taken | (F.col(mark).startswith(prefix) if prefix else F.lit(True))).drop(mark)
        taken = taken | (F.col(mark).startswith(prefix) & (cell < border[0]) if prefix else cell < border[0])
        prefix = border[0]
        if left == 0:
            return marked.where(taken).drop(mark)
        if border[1] <= _SAMPLE_ROWS or digits >= 32:
            order = [F.col(mark), *[F.col(f"`{c}`").asc_nulls_last() for c in df.columns]]
            last = marked.where(F.col(mark).startswith(prefix)).orderBy(*order).limit(left)
            return marked.where(taken).unionByName(last).drop(mark)


def _free_name(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


#: Hex digits of a hash counted at once, the cells these make, and rows of a cell that are put in order.
_SAMPLE_DIGITS = 3
_SAMPLE_CELLS = 16**_SAMPLE_DIGITS
_SAMPLE_ROWS = 100_000
