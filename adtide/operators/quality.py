"""Schema, data-quality and health checks.

Every check that looks at data is an aggregate, so all of them are written
against one wide aggregate row (:func:`quality_scan`) and unfolded into check
rows afterwards.  A single check uses the same row; the optimizer drops the
aggregates and columns it does not need from the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtide.plans.staging import settle
from adtide.schema import (
    ADS_COLUMNS,
    RENAME_KEYWORD_SCORE,
    RENAME_KEYWORDS,
    RENAME_MIN_SIMILARITY,
    ColumnRule,
    QualityLimits,
)
from adtide.sources.ads import coerce_numeric, parse_dates

Rules = Sequence[ColumnRule]
LIMITS = QualityLimits()


# --- the shared scan -----------------------------------------------------------
def scan_columns(df: DataFrame, rules: Rules = ADS_COLUMNS) -> list[Column]:
    """Aggregates of one scan: row count, NULLs per column, rule violations per column,
    date range and the extreme values the health checks look at."""
    have = set(df.columns)
    aggs = [F.count("*").alias("total_rows")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]
    for r in rules:
        if r.name not in have:
            continue
        if r.minimum is not None:
            aggs.append(F.count_if(F.col(r.name) < r.minimum).alias(f"below_{r.name}"))
        if r.maximum is not None:
            aggs.append(F.count_if(F.col(r.name) > r.maximum).alias(f"above_{r.name}"))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    day = isinstance(df.schema["date"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) if "date" in have else False
    aggs.append((F.min(F.to_date("date")) if day else none.cast("date")).alias("first_date"))
    aggs.append((F.max(F.to_date("date")) if day else none.cast("date")).alias("last_date"))
    for name in ("spend", "roas"):
        aggs.append((F.count_if(F.col(name) < 0) if name in have else zero).alias(f"negative_{name}"))
    unshown = F.count_if((F.col("impressions") == 0) & (F.col("spend") > 0)) if {"impressions", "spend"} <= have else zero
    aggs.append(unshown.alias("unshown_spend"))
    for name in ("roas", "ctr", "spend"):
        aggs.append((F.max(F.col(name).cast("double")) if name in have else none.cast("double")).alias(f"max_{name}"))
    return aggs


def quality_scan(df: DataFrame, rules: Rules = ADS_COLUMNS) -> DataFrame:
    """The aggregates of ``scan_columns`` as one row."""
    return df.agg(*scan_columns(df, rules))


def _unfold(wide: DataFrame, structs: list[Column], schema: str) -> DataFrame:
    """Check rows from the one-row scan; an empty list keeps the schema."""
    rows = F.array(*structs).cast(f"array<struct<{schema}>>") if structs else F.array().cast(f"array<struct<{schema}>>")
    return wide.select(F.inline(rows))


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


# --- profile ---------------------------------------------------------------------
def _profile_key(df: DataFrame, position: int, name: str) -> Column:
    """A column value as (position, text, whole number, fraction) with one of the
    last three set; a narrow key that needs no text form of numbers and dates."""
    value, kind = F.col(f"`{name}`"), df.schema[name].dataType
    whole = value.cast("long") if isinstance(kind, T.IntegralType) else None
    if isinstance(kind, T.DateType):
        whole = F.unix_date(value).cast("long")
    fraction = value.cast("double") if isinstance(kind, (T.DoubleType, T.FloatType)) else None
    text = value.cast("string") if whole is None and fraction is None else None
    parts = {"s": (text, "string"), "l": (whole, "long"), "d": (fraction, "double")}
    return F.struct(
        F.lit(position).alias("i"), *[(F.lit(None) if v is None else v).cast(k).alias(n) for n, (v, k) in parts.items()]
    )


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, non-null, null and distinct counts, from one scan.

    Exact distinct counts group by (column, value), which each task does for
    its own rows first, so a frequent value is shuffled once per task.
    ``approx`` uses a sketch instead and shuffles no values at all.
    """
    names = df.columns
    if approx:
        aggs = []
        for i, c in enumerate(names):
            col = F.col(f"`{c}`")
            aggs += [
                F.count(col).alias(f"set_{i}"),
                F.count_if(col.isNull()).alias(f"null_{i}"),
                F.approx_count_distinct(col).alias(f"distinct_{i}"),
            ]
        wide = df.agg(*aggs)
    else:
        cells = df.select(F.inline(F.array(*[_profile_key(df, i, c) for i, c in enumerate(names)])))
        values = cells.groupBy("i", "s", "l", "d").agg(F.count("*").alias("n"))
        is_set = F.col("s").isNotNull() | F.col("l").isNotNull() | F.col("d").isNotNull()
        n = F.col("n")
        aggs = []
        for i in range(len(names)):
            mine = F.col("i") == i
            aggs += [
                F.coalesce(F.sum(F.when(mine & is_set, n)), F.lit(0)).alias(f"set_{i}"),
                F.coalesce(F.sum(F.when(mine & ~is_set, n)), F.lit(0)).alias(f"null_{i}"),
                F.count_if(mine & is_set).alias(f"distinct_{i}"),
            ]
        wide = values.agg(*aggs)
    rows = [
        _named(
            column_name=F.lit(c),
            column_type=F.lit(df.schema[c].dataType.simpleString()),
            non_null_count=F.col(f"set_{i}"),
            null_count=F.col(f"null_{i}"),
            unique_count=F.col(f"distinct_{i}"),
        )
        for i, c in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


#: Size of a stored distinct-count sketch (2 to this power registers) and the relative error its estimates keep to
#: in all but very rare cases: three times 1.04 over the root of the number of registers.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def profile_sketches(df: DataFrame, day: str = "date") -> DataFrame:
    """Per day and column: (day, column_name, column_type, non_null_count, null_count, sketch), from one scan.

    The sketch of distinct values has a bounded size and can be merged, so profiles of days add up
    to the profile of any period without reading its rows again.
    """
    names = [c for c in df.columns if c != day]
    aggs = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`").cast("string")
        aggs += [F.count(col).alias(f"set_{i}"), F.count_if(col.isNull()).alias(f"null_{i}"), F.hll_sketch_agg(col, SKETCH_BITS).alias(f"sketch_{i}")]
    rows = [
        _named(
            column_name=F.lit(c),
            column_type=F.lit(df.schema[c].dataType.simpleString()),
            non_null_count=F.col(f"set_{i}"),
            null_count=F.col(f"null_{i}"),
            sketch=F.col(f"sketch_{i}"),
        )
        for i, c in enumerate(names)
    ]
    return df.groupBy(F.col(f"`{day}`").cast("string").alias("day")).agg(*aggs).select("day", F.inline(F.array(*rows)))


def merged_profile(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The column profile of the days in ``sketches``; distinct counts are within ``SKETCH_ERROR`` of the exact ones.
    A column whose type changed has the types in order, joined by a bar."""
    types = F.array_join(F.array_sort(F.collect_set("column_type")), "|")
    return sketches.groupBy(*by, "column_name").agg(
        types.alias("column_type"),
        F.sum("non_null_count").alias("non_null_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_count"),
    )


# --- schema checks ----------------------------------------------------------------
def missing_required_columns(df: DataFrame, rules: Rules = ADS_COLUMNS) -> list[str]:
    return [r.name for r in rules if r.required and r.name not in df.columns]


def schema_drift(df: DataFrame, rules: Rules = ADS_COLUMNS) -> dict[str, list[str]]:
    """New columns and removed optional columns of a table (metadata only)."""
    expected = {r.name for r in rules}
    return {
        "new_columns": [c for c in df.columns if c not in expected],
        "removed_optional_columns": [r.name for r in rules if not r.required and r.name not in df.columns],
    }


def catalog_drift(columns: DataFrame, name: str = "column_name", by: Sequence[str] = (), rules: Rules = ADS_COLUMNS) -> DataFrame:
    """Schema drift over a *table of column names*: ``by`` + (kind, column_name)
    with kind ``new``, ``missing_required`` or ``removed_optional``."""
    expected = [r.name for r in rules]
    known = columns.where(F.col(name).isNotNull())
    new = known.where(~F.col(name).isin(expected)).select(*by, F.lit("new").alias("kind"), F.col(name).alias("column_name"))
    present = known.groupBy(*by).agg(*[F.coalesce(F.max(F.col(name) == c), F.lit(False)).alias(f"has_{c}") for c in expected])
    rows = [
        _named(
            present=F.col(f"has_{r.name}"),
            kind=F.lit("missing_required" if r.required else "removed_optional"),
            column_name=F.lit(r.name),
        )
        for r in rules
    ]
    gone = present.select(*by, F.inline(F.array(*rows))).where(~F.col("present")).drop("present")
    return new.distinct().unionByName(gone)


def rename_candidates(
    columns: DataFrame,
    name: str = "column_name",
    expected: Sequence[str] = tuple(RENAME_KEYWORDS),
    keywords: dict[str, tuple[str, ...]] = RENAME_KEYWORDS,
    min_similarity: float = RENAME_MIN_SIMILARITY,
) -> DataFrame:
    """Best replacement for each expected column in a table of column names:
    (expected, candidate, score, reason).

    A name containing a keyword of the expected column scores highest; without
    one the closest name by edit distance is taken, if close enough.  All
    expected columns are matched in one aggregate over the names - no pair of
    rows is ever formed.
    """
    actual = F.lower(F.col(name))
    best = []
    for e in expected:
        hit = F.array_compact(F.array(*[F.when(actual.contains(k), F.lit(k)) for k in keywords.get(e.lower(), ())]))
        word = F.try_element_at(hit, F.lit(1)) if keywords.get(e.lower()) else F.lit(None).cast("string")
        longest = F.greatest(F.length(actual), F.lit(len(e)))
        alike = 1 - F.try_divide(F.levenshtein(actual, F.lit(e.lower())).cast("double"), longest.cast("double"))
        score = F.when(word.isNotNull(), F.lit(RENAME_KEYWORD_SCORE)).when(alike >= min_similarity, alike)
        rank = F.when(word.isNotNull(), 0).otherwise(1)
        # smallest struct: keyword matches first, then best score, then name
        choice = F.struct(rank.alias("rank"), (-score).alias("neg"), F.col(name).alias("name"), word.alias("word"))
        best.append(F.min(F.when(score.isNotNull(), choice)).alias(e))
    rows = [
        _named(
            expected=F.lit(e),
            candidate=F.col(e)["name"],
            score=-F.col(e)["neg"],
            reason=F.when(F.col(e)["word"].isNotNull(), F.concat(F.lit("contains "), F.col(e)["word"])).otherwise("similarity"),
        )
        for e in expected
    ]
    known = columns.select(name).where(F.col(name).isNotNull()).distinct()  # edit distance once per name
    return known.agg(*best).select(F.inline(F.array(*rows))).where(F.col("candidate").isNotNull())


def _grams(name: Column, q: int) -> Column:
    """The q-grams of a name with marks at both ends, as hashes; one that comes again is told apart by its number."""
    framed = F.concat(F.lit("\x01" * (q - 1)), name, F.lit("\x02" * (q - 1)))
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.char_length(framed) - (q - 1)), lambda i: F.substring(framed, i, q)))
    return F.transform(grams, lambda g, i: F.xxhash64(g, i - F.array_position(grams, g)))


def similar_names(left: DataFrame, right: DataFrame, name: str = "name", min_similarity: float = 0.8, q: int = 2) -> DataFrame:
    """All pairs of different names of two tables that are at least so similar (one minus the edit distance over
    the longer length): (``left``, ``right``, distance, score).  Names are compared in lower case;
    equal ones have distance 0.  For similarities over one half.

    Names within so many edits share a number of q-grams that follows from their lengths, and so one of
    the rarest few of each: only these are entered in the inverted lists, a list per gram and length of name, so
    common grams hardly form lists.  Candidates are filtered by length and by the number of grams they
    share before any edit distance is worked out, and that stops at the greatest distance allowed.
    """
    if not min_similarity > 0.5:
        raise ValueError("similarities of one half or less leave names without a shared gram")
    spare = f"cast(floor((1 - {min_similarity}D) * {{0}} + 1e-9) as int)"  # edits that a longer length allows
    shared = f"{{0}} + {q - 1} - {q} * {spare}"  # grams that two names then share

    def distinct(df: DataFrame, side: str) -> DataFrame:
        known = df.select(F.lower(F.col(f"`{name}`").cast("string")).alias("name")).where(F.col("name").isNotNull()).distinct()
        return known.select("name", F.char_length("name").alias("size"), _grams(F.col("name"), q).alias("grams"), F.lit(side).alias("side"))

    names = settle(distinct(left, "l").unionByName(distinct(right, "r")))
    each = names.select("name", "size", "side", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "gram").groupBy("side", "name", "size").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))  # as long as a name
    longest = f"cast(floor(size / {min_similarity}D + 1e-9) as int)"
    least = f"array_min(transform(sequence(size, {longest}), m -> {shared.format('m')}))"
    ranked = ranked.select("side", "name", "size", F.col("grams.gram").alias("grams"), F.expr(f"slice(grams.gram, 1, size(grams) - greatest({least}, 1) + 1)").alias("rare"))
    entries = settle(ranked.select("*", F.explode("rare").alias("gram")))
    left_, right_ = (entries.where(F.col("side") == side).select("gram", "size", *[F.col(c).alias(f"{c}_{side}") for c in ("name", "grams", "rare", "size")]) for side in ("l", "r"))
    sizes = F.expr(f"sequence(cast(ceil(size_l * {min_similarity}D - 1e-9) as int), cast(floor(size_l / {min_similarity}D + 1e-9) as int))")
    met = left_.withColumn("size", F.explode(sizes)).join(right_, ["gram", "size"])
    met = met.where(F.array_intersect("rare_l", "rare_r")[0] == F.col("gram"))  # a pair counts in the rarest list it meets in
    met = met.withColumn("longer", F.greatest("size_l", "size_r")).where(F.size(F.array_intersect("grams_l", "grams_r")) >= F.expr(shared.format("longer")))
    near = met.withColumn("distance", F.expr(f"levenshtein(name_l, name_r, {spare.format('longer')})")).where("distance >= 0")
    score = F.when(F.col("longer") == 0, F.lit(1.0)).otherwise(1 - F.col("distance") / F.col("longer"))
    return near.select(F.col("name_l").alias("left"), F.col("name_r").alias("right"), "distance", score.alias("score"))


def _type_fits(kind: str, actual: T.DataType) -> bool:
    if kind == "date":
        return isinstance(actual, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return kind == "string" or isinstance(actual, T.NumericType)


def wrong_types(df: DataFrame, rules: Rules = ADS_COLUMNS) -> list[tuple[str, str, str]]:
    """(column, expected kind, actual type) of columns declared with a type the
    rule does not allow (metadata only)."""
    return [
        (r.name, r.kind, df.schema[r.name].dataType.simpleString())
        for r in rules
        if r.name in df.columns and not _type_fits(r.kind, df.schema[r.name].dataType)
    ]


def type_mismatches(text: DataFrame, rules: Rules = ADS_COLUMNS) -> DataFrame:
    """For a table still in text form: per typed column how many values cannot
    be read as that type."""
    typed = [r for r in rules if r.kind != "string" and r.name in text.columns]
    parsed = coerce_numeric(
        parse_dates(text.withColumns({f"raw_{r.name}": F.col(r.name) for r in typed})),
        [r.name for r in typed if r.kind != "date"],
    )
    bad = [F.count_if(F.col(f"raw_{r.name}").isNotNull() & F.col(r.name).isNull()).alias(r.name) for r in typed]
    rows = [_named(column_name=F.lit(r.name), expected=F.lit(r.kind), bad_values=F.col(r.name)) for r in typed]
    return parsed.agg(*bad).select(F.inline(F.array(*rows))).where(F.col("bad_values") > 0)


# --- value and quality rules ---------------------------------------------------------
def _range_structs(df: DataFrame, rules: Rules) -> list[Column]:
    out = []
    for r in rules:
        if r.name not in df.columns:
            continue
        for side, limit in (("below", r.minimum), ("above", r.maximum)):
            if limit is not None:
                out.append(
                    _named(
                        column_name=F.lit(r.name),
                        violation=F.lit(f"{side} {'minimum' if side == 'below' else 'maximum'}"),
                        limit_value=F.lit(float(limit)),
                        violations=F.col(f"{side}_{r.name}"),
                    )
                )
    return out


def range_violations(df: DataFrame, rules: Rules = ADS_COLUMNS) -> DataFrame:
    """Columns with values outside their limits and how many there are."""
    rows = _unfold(
        quality_scan(df, rules),
        _range_structs(df, rules),
        "column_name:string,violation:string,limit_value:double,violations:bigint",
    )
    return rows.where(F.col("violations") > 0)


def column_missing_pct(df: DataFrame) -> DataFrame:
    """Share of NULLs per column in percent."""
    rows = [
        _named(
            column_name=F.lit(c),
            missing=F.col(f"`null_{c}`"),
            missing_pct=F.try_divide(F.col(f"`null_{c}`") * 100.0, F.col("total_rows")),
        )
        for c in df.columns
    ]
    return _unfold(quality_scan(df), rows, "column_name:string,missing:bigint,missing_pct:double")


def _rule_structs(df: DataFrame, limits: QualityLimits) -> list[Column]:
    total = F.col("total_rows")
    span = F.date_diff(F.col("last_date"), F.col("first_date"))

    def rule(name: str, column: str | None, observed: Column, limit: float, broken: Column) -> Column:
        return _named(
            rule=F.lit(name),
            column_name=F.lit(column),
            observed=F.when(broken, observed.cast("double")),
            limit_value=F.lit(float(limit)),
        )

    out = [rule("min_rows", None, total, limits.min_rows, total < limits.min_rows)]
    for c in df.columns:
        pct = F.try_divide(F.col(f"`null_{c}`") * 100.0, total)
        limit = limits.max_missing_pct_per_column
        out.append(rule("max_missing_percentage", c, pct, limit, pct > limit))
    out.append(rule("date_range_max_days", "date", span, limits.max_date_span_days, span > limits.max_date_span_days))
    return out


def quality_rules(df: DataFrame, limits: QualityLimits = LIMITS) -> DataFrame:
    """Broken data-quality rules with the observed value and the limit."""
    rows = _unfold(
        quality_scan(df), _rule_structs(df, limits), "rule:string,column_name:string,observed:double,limit_value:double"
    )
    return rows.where(F.col("observed").isNotNull())


_REPORT = "check:string,level:string,subject:string,observed:double,message:string"


def _finding(check: str, level: str, subject: str | None, observed: Column, message: str) -> Column:
    return _named(
        check=F.lit(check), level=F.lit(level), subject=F.lit(subject), observed=observed.cast("double"), message=F.lit(message)
    )


def validate(df: DataFrame, rules: Rules = ADS_COLUMNS, limits: QualityLimits = LIMITS) -> DataFrame:
    """The full validation report in one scan: (check, level, subject, observed,
    message) with level error, warning, suggestion or drift.

    Errors mean the table should not be used; deciding that is the caller's.
    """
    found, always = [], F.lit(1.0)
    missing = missing_required_columns(df, rules)
    for c in missing:
        found.append(_finding("required_columns", "error", c, always, f"required column {c} is missing"))
    if missing:
        names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
        hints = rename_candidates(names, expected=missing)
    for c, kind, actual in wrong_types(df, rules):
        found.append(_finding("data_types", "warning", c, always, f"expected {kind}, got {actual}"))
    for r in rules:
        if r.name not in df.columns or not _type_fits(r.kind, df.schema[r.name].dataType):
            continue
        for side, limit in (("below", r.minimum), ("above", r.maximum)):
            if limit is not None:
                n = F.col(f"{side}_{r.name}")
                found.append(_finding("value_ranges", "error", r.name, F.when(n > 0, n), f"values {side} {limit}"))
    for s in _rule_structs(df, limits):
        found.append(
            _named(
                check=F.lit("data_quality"),
                level=F.lit("warning"),
                subject=s["column_name"],
                observed=s["observed"],
                message=F.concat(s["rule"], F.lit(" limit "), s["limit_value"].cast("string")),
            )
        )
    drift = schema_drift(df, rules)
    for c in drift["new_columns"]:
        found.append(_finding("schema_drift", "drift", c, always, "new column"))
    for c in drift["removed_optional_columns"]:
        found.append(_finding("schema_drift", "drift", c, always, "optional column removed"))
    typed_rules = [r for r in rules if r.name in df.columns and _type_fits(r.kind, df.schema[r.name].dataType)]
    report = _unfold(quality_scan(df, typed_rules), found, _REPORT).where(F.col("observed").isNotNull())
    if missing:
        message = F.concat(F.lit("did you mean "), F.col("candidate"), F.lit("? ("), F.col("reason"), F.lit(")"))
        report = report.unionByName(
            hints.select(
                F.lit("required_columns").alias("check"),
                F.lit("suggestion").alias("level"),
                F.col("expected").alias("subject"),
                F.col("score").alias("observed"),
                message.alias("message"),
            )
        )
    return report


# --- health checks ------------------------------------------------------------------
_HEALTH = "check_name:string,passed:boolean,severity:string,message:string,details:map<string,string>"


def _details(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _result(name: str, passed: Column, bad: str, message: Column, details: Column) -> Column:
    return _named(
        check_name=F.lit(name),
        passed=passed,
        severity=F.when(passed, "INFO").otherwise(bad),
        message=message,
        details=details,
    )


def _age_hours(as_of: str | None) -> Column:
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return (now.cast("double") - F.col("last_date").cast("timestamp").cast("double")) / 3600


def _freshness(as_of: str | None, limits: QualityLimits) -> Column:
    age = _age_hours(as_of)
    fresh = F.coalesce(age <= limits.max_age_hours, F.lit(False))
    message = (
        F.when(F.col("last_date").isNull(), "no date to tell the data age")
        .when(fresh, F.format_string("data is fresh (%.1f hours old)", age))
        .otherwise(F.format_string(f"data is %.1f hours old (limit {limits.max_age_hours:g})", age))
    )
    return _result("data_freshness", fresh, "WARNING", message, _details(age_hours=age, last_date=F.col("last_date")))


def _completeness(df: DataFrame, limits: QualityLimits) -> Column:
    nulls = F.lit(0).cast("long")
    for c in df.columns:
        nulls = nulls + F.col(f"`null_{c}`")
    pct = F.try_divide(nulls * 100.0, F.col("total_rows") * len(df.columns))
    empty = F.col("total_rows") == 0
    passed = ~empty & (pct <= limits.max_missing_pct_overall)
    message = (
        F.when(empty, "no data rows found")
        .when(passed, F.format_string("%d rows, %.2f%% missing", F.col("total_rows"), pct))
        .otherwise(F.format_string(f"%.1f%% missing (limit {limits.max_missing_pct_overall:g}%%)", pct))
    )
    out = _result("data_completeness", passed, "WARNING", message, _details(total_rows=F.col("total_rows"), missing_pct=pct))
    return out.withField("severity", F.when(empty, "CRITICAL").otherwise(out["severity"]))


def _validity() -> Column:
    counts = {n: F.col(n) for n in ("negative_spend", "negative_roas", "unshown_spend")}
    passed = F.greatest(*counts.values()) == 0
    message = F.when(passed, "all values valid").otherwise("data validity issues found")
    return _result("data_validity", passed, "WARNING", message, _details(**counts))


def _consistency(df: DataFrame, required: Sequence[str]) -> Column:
    missing = [c for c in required if c not in df.columns]
    text = F.lit(", ".join(missing))
    message = F.lit(f"missing required columns: {', '.join(missing)}" if missing else "all required columns present")
    return _result("schema_consistency", F.lit(not missing), "CRITICAL", message, _details(missing=text))


def _metric_ranges(limits: QualityLimits) -> Column:
    top = {
        "roas": limits.roas_unusual_above, "ctr": limits.ctr_unusual_above, "spend": limits.spend_unusual_above,
    }
    unusual = F.lit(False)
    for m, limit in top.items():
        unusual = unusual | F.coalesce(F.col(f"max_{m}") > limit, F.lit(False))
    message = F.when(unusual, "unusual metric values detected").otherwise("all metrics within expected ranges")
    details = _details(**{f"max_{m}": F.col(f"max_{m}") for m in top})
    # unusual values are worth a note, never a failure
    return _result("metric_ranges", F.lit(True), "INFO", message, details)


def required_names(rules: Rules = ADS_COLUMNS) -> list[str]:
    return [r.name for r in rules if r.required]


def check_freshness(df: DataFrame, as_of: str | None = None, limits: QualityLimits = LIMITS) -> DataFrame:
    return _unfold(quality_scan(df), [_freshness(as_of, limits)], _HEALTH)


def check_completeness(df: DataFrame, limits: QualityLimits = LIMITS) -> DataFrame:
    return _unfold(quality_scan(df), [_completeness(df, limits)], _HEALTH)


def check_validity(df: DataFrame) -> DataFrame:
    return _unfold(quality_scan(df), [_validity()], _HEALTH)


def check_required(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _unfold(quality_scan(df), [_consistency(df, columns or required_names())], _HEALTH)


def check_metric_ranges(df: DataFrame, limits: QualityLimits = LIMITS) -> DataFrame:
    return _unfold(quality_scan(df), [_metric_ranges(limits)], _HEALTH)


def run_health_checks(
    df: DataFrame,
    as_of: str | None = None,
    limits: QualityLimits = LIMITS,
    required: Sequence[str] | None = None,
    scan: DataFrame | None = None,
) -> DataFrame:
    """All five health checks, one row each, from a single scan; ``scan`` is its row where it has been made."""
    checks = [
        _freshness(as_of, limits),
        _completeness(df, limits),
        _validity(),
        _consistency(df, required or required_names()),
        _metric_ranges(limits),
    ]
    return _unfold(quality_scan(df) if scan is None else scan, checks, _HEALTH)


def failed_checks(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed"))


def health_summary(results: DataFrame) -> DataFrame:
    """Totals of a health-check table; healthy when nothing critical failed."""
    failed = ~F.col("passed")
    critical = F.count_if(failed & (F.col("severity") == "CRITICAL"))
    return results.agg(
        F.count("*").alias("total_checks"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(failed).alias("failed"),
        critical.alias("critical_failures"),
        F.count_if(failed & (F.col("severity") == "WARNING")).alias("warnings"),
        (F.count_if(failed) == 0).alias("all_passed"),
        (critical == 0).alias("healthy"),
    )
