"""Column contracts: the rules of a JSON-style contract as one array expression.

The contract is walked once on the driver, guided by the table's schema, and
becomes an expression that yields the violations of a row.  Rows without a
violation produce nothing; no UDF is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VIOLATION = "array<struct<path:string,rule:string,message:string>>"


def _when(broken: Column, path: Column, rule: str, message: Column) -> Column:
    """Violation struct where ``broken`` holds, else NULL."""
    return F.when(broken, F.struct(path.alias("path"), F.lit(rule).alias("rule"), message.alias("message")))


def _list(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items)).cast(_VIOLATION) if items else F.array().cast(_VIOLATION)


def _kind_matches(kind: str | None, actual: T.DataType) -> bool:
    accepted = {
        "object": (T.StructType, T.MapType),
        "array": (T.ArrayType,),
        "string": (T.StringType,),
        "number": (T.NumericType,),
        "integer": (T.IntegralType,),
        "boolean": (T.BooleanType,),
    }
    return kind not in accepted or isinstance(actual, accepted[kind])


def _limits(value: Column, kind: str, rules: dict, path: Column) -> list[Column]:
    out = []
    if kind == "string":
        size, bounds = F.length(value), (("minLength", "too short"), ("maxLength", "too long"))
    elif kind == "array":
        size, bounds = F.size(value), (("minItems", "too few items"), ("maxItems", "too many items"))
    else:
        size, bounds = value, (("minimum", "too small"), ("maximum", "too large"))
    for rule, text in bounds:
        limit = rules.get(rule)
        if limit is not None:
            broken = size < limit if rule.startswith("min") else size > limit
            out.append(_when(broken, path, rule, F.format_string(f"{text} (limit {limit}, got %s)", size.cast("string"))))
    allowed = rules.get("enum")
    if kind == "string" and allowed:
        out.append(_when(~value.isin(*allowed), path, "enum", F.concat(F.lit("not an allowed value: "), value)))
    return out


def _violations(value: Column, dtype: T.DataType, rules: dict, path: Column) -> Column:
    """Violations of a value that is present; NULL values are dealt with by the
    ``required`` rule of their parent."""
    kind = rules.get("type")
    if not _kind_matches(kind, dtype):
        message = F.lit(f"expected {kind}, got {dtype.simpleString()}")
        return _list([_when(value.isNotNull(), path, "type", message)])
    if kind == "object" and isinstance(dtype, T.StructType):
        fields = {f.name: f.dataType for f in dtype.fields}
        return _object(lambda n: value[n], fields, rules, path, value.isNotNull())
    if kind == "array":
        own = _list(_limits(value, kind, rules, path))
        items = rules.get("items")
        if not items:
            return own
        nested = F.flatten(
            F.transform(
                value,
                lambda x, i: F.coalesce(
                    _violations(x, dtype.elementType, items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
                    F.array().cast(_VIOLATION),
                ),
            )
        )
        return F.concat(own, F.coalesce(nested, F.array().cast(_VIOLATION)))
    if kind in ("string", "number", "integer"):
        return _list(_limits(value, kind, rules, path))
    return _list([])


def _object(get, fields: dict[str, T.DataType], rules: dict, path: Column, present: Column) -> Column:
    parts = []
    for name in rules.get("required", []):
        absent = get(name).isNull() if name in fields else F.lit(True)
        parts.append(_when(present & absent, F.concat(path, F.lit(f".{name}")), "required", F.lit("required field missing")))
    found = [_list(parts)]
    for name, sub in rules.get("properties", {}).items():
        if name in fields:
            inner = _violations(get(name), fields[name], sub, F.concat(path, F.lit(f".{name}")))
            found.append(F.coalesce(inner, F.array().cast(_VIOLATION)))
    return F.concat(*found) if len(found) > 1 else found[0]


def contract_violations(df: DataFrame, contract: dict, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per broken rule: ``keys`` + (path, rule, message).

    ``contract`` describes a row (type object) or a list of rows (type array
    with object items).  Understood are type, required, properties, items,
    minItems/maxItems, minLength/maxLength, enum and minimum/maximum; other
    keywords have no effect.  A NULL counts as an absent field.
    """
    rules = contract.get("items", {}) if contract.get("type") == "array" else contract
    fields = {f.name: f.dataType for f in df.schema.fields}
    found = _object(lambda n: F.col(f"`{n}`"), fields, rules, F.lit(name), F.lit(True))
    return df.select(*keys, F.inline(found))


def contract_size_violations(df: DataFrame, contract: dict, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Batches of rows that break minItems/maxItems of an array contract."""
    size = df.groupBy(*by).agg(F.count("*").alias("n"))
    found = []
    for rule, text in (("minItems", "too few items"), ("maxItems", "too many items")):
        limit = contract.get(rule)
        if limit is not None:
            broken = F.col("n") < limit if rule == "minItems" else F.col("n") > limit
            found.append(_when(broken, F.lit(name), rule, F.format_string(f"{text} (limit {limit}, got %d)", F.col("n"))))
    return size.select(*by, F.inline(_list(found)))


def evidence_rule(insights: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Confidence above 0.8 needs at least three evidence items."""
    n = F.coalesce(F.size("evidence"), F.lit(0))
    return insights.where((F.col("confidence") > 0.8) & (n < 3)).select(
        *keys, F.lit("confidence_evidence_correlation").alias("rule"), F.col("confidence"), n.alias("evidence_count")
    )


def evaluation_rules(reports: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rules over evaluation reports: passing needs a quality of 0.7; the stated
    count equals the number of validated insights (``validated_insights`` as
    array or its size as ``validated_size``)."""
    quality = F.coalesce(F.col("overall_quality"), F.lit(0.0))
    broken = [F.when(F.col("pass_threshold") & (quality < 0.7), F.lit("quality_threshold_validation"))]
    size = None
    if "validated_insights" in reports.columns:
        size = F.coalesce(F.size("validated_insights"), F.lit(0))
    elif "validated_size" in reports.columns:
        size = F.col("validated_size")
    if size is not None:
        stated = F.coalesce(F.col("validated_count"), F.lit(0))
        broken.append(F.when(stated != size, F.lit("validated_count_consistency")))
    return reports.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


# Contract of an insight list (fixed values).
INSIGHTS_CONTRACT = {
    "type": "array",
    "minItems": 1,
    "maxItems": 10,
    "items": {
        "type": "object",
        "required": ["id", "hypothesis", "confidence", "evidence", "reasoning", "recommendation"],
        "properties": {
            "id": {"type": "string"},
            "hypothesis": {"type": "string", "minLength": 10, "maxLength": 300},
            "confidence": {"type": "number", "minimum": 0.0, "maximum": 1.0},
            "category": {
                "type": "string",
                "enum": ["performance", "creative_fatigue", "audience", "timing", "budget", "targeting"],
            },
            "evidence": {"type": "array", "minItems": 2, "items": {"type": "string", "minLength": 10}},
            "reasoning": {"type": "string", "minLength": 20, "maxLength": 500},
            "recommendation": {"type": "string", "minLength": 10, "maxLength": 300},
        },
    },
}
