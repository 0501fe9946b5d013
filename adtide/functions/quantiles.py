"""Exact interpolated percentiles without gathering a group in one task.

Spark's ``percentile`` keeps a value -> count map of the whole group in one
reducer, which cannot hold a column of distinct doubles at cluster scale.  Here
the wanted order statistics are selected digit by digit: the bits of a double,
read as a whole number, keep the order of the values, so a pass that counts the
values per leading digit finds the digit of each wanted rank, and the next pass
counts only the values that share it.

Three passes of about 21 bits make up a double.  A pass has at most ``CELLS`` cells
per group and digit, whatever the data, and running counts are taken over
``CELLS`` / 2048 groups of cells first and then inside of the groups that hold a
wanted rank, so no window has more than 2048 rows.  Equal values are counted,
never listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.plans.staging import settle

#: Bits of a digit after the first one, which takes the rest: 22 with the sign.
_BITS = 21
#: Most cells per group and digit in a pass.
CELLS = 1 << (64 - 2 * _BITS)
#: Cells that have one running count.
_TOGETHER = 11
#: Cells with a wanted rank that are sent to all tasks from the driver, and from a table; more are joined by shuffle.
COLLECTED_CELLS = 1_000
BROADCAST_CELLS = 200_000

_LEAST_NORMAL = "2.2250738585072014E-308D"


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``key``, the bits of the double column ``value`` as a whole number that sorts as the values do.

    The exponent is the logarithm, put right by one where rounding needs it; what is left of
    the value over that power of two is exact.  Minus zero is zero; infinities are at the ends.
    """
    size = f"abs({value})"
    near = f"cast(greatest(-1022, least(1023, coalesce(floor(log2({size})), 0L))) as int)"
    exponent = f"(_near - if({size} < pow(2D, _near), 1, 0) + if({size} / 2 >= pow(2D, _near), 1, 0))"
    normal = f"shiftleft(cast(_exp + 1023 as bigint), 52) + cast(({size} / pow(2D, _exp) - 1) * 4503599627370496D as bigint)"
    bits = (
        f"case when {size} = double('infinity') then shiftleft(2047L, 52) "
        f"when {size} < {_LEAST_NORMAL} then cast({size} / 4.9E-324D as bigint) else {normal} end"
    )
    steps = df.withColumn("_near", F.expr(near)).withColumn("_exp", F.expr(exponent)).withColumn("_bits", F.expr(bits))
    # as the result of a generator the key is worked out once, however often it is used
    return steps.select(*df.columns, F.expr(f"stack(1, if({value} < 0, -_bits, _bits)) as ({key})"))


def _digit(level: int) -> Column:
    """Digit number ``level`` (0 to 2) of the key; only the first has a sign."""
    digit = F.shiftright("_key", _BITS * (2 - level))
    return digit if level == 0 else digit.bitwiseAND(F.lit((1 << _BITS) - 1))


def count_cells(rows: DataFrame, value: str, by: Sequence[str], extra: Sequence[Column] = (), weight: str = "1") -> DataFrame:
    """The first pass: ``by`` + ``_cell`` + ``_n`` (NULL and NaN have the cell NULL) with ``extra``
    aggregates per cell, kept as a table so that the rows are read once."""
    clean = rows.withColumn("_v", F.expr(f"cast({value} as double)")).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    cells = with_order_key(clean, "_v", "_key").groupBy(*by, _digit(0).alias("_cell"))
    return settle(cells.agg(F.sum(F.expr(f"cast({weight} as bigint)")).alias("_n"), *extra))


def _running(cells: DataFrame, group: list[str], cell: str, carried: Sequence[str]) -> DataFrame:
    """The rows of ``cells`` that hold one of their ``_ranks``; ``_base`` is the rank of a cell's first value."""
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(cell)) + F.col("_base")
    held = cells.withColumn("_end", upto).withColumn("_held", F.expr("filter(_ranks, r -> r >= _end - _n and r < _end)"))
    return held.where("size(_held) > 0").selectExpr(*group, cell, *carried, "_end - _n AS _base", "_held AS _ranks")


def _holding(cells: DataFrame, group: list[str], wanted: DataFrame | None, ranks: str = "") -> DataFrame:
    """The cells (``group``, ``_cell``, ``_n`` and values) that hold a rank wanted in their group
    (``_total``, ``_base``, ``_ranks``); without ``wanted``, one of ``ranks`` of a group's total."""
    cells = cells.withColumn("_many", F.shiftright("_cell", _TOGETHER))
    many = cells.groupBy(*group, "_many").agg(F.sum("_n").alias("_n"))
    if wanted is None:
        many = many.withColumn("_total", F.sum("_n").over(Window.partitionBy(*group))).selectExpr("*", "0L AS _base", f"{ranks} AS _ranks")
    else:
        many = many.join(wanted, group)
    inside = _running(many, group, "_many", ["_total"])
    near = cells.join(inside, [*group, "_many"])
    return _running(near, [*group, "_many"], "_cell", [c for c in near.columns if c in ("_total", "_v")]).drop("_many")


def _sent(hits: DataFrame) -> DataFrame:
    """Few rows as a table that goes to all tasks; many as a table that is joined by shuffle."""
    rows = hits.limit(COLLECTED_CELLS + 1).collect()
    if len(rows) <= COLLECTED_CELLS:
        return F.broadcast(hits.sparkSession.createDataFrame(rows, hits.schema))
    hits = settle(hits)
    return F.broadcast(hits) if hits.count() <= BROADCAST_CELLS else hits


def select_ranks(rows: DataFrame, cells: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], weight: str = "1") -> DataFrame:
    """Percentiles of ``rows`` whose first pass gave ``cells``: ``by`` + ``n`` + ``q0, q1, ...``.

    Two more passes over ``rows`` count the values that share a digit with a wanted rank."""
    by, probs = list(by), [float(p) for p in probs]
    last = "(_total - 1)"
    ranks = ", ".join(f"cast({f}({last} * {p}D) as bigint)" for p in probs for f in ("floor", "ceil"))
    cells = cells.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, "_cell"))).select(*by, "_cell", "_n")
    group = by
    hits = _holding(cells, group, None, f"array_distinct(array({ranks}))")
    base = rows.selectExpr(*by, f"cast({weight} as bigint) AS _w", f"cast({value} as double) AS _v").where("not isnan(_v)")
    base = with_order_key(base, "_v", "_key").withColumns({f"_digit{level}": _digit(level) for level in (0, 1, 2)})
    for level in (1, 2):
        group = [*group, f"_digit{level - 1}"]
        wanted = _sent(hits.withColumnRenamed("_cell", f"_digit{level - 1}"))
        found = base.join(wanted.select(*group), group).groupBy(*group, F.col(f"_digit{level}").alias("_cell"))
        # with its last digit a cell is one value
        cells = settle(found.agg(F.sum("_w").alias("_n"), *([F.max("_v").alias("_v")] if level == 2 else [])))
        hits = _holding(cells, group, wanted)
    at = hits.selectExpr(*by, "_total", "_v", "explode(_ranks) AS _rank")
    ends = []
    for i, p in enumerate(probs):
        ends.append(F.expr(f"max(_v) FILTER (WHERE _rank = floor({last} * {p}D)) AS lo{i}"))
        ends.append(F.expr(f"max(_v) FILTER (WHERE _rank = ceil({last} * {p}D)) AS hi{i}"))
    between = [
        f"CASE WHEN lo{i} = hi{i} THEN lo{i} ELSE lo{i} + (hi{i} - lo{i}) * ({last} * {p}D - floor({last} * {p}D)) END AS q{i}"
        for i, p in enumerate(probs)
    ]
    return at.groupBy(*by, "_total").agg(*ends).selectExpr(*by, "_total AS n", *between)


def percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], approx: bool = False, accuracy: int = 10000, few_groups: bool = False
) -> DataFrame:
    """Interpolated percentiles of ``value`` for every ``by`` group; groups with a NULL key are left out.

    Returns ``by`` + ``n`` (values counted) + ``q0, q1, ...`` in the order of
    ``probs``.  NULL and NaN values are left out.  ``few_groups=True`` is for a
    few groups over a large table (such as one per metric): the table is read
    three times and only cell counts are shuffled.  Otherwise the table is read
    once and reduced to the number of rows per group and value, which are spread
    over tasks by both; no pass after that, and no join, sees the table itself.
    ``approx=True`` uses ``percentile_approx`` in one pass.
    """
    by, probs = list(by), [float(p) for p in probs]
    if approx:
        base = df.selectExpr(*by, f"cast({value} as double) as _v").where("_v IS NOT NULL AND NOT isnan(_v)")
        sketch = base.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", probs, accuracy).alias("_q"))
        return sketch.selectExpr(*by, "n", *[f"_q[{i}] AS q{i}" for i in range(len(probs))])
    if few_groups:
        return select_ranks(df, count_cells(df.where(f"{value} IS NOT NULL"), value, by), value, probs, by)
    reduced = df.selectExpr(*by, f"cast({value} as double) as _value").where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, "_value")))
    reduced = settle(reduced.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_times")))
    return select_ranks(reduced, count_cells(reduced, "_value", by, weight="_times"), "_value", probs, by, "_times")
