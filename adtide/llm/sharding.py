"""Shards with the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtide.llm.staging import settle

SHARDS = 8
SEED = 20240601
#: Cells that split the ranking of one stratum, and the one of all rows: a window holds about 1/CELLS of them.
CELLS = 4096


def _offsets(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Rows before each cell, and rows in all, per ``by``: a window over at most ``CELLS`` counts."""
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = over.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by, cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(over).alias("total")
    )


def shard(
    rows: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "source", shards: int = SHARDS, seed: int = SEED,
    cells: int = CELLS,
) -> DataFrame:
    """Give each row a ``shard`` from 0 to ``shards - 1`` and a gapless ``slot`` in it.

    Rows of a stratum are ranked in a seeded random order.  Their fractional
    rank ``(rank - 1 + start) / rows of the stratum`` spreads them evenly over
    0 to 1 (``start`` is a seeded number of the stratum, so that strata of one
    row do not meet at one place).  Cutting the order of all fractional ranks
    into equal runs gives shards that hold each stratum in proportion, give or
    take one row, and whose row counts are at most one apart.

    Both rankings are counted per cell of the hash or of the fractional rank;
    the row number inside a cell is added to the rows before it.  So a stratum
    with a third of all rows is spread over ``cells`` windows, and the text
    never leaves the scan.

    A null stratum is a stratum of its own; a null text has 0 bytes (size 1,
    crc 0); a null key is hashed as null; repeated rows are placed one by one;
    an empty table gives no rows.  Other columns of ``rows`` are ignored.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    base = rows.select(
        F.col(key).alias("k"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("st"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("crc"),
        h.alias("h"),
    ).withColumn("cell", F.pmod(F.shiftrightunsigned("h", 20), F.lit(cells)).cast("int"))
    order = ["cell", "h", "k", "crc", "size"]
    counts = base.groupBy("st", "cell").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("st", "cell").orderBy(*order[1:])) + F.col("before")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "st"), F.lit(1 << 20)) / (1 << 20)
    ranked = settle(
        base.join(_offsets(counts, ["st"], "cell").hint("merge"), ["st", "cell"])
        .withColumn("f", (rank - 1 + start) / F.col("total"))
        .select("k", "size", "crc", "h", "f", F.least(F.floor(F.col("f") * cells), F.lit(cells - 1)).cast("int").alias("place")),
        "ranks",
    )
    counts = ranked.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    inside = F.row_number().over(Window.partitionBy("place").orderBy("f", *order[1:]))
    placed = ranked.join(_offsets(counts, [], "place").hint("merge"), "place").withColumn("pos", inside - 1 + F.col("before"))
    cut = F.expr(f"pos * {shards} div total")
    return placed.withColumn("shard", cut.cast("int")).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("pos") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )
