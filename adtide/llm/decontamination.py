"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.llm.spans import bound
from adtide.llm.staging import leave_out, settle

WORDS = 5
CONTAINMENT = 0.8
#: Hash functions of an item's signature, by size class (up to so many shingles: so many functions).
SIZE_CLASSES = ((16, 8), (64, 12), (1 << 62, 16))
#: Signature values that are sent to all tasks at once; a larger benchmark is searched in several blocks.
BLOCK_ROWS = 500_000
#: Keys of candidate documents and of their items that may be sent to all tasks; more are joined by shuffle.
BROADCAST_KEYS = 500_000


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: str, n: int, hashed: bool) -> Column:
    """Shingles of ``n`` words, repeated ones included; none for shorter texts."""
    parts = ", ".join(f"element_at(ws, i + {j})" for j in range(n))
    one = f"xxhash64({parts})" if hashed else f"concat_ws(' ', {parts})"
    body = f"if(size(ws) >= {n}, transform(sequence(1, greatest(size(ws) - {n - 1}, 1)), i -> {one}), array())"
    return F.expr(bound(words, "ws", body, "array<bigint>" if hashed else "array<string>"))


def signatures(items: DataFrame, key: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(item, width, size, grams, sig)``: distinct shingles of each item and its MinHash signature.

    ``width`` is the shingle length: ``words``, or the number of words of a
    shorter item, whose whole sequence is its only shingle.  The item is put in
    a size class; the signature holds, for each hash function of the class, the
    shingle with the least value (as the hash that documents are probed with).
    Items of no more shingles than functions keep all of them.  Items without
    words, or with a null text, are left out; repeated rows count once.
    """
    w = items.select(F.col(key).alias("item"), _words(F.coalesce(F.col(text), F.lit(""))).alias("w")).filter("size(w) > 0").distinct()
    w = w.withColumn("width", F.least(F.size("w"), F.lit(words)))
    def grams(n: int) -> str:
        parts = ", ".join(f"element_at(w, i + {j})" for j in range(n))
        return f"transform(sequence(1, size(w) - {n - 1}), i -> named_struct('h', xxhash64({parts}), 'g', concat_ws(' ', {parts})))"

    by_width = F.expr("case " + " ".join(f"when width = {n} then {grams(n)}" for n in range(1, words + 1)) + " end")
    sets = w.select("item", "width", F.array_distinct(by_width).alias("grams")).withColumn("size", F.size("grams"))

    def smallest(n: int) -> str:
        return f"array_distinct(transform(sequence(1, {n}), f -> array_min(transform(grams, g -> named_struct('v', xxhash64(f, g.h), 'h', g.h))).h))"
    cases = " ".join(f"when size <= {most} then if(size <= {n}, grams.h, {smallest(n)})" for most, n in SIZE_CLASSES)
    return sets.withColumn("sig", F.expr(f"case {cases} end"))


def _blocks(table: DataFrame, rows: int) -> list[DataFrame]:
    """``table`` in parts of about ``rows`` rows, by the hash of the item; each is a bounded broadcast."""
    parts = -(-table.count() // rows) or 1
    return [table if parts == 1 else table.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == i) for i in range(parts)]


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    words: int = WORDS, containment: float = CONTAINMENT, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` of every pair in which the document holds
    at least ``containment`` of the item's distinct word shingles.

    Search: an item's MinHash values each fall on one of its shingles, and the
    chance that a document holds that shingle is the containment itself, however
    long the document is.  So documents are probed with their whole set of
    shingle hashes against the items' signatures; one hit makes a candidate (a
    pair at 0.8 is missed with a chance of 0.2^8 in the smallest class that is
    sampled, and items of up to that many shingles are never missed).  A
    document of a size below ``containment`` times that of the item is pruned.
    Documents go through no shuffle: the signatures are broadcast in blocks of
    a fixed size.  Verification: the shingles themselves, as text, of candidate
    documents only, counted per pair.

    Words are lower-case runs of letters and digits.  An item of fewer than
    ``words`` words is one shingle of its own length, searched among the
    documents' shingles of that length.  Null or empty texts hold nothing and
    are held by nothing.  Rows with equal key and equal text count once; of rows with
    equal key and different texts, documents or items, each is held against the others by itself and the pair
    of keys has the numbers of the pair of texts with the highest containment (then most shared shingles); a null
    key is kept as null.  Empty tables give no rows; other columns are ignored.
    """
    table = settle(signatures(items, item_key, item_text, words), "items")
    probes = settle(table.select("item", "width", "size", F.explode("sig").alias("h")), "signatures")
    widths = sorted(r.width for r in probes.select("width").distinct().collect())  # at most ``words`` numbers
    if not widths:
        return _empty(docs, items, key, item_key)
    body = docs.select(F.col(key).alias("doc"), F.col(text).alias("txt")).filter("txt is not null")

    def grams(rows: DataFrame, width: int, hashed: bool) -> DataFrame:
        return rows.withColumn("w", _words(F.col("txt"))).withColumn("s", _shingles("w", width, hashed)).drop("w")

    hits = []
    for width in widths:
        spread = grams(body.withColumn("id", F.xxhash64("txt")), width, True).select("doc", "id", F.size("s").alias("n"), F.explode_outer("s").alias("h"))
        for part in _blocks(probes.filter(F.col("width") == width), block_rows):
            found = spread.join(F.broadcast(part.select("item", "size", "h")), "h").filter(F.col("n") >= containment * F.col("size"))
            hits.append(found.select("doc", "id", "item").distinct())
    pairs = hits[0]
    for more in hits[1:]:
        pairs = pairs.union(more)
    pairs = settle(pairs.groupBy("doc", "id").agg(F.collect_set("item").alias("items")), "candidates")
    keys = pairs.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    wanted = F.broadcast(pairs) if keys <= BROADCAST_KEYS else pairs
    near = body.withColumn("id2", F.xxhash64("txt")).join(
        wanted.select(F.col("doc").alias("doc2"), "id", "items"), F.expr("doc <=> doc2 and id2 = id")).drop("doc2", "id2")
    shared = []
    for width in widths:
        full = table.filter(F.col("width") == width).select("item", "size", F.explode("grams.g").alias("g"))
        spread = grams(near, width, False).select("doc", "id", "items", F.explode_outer("s").alias("g"))
        for part in _blocks(full, block_rows):
            both = spread.join(F.broadcast(part), "g").filter("array_contains(items, item)")
            shared.append(both.groupBy("doc", "id", "item", "size").agg(F.countDistinct("g").alias("n_shared")))
    out = shared[0]
    for more in shared[1:]:
        out = out.union(more)
    share = F.col("n_shared") / F.col("size")
    return out.filter(F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("size") - 1e-9)).groupBy("doc", "item").agg(
        F.max(F.struct(share.alias("containment"), "n_shared", F.col("size").cast("long").alias("n_item"))).alias("best")
    ).select(F.col("doc").alias(key), F.col("item").alias(item_key), "best.n_item", "best.n_shared", "best.containment")


def _empty(docs: DataFrame, items: DataFrame, key: str, item_key: str) -> DataFrame:
    none = docs.select(key).limit(0).crossJoin(items.select(item_key).limit(0))
    return none.withColumns({"n_item": F.lit(0).cast("long"), "n_shared": F.lit(0).cast("long"), "containment": F.lit(0.0)})


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` names; rows with a null key stay."""
    return leave_out(docs, contaminated(docs, items, key, **more), key)
