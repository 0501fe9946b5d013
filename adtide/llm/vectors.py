"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtide.llm.components import components
from adtide.llm.staging import settle, ship

COSINE = 0.9
#: Reference points: about the root of the number of vectors, between these bounds; each has an inverted list.
PIVOTS = (64, 8192)
#: Length of the permutation a vector is described by, and pivots two vectors must share to be compared.
NEAREST = 8
SHARED = 2
#: Vectors on one side of a block of comparisons.
BLOCK = 1024
#: Pivots nearer to each other than this are thinned out, so that a dense group does not take many of them.
APART = 0.7


def _pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Reference points per dimension: a bounded sample (four times ``count`` of all vectors, by hash), thinned."""
    rows = vectors.orderBy(F.xxhash64("x", F.lit(7)), "cid").select("x").limit(4 * count).toLocalIterator()
    by: dict[int, list[np.ndarray]] = {}
    for row in rows:
        v = np.array(row.x)
        own = by.setdefault(len(v), [])
        if len(own) < count and (not own or (np.array(own) @ v).max() < APART):
            own.append(v)
    return {d: np.array(v) for d, v in by.items()}


def _spanning(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest node each of ``size`` nodes reaches over links (a, b)."""
    label = np.arange(size)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Equal vectors form a class with a count.  Each class is described by its
    ``NEAREST`` nearest pivots in order, and entered in the inverted lists of
    these.  Lists are compared in blocks: two vectors that share at least
    ``SHARED`` pivots are verified by their cosine in double precision.  A pair
    that meets in several lists counts in that of its lowest shared pivot.  A
    task gives, per vector, the number of its links and one link to the smallest
    vector it reaches in the block, so a group of near copies gives no table of
    pairs.  Pairs are only missed when they share fewer pivots, which at this
    cosine is rare (the tests measure the recall); none is wrong.

    Vectors that are null or zero, or hold null or non-finite numbers, link with
    nothing; so do vectors of different lengths.  Rows with equal keys count as
    one vector with several values.  A null key takes no part.  An empty table
    gives no rows; other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = "forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))"
    top = "array_max(transform(v, e -> abs(e)))"  # scaled first, so that squares neither overflow nor vanish
    good = rows.filter(F.expr(f"id is not null and size(v) > 0 and {finite} and exists(v, e -> e <> 0)"))
    unit = F.expr("aggregate(array(sqrt(aggregate(y, 0D, (s, f) -> s + f * f))), cast(array() as array<double>), (z, r) -> transform(y, e -> e / r))")
    classes = good.groupBy("v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = classes.withColumn("t", F.expr(top)).withColumn("y", F.expr("transform(v, e -> e / t)")).withColumn("x", unit).select("cid", "copies", "v", "x")
    classes = settle(classes, "vectors")
    number = classes.count()
    pivots = _pivots(classes, int(min(max(number**0.5, PIVOTS[0]), PIVOTS[1])))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS[1] vectors of a dimension

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["x"].map(len)
            for d, group in batch.groupby(size):
                points = shared.value[d] if d in shared.value else np.ones((1, d))
                near = np.stack(group["x"].to_list()) @ points.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
                yield group.assign(perm=list(order.astype(np.int32)), dim=d)[["cid", "copies", "x", "perm", "dim"]]

    described = settle(classes.mapInPandas(describe, "cid long, copies long, x array<double>, perm array<int>, dim int"), "permutations")
    lists = described.withColumn("p", F.explode("perm"))
    blocks = settle(lists.groupBy("dim", "p").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("blocks", F.expr(f"cast(ceil(m / {BLOCK}) as int)")), "list-sizes")
    lists = lists.join(blocks, ["dim", "p"]).withColumn("own", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    # block pair (i, j), i <= j: a row goes to each pair its block is in
    dealt = lists.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid", kind="stable")
        i, j, p = (int(group[c].iloc[0]) for c in ("i", "j", "p"))
        x, perm = np.stack(group["x"].to_list()), np.stack(group["perm"].to_list())
        own, copies, cid = group["own"].to_numpy(), group["copies"].to_numpy(), group["cid"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        a, b = left[a], right[b]
        keep = (a < b) if i == j else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        links, ends = np.zeros(len(group), np.int64), [np.zeros(0, np.int64)] * 2
        for at in range(0, len(a), 200_000):
            s, t = a[at : at + 200_000], b[at : at + 200_000]
            both = (perm[s][:, :, None] == perm[t][:, None, :]).any(2)
            lowest = np.where(both, perm[s], np.iinfo(np.int32).max).min(1)
            sure = (both.sum(1) >= min(SHARED, perm.shape[1])) & (lowest == p)
            s, t = s[sure], t[sure]
            np.add.at(links, s, copies[t])
            np.add.at(links, t, copies[s])
            ends = [np.concatenate((ends[0], s)), np.concatenate((ends[1], t))]
        low = cid[_spanning(*ends, len(group))]
        out = pd.DataFrame({"cid": cid, "links": links, "low": low})
        return out[out["links"] > 0]

    met = settle(dealt.groupBy("dim", "p", "i", "j").applyInPandas(compare, "cid long, links long, low long"), "met")
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    ends = components(met.select(F.col("cid").alias("a"), F.col("low").alias("b")))
    named = classes.select("v", "cid", "copies").join(settle(links, "link-counts"), "cid", "left").join(ends.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "cid").alias("comp"))
    out = good.join(settle(named, "vector-classes"), "v").select("id", "n_links", "comp")
    alone = rows.filter(~F.coalesce(F.expr(f"id is not null and size(v) > 0 and {finite} and exists(v, e -> e <> 0)"), F.lit(False)))
    every = out.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("comp")))
    return every.select(F.col("id").alias(key), "n_links", F.col("comp").alias("component_id"), F.col("comp").eqNullSafe(F.col("id")).alias("kept"))
