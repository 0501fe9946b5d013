"""Near-duplicate documents: bottom-k sketches from one hash function, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtide.llm.components import components
from adtide.llm.staging import BROADCAST_KEYS, leave_out, let_go, settle, ship

WORDS = 4
#: Links have 100 * shared >= PERCENT * union.
PERCENT = 80
#: Values kept in a sketch; of those that are not hot, the smallest INDEXED enter the inverted lists.
SKETCH = 32
INDEXED = 16
#: A value kept by more sketches than this is hot: its list is not paired but led.
HOT = 50
LEADERS = 2
#: Estimate from the union sketch below which a pair is not verified (0.8 is 5 standard deviations above).
LEAST_ESTIMATE = 0.4
#: Documents of one side of a block in the exact comparison of hot lists.
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd 64-bit numbers do
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, seen: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text its whole sequence as one.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    # bytes.lower and bytes.split know ASCII letters and ASCII white space only
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.int64)
    h = np.array([seen[w] for w in found], np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _ODD + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(out).view(np.int64))


def _arrays(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def sketches(docs: DataFrame, key: str, text: str, words: int = WORDS, size: int = SKETCH) -> DataFrame:
    """``(doc, n, f1, f2, sketch)``: size of each document's set, a 128-bit fingerprint of it, its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = _Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, f1, f2, low = [], [], [], []
                for t in batch.column(1).to_pylist():
                    own = shingle_hashes(t, seen, words)
                    bits = own.view(np.uint64)
                    sizes.append(len(own))
                    f1.append(_mix(bits).sum(dtype=np.uint64))
                    f2.append(_mix(bits ^ _ODD).sum(dtype=np.uint64))
                    low.append(own[:size].copy())  # not a view, which would keep the whole set
                sums = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), *sums, _arrays(low)], names=["doc", "n", "f1", "f2", "sketch"]
                )

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("txt")).mapInArrow(run, "doc long, n long, f1 long, f2 long, sketch array<long>")


def _full_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, words: int) -> DataFrame:
    """``(id, hashes)`` of the documents in ``ids`` (settled, distinct), whole texts."""
    if ids.count() <= BROADCAST_KEYS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("txt")).join(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = _Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_hashes(t, seen, words) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(sets)], names=["id", "hashes"])

    return rows.mapInArrow(run, "id long, hashes array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose union sketch, the smallest values of both sketches, leaves a link possible."""
    own = classes.select("cid", "n", "sketch")
    both = pairs.join(own.withColumnsRenamed({"cid": "a", "n": "na", "sketch": "sa"}), "a").join(own.withColumnsRenamed({"cid": "b", "n": "nb", "sketch": "sb"}), "b")
    both = both.filter(F.expr(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"))
    union = F.expr("slice(array_sort(array_union(sa, sb)), 1, least(greatest(size(sa), size(sb)), size(array_union(sa, sb))))")
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.filter(shared >= LEAST_ESTIMATE * F.size(union)).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Pairs that are links by their full sets."""
    pairs = settle(pairs, "pairs")
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = settle(_full_sets(docs, key, text, ids, words), "sets")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"id": "b", "hashes": "hb"}), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("both"), (F.size("ha") + F.size("hb")).alias("sum"))
    return settle(both.filter(F.expr(f"100 * both >= {PERCENT} * (sum - both)")).select("a", "b").distinct(), "verified")


def _rare_lists(sets: DataFrame) -> DataFrame:
    """``(v, cid, comp)``: lists of the rarest shingles of each set, as many as two linked sets must share one of.

    ``sets`` has ``cid, comp, hashes``.  All sets put their shingles in the same
    order, rare ones first.  A link shares ``PERCENT`` of the larger set at
    least, so it has a shingle among the first n - ceil(PERCENT * n / 100) + 1
    of either set.  What a passage adds to many texts stands at the end and is
    in no list, unless it is most of a text.

    Counts above ``total / BROADCAST_KEYS`` belong to fewer than
    ``BROADCAST_KEYS`` shingles and are sent to all tasks; the others are joined
    by shuffle, where no key has more rows than that.
    """
    every = sets.select("cid", "comp", F.size("hashes").alias("n"), F.explode("hashes").alias("v"))
    counts = settle(every.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shingle-counts")
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    most = max(HOT, total // BROADCAST_KEYS)
    common, other = F.broadcast(counts.filter(F.col("df") > most)), counts.filter(F.col("df") <= most)
    marked = every.join(common, "v").unionByName(every.join(common, "v", "left_anti").join(other, "v", "left"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy(F.coalesce("df", F.lit(1)), "v"))
    return marked.withColumn("at", place).filter(F.expr(f"at <= n - ceil({PERCENT} * n / 100) + 1 and df > 1")).select("v", "cid", "comp")


def _hot_links(hot: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Links inside hot lists between members in different components.

    ``hot`` has ``v, cid, comp``.  The members of lists with several components
    meet again in lists of their rarest shingles.  Of each such list the members
    outside of its largest component are compared with all its members, on full
    sets and in blocks, so that a task holds two blocks whatever the length of
    the list.  A task gives one link per document and component, not all pairs.
    """
    several = hot.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("v")
    members = settle(hot.join(several, "v").select("cid", "comp").distinct(), "hot-members")
    sets = settle(_full_sets(docs, key, text, members.select(F.col("cid").alias("id")), words).dropDuplicates(["id"]).withColumnRenamed("id", "cid"), "sets")
    lists = settle(_rare_lists(sets.join(members, "cid")), "rare-lists")
    comps = lists.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = settle(comps.groupBy("v").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most")).filter("all > most"), "hot-main")
    lists = lists.join(main, "v").withColumns({"m_blocks": F.expr(f"cast(ceil(all / {BLOCK}) as int)"), "r_blocks": F.expr(f"cast(ceil((all - most) / {BLOCK}) as int)")})
    lists = settle(lists, "hot-lists").join(sets, "cid")
    own = "cast(pmod(xxhash64(cid), {0}) as int)".format
    one = lists.select("v", "cid", "comp", "hashes", F.lit(False).alias("rest"), F.expr(own("m_blocks")).alias("mb"), F.explode(F.expr("sequence(0, r_blocks - 1)")).alias("rb"))
    two = lists.filter("comp <> main").select("v", "cid", "comp", "hashes", F.lit(True).alias("rest"), F.explode(F.expr("sequence(0, m_blocks - 1)")).alias("mb"), F.expr(own("r_blocks")).alias("rb"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        members, rest = group[~group["rest"]], group[group["rest"]]
        out: list[tuple[int, int]] = []
        if len(members) and len(rest):
            sizes = np.array([len(h) for h in members["hashes"]])
            every, code = np.unique(np.concatenate(members["hashes"].to_list()), return_inverse=True)
            owner = np.repeat(np.arange(len(members)), sizes)
            cids, comps = members["cid"].to_numpy(), members["comp"].to_numpy()
            for cid, comp, hashes in zip(rest["cid"], rest["comp"], rest["hashes"], strict=True):
                at = np.searchsorted(every, hashes)
                mark = np.zeros(len(every), bool)
                mark[at[(at < len(every)) & (every[np.minimum(at, len(every) - 1)] == hashes)]] = True
                shared = np.bincount(owner[mark[code]], minlength=len(members))
                hit = np.flatnonzero((100 * shared >= PERCENT * (sizes + len(hashes) - shared)) & (comps != comp))
                first = np.unique(comps[hit], return_index=True)[1]
                out += [(int(cid), int(cids[h])) for h in hit[first]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return settle(one.union(two).groupBy("v", "mb", "rb").applyInPandas(run, "a long, b long").distinct(), "hot-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    1. Documents with equal sets form a class (by a 128-bit fingerprint), named
       by its smallest key.  Only classes go on, so copies cost one row each.
    2. A class keeps the ``SKETCH`` smallest hashes of its set.  Each kept value
       has an inverted list.  Values in over ``HOT`` sketches (shared passages,
       large groups of near copies) are hot.
    3. The ``INDEXED`` smallest values that are not hot make pairs, counted by
       shared lists; a union-sketch estimate filters them.  A link is missed
       here with a chance of 0.2^16, or 0.4^16 at half hot values.
    4. A class with half its sketch hot meets its like in hot lists.  Each list
       has a few leaders; members are verified against them.
    5. Exact Jaccard on full sets verifies: first one pair per class and the
       leaders' pairs, then only pairs still in different components.  Members
       of hot lists with several components meet in lists of their rarest
       shingles; of these, all members outside of the largest component are
       compared with all members in blocks.  So every link between different
       sets that could join two components is tested, but pairs inside a
       component are not all listed.
    6. Components are the smallest reachable key.

    Texts are whole.  Null, empty and blank texts have no shingles, link with
    nothing and are kept.  Rows with equal keys count as one document.  A null
    key takes the component of its class (null if it is alone) and is never
    kept, unless alone.  Empty tables give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = settle(sketches(docs, key, text, words), "sketches")
    marks = ["n", "f1", "f2"]
    classes = settle(rows.filter("n > 0").groupBy(*marks).agg(F.min("doc").alias("cid"), F.first("sketch").alias("sketch")), "classes")
    named = classes.filter("cid is not null")
    values = named.select("cid", F.size("sketch").alias("k"), F.posexplode("sketch").alias("pos", "v"))
    counts = settle(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "lists")
    order = Window.partitionBy("cid").orderBy("pos")
    index = (
        values.join(counts, "v").withColumn("hot", F.col("df") > HOT)
        .withColumn("before", F.count_if("hot").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rank", F.when(F.col("hot"), F.col("before")).otherwise(F.col("pos") - F.col("before")))
        .withColumn("heavy", 2 * F.count_if("hot").over(Window.partitionBy("cid")) >= F.col("k"))
    )
    index = settle(index.filter((F.col("rank") < INDEXED) & (~F.col("hot") | F.col("heavy"))).select("cid", "k", "v", "hot"), "index")

    plain = index.filter("not hot").select("cid", "k", "v")
    other = plain.withColumnsRenamed({"cid": "b", "k": "kb"})
    pairs = plain.withColumnRenamed("cid", "a").join(other, "v").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("k", "kb")).alias("k"))
    pairs = pairs.filter(F.col("shared") >= F.when(F.col("k") < INDEXED, 1).otherwise(2))
    pairs = settle(_estimated(pairs.select("a", "b"), named), "candidates")

    hot = index.filter("hot").select("cid", "v")
    lead = F.min(F.struct(F.xxhash64("v", "cid", F.lit(0)), F.col("cid"))), F.min(F.struct(F.xxhash64("cid", F.lit(1)), F.col("cid")))
    leaders = hot.groupBy("v").agg(F.array_distinct(F.array(*[x.getField("cid") for x in lead][:LEADERS])).alias("lead"))
    led = hot.join(settle(leaders, "leaders"), "v").select(F.explode("lead").alias("x"), "cid").filter("x <> cid").select(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b")).distinct()
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(_estimated(led, named)).distinct()
    links = _verified(first, docs, key, text, words)
    found = settle(components(links), "components")

    def comp(rows: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(found.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    left = comp(comp(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    more = _verified(left, docs, key, text, words).union(_hot_links(comp(hot, "cid", "comp"), docs, key, text, words))
    if not more.isEmpty():
        found = settle(components(links.union(more)), "components")
    ends = settle(comp(classes.select(*marks, "cid"), "cid", "comp").select(*marks, "comp"), "class-components")
    return rows.join(ends, marks, "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"),
        F.coalesce("comp", "doc").eqNullSafe(F.col("doc")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component; rows with a null key stay, of rows with equal keys all."""
    return leave_out(docs, near_duplicates(docs, key, text, words).filter("not kept"), key)
