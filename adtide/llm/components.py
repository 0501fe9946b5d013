"""Connected components of a link table, as joins and minima in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtide.llm.staging import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)``: for each node of ``links`` the smallest node it reaches.

    In a round each node names its smallest neighbour.  Names followed onwards
    end in two nodes that name each other, of which the smaller becomes a root;
    names are doubled until all are roots, and links are drawn anew between
    roots.  Every node with a link thus merges with another one: whatever the
    order of the ids, n nodes end after at most log2 n rounds of at most log2 n
    doublings, and no round is cut.  A node with very many links is only a group
    of a partially aggregated minimum; the joins have one row per node on one
    side, which lets adaptive execution split the other.  Each step is written
    to the shared folder.  Null ends and self-links are left out.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    left = settle(pairs.union(pairs.select("v", "u")).distinct(), "links")
    roots = left.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    first = True
    while not left.isEmpty():
        near = settle(left.groupBy("u").agg(F.min("v").alias("p")), "nearest")
        back = near.select(F.col("u").alias("p"), F.col("p").alias("back"))
        tree = near.join(back, "p").select("u", F.when((F.col("back") == F.col("u")) & F.expr("u < p"), F.col("u")).otherwise(F.col("p")).alias("p"))
        tree = settle(tree, "trees")
        while True:
            ahead = tree.select(F.col("u").alias("p"), F.col("p").alias("next"))
            step = settle(tree.join(ahead, "p").select("u", F.col("p").alias("old"), F.col("next").alias("p")), "trees")
            tree = step.select("u", "p")
            if step.filter("p <> old").isEmpty():
                break
        if first:
            roots = tree.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:  # roots without a link are done
            moved = roots.join(tree.withColumnRenamed("u", "root"), "root", "left")
            roots = settle(moved.select("node", F.coalesce("p", "root").alias("root")), "roots")
        first = False
        ends = left.join(tree.withColumnRenamed("p", "ru"), "u").select("ru", "v").join(tree.select(F.col("u").alias("v"), F.col("p").alias("rv")), "v")
        left = settle(ends.filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "links")
    named = roots.groupBy("root").agg(F.min("node").alias("comp"))
    return roots.join(settle(named, "component-names"), "root").select("node", "comp")
