"""How far the words of each source lie from those of its language's other sources.

Every price of a pair of sources is a sum over terms of a function of two counts.
With an indicator column for each (source, count level), the product of the
transposed indicator matrix with itself holds, for any two sources, the joint
table of their levels: how many terms have count a in one and b in the other.
Sums over terms become sums over the cells of these tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.llm.staging import settle, ship

#: A term counts in a language where so many documents hold it.
LEAST_DOCUMENTS = 10
#: Terms a task keeps counts of before it passes them on.
HELD_TERMS = 100_000
#: About so many terms and sources (on either side) make up the matrices of a task.
TERM_BLOCK = 8192
SOURCE_BLOCK = 32
#: Rows and columns of one dense product.
ROWS = 256
COLUMNS = 1024
#: Terms listed of each source.
TOP = 10

# ASCII capitals to small letters, all other ASCII but small letters to blanks; bytes of other characters stay
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term, and documents that hold it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(*group, term, times, holding[term]) for group, (found, holding) in held.items() for term, times in found.items()]
            held.clear()
            columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
            terms = pa.array(columns[2], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), terms, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

        size = 0
        for batch in batches:
            langs, sources, texts = batch.columns
            for i in range(batch.num_rows):
                words = texts[i].as_py().translate(_FOLD).split()
                found, holding = held.setdefault((langs[i].as_py(), sources[i].as_py()), (Counter(), Counter()))
                before = len(found)
                found.update(words)
                holding.update(set(words))
                size += len(found) - before
                if size > HELD_TERMS:
                    yield rows()
                    size = 0
        yield rows()

    texts = docs.select(*_group(lang, source), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]


def _share(count: str, total: str) -> Column:
    """One plus the smoothed share of a count in billionths, as a whole number; 1 without any kept term."""
    return F.expr(f"case when v = 0 then 1L else cast(1 + (1000000000BD * ({count} + 2)) div ({total} + 2 * v) as bigint) end")


def _price(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _joint_prices(group: pd.DataFrame) -> pd.DataFrame:
    """For all sources of two blocks the priced joint tables over one block of terms.

    Rows without a term name the sources of the blocks and the share of a term they do not have.
    """
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    named = group[group["term"].isna()].drop_duplicates("source").sort_values("source")
    order = {s: k for k, s in enumerate(named["source"])}
    counts = group[group["term"].notna()]
    rows, terms = pd.factorize(counts["term"])
    columns = counts["source"].map(order).to_numpy(np.int64)
    level = np.zeros((len(terms), len(order)), np.int64)
    share = np.tile(named["p"].to_numpy(np.int64), (len(terms), 1))
    level[rows, columns], share[rows, columns] = counts["n"], counts["p"]
    often = np.argsort(-level.sum(1), kind="stable")  # frequent terms, which have many levels, share few blocks of rows
    level, share = level[often], share[often]
    own = named["own"].to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    total = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(terms), ROWS):
        sides = [_indicators(level[at : at + ROWS, side], share[at : at + ROWS, side]) for side in (left, right)]
        for a, ones, p in sides[0]:
            for b, others, q in sides[1]:
                joint = (ones.T @ others).astype(np.int64)  # whole numbers up to ROWS, exact in single precision
                p_, q_ = p[0][:, None], q[0][None, :]
                prices = joint * ((p_ - q_) * (p_ - q_) // (p_ + q_))
                total[a, b] += np.add.reduceat(np.add.reduceat(prices, p[1], axis=0), q[1], axis=1)
    names = named["source"].to_numpy()
    a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    out = pd.DataFrame({"lang": group["lang"].iloc[0], "source": names[a], "item": names[b], "value": total.ravel(), "terms": len(terms)})
    if i != j:
        out = pd.concat([out, out.rename(columns={"source": "item", "item": "source"})])
    return out[out["source"] != out["item"]][["lang", "source", "item", "value", "terms"]]


def _indicators(level: np.ndarray, share: np.ndarray) -> list[tuple[slice, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of indicator columns, a column per (source, level): the sources of a block, its matrix,
    and the columns' shares with the place of each source's first column."""
    out, start, parts = [], 0, []
    for k in range(level.shape[1]):
        values, first, where = np.unique(level[:, k], return_index=True, return_inverse=True)
        ones = np.zeros((len(level), len(values)), np.float32)
        ones[np.arange(len(level)), where] = 1
        parts.append((ones, share[first, k]))
        if k + 1 == level.shape[1] or sum(len(p) for _, p in parts) + ROWS > COLUMNS:
            firsts = np.cumsum([0, *(len(p) for _, p in parts[:-1])])
            out.append((slice(start, k + 1), np.hstack([m for m, _ in parts]), (np.concatenate([p for _, p in parts]), firsts)))
            start, parts = k + 1, []
    return out


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances between the sources
    of a language (part ``pair``) and the terms that set a source apart (``term``).

    Shares, prices and sums are whole numbers, so neither the order of tasks nor
    the cut into blocks changes a result.  Matrices are cut into blocks of terms and
    of sources by hash; a count goes to each pair of blocks its source is in, and
    a task holds a bounded matrix whatever the language's size.  Terms that no
    source of a task has are priced from their number.

    Null texts, languages and sources count as ``''``; repeated rows count each; a
    group without a term has its pairs, a language without a kept term pairs of
    value 0; other columns are ignored; an empty table gives no rows.
    """
    groups = settle(docs.select(*_group(lang, source)).distinct(), "groups")
    counts = settle(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= LEAST_DOCUMENTS)
    kept = settle(kept.select("lang", "term", "all"), "kept-terms")
    counts = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept-counts")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("all_n")), "lang", "left").na.fill(0, ["v", "all_n"])
    langs = langs.withColumn("source_blocks", F.expr(f"cast(ceil(sources / {source_block}) as int)")).withColumn("term_blocks", F.expr(f"cast(greatest(1, ceil(v / {term_block})) as int)"))
    langs = settle(langs, "languages")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["own_n"]).join(langs, "lang")
    groups = settle(groups.withColumn("p", _share("0", "own_n")).withColumn("own", F.expr("cast(pmod(xxhash64(source), source_blocks) as int)")), "priced-groups")
    shares = counts.join(groups.select("lang", "source", "own_n", "v", "all_n", "own", "source_blocks", "term_blocks"), ["lang", "source"])
    shares = shares.withColumns({"p": _share("n", "own_n"), "q": _share("all", "all_n")})
    shares = settle(shares.select("lang", "source", "term", "n", "p", "q", "own", "source_blocks", F.expr("cast(pmod(xxhash64(term), term_blocks) as int)").alias("block")), "shares")

    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "p", "own", "source_blocks", F.explode(F.expr("sequence(0, term_blocks - 1)")).alias("block"))
    dealt = shares.drop("q").unionByName(heads).withColumn("other", F.explode(F.expr("sequence(0, source_blocks - 1)")))
    dealt = dealt.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "source", "term", "n", "p", "own")
    parts = dealt.groupBy("lang", "block", "i", "j").applyInPandas(_joint_prices, "lang string, source string, item string, value long, terms long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", "source", "p", "v")
    pairs = pairs.join(one, ["lang", "source"]).join(one.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "item"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("v") - F.col("terms")) * _price("p", "q")).alias("value"))

    terms = shares.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))  # as many rows as other sources, or kept terms
    top = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
