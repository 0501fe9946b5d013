"""Documents packed into token sequences: best-fit decreasing under a certified bound."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtide.llm.staging import hold, settle, ship

LENGTH = 1024
END_ID = 2
#: Pieces of one group of the packing; a group is one task's work.
GROUP = 20_000
#: White space in one run from which on a text is encoded by ``tokenizers``: the pattern of the split looks back
#: over such a run, for which the faster encoder has a bounded stack (400,000 pass, a million do not).
LONG_SPACE = 100_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def _encoder(path: str):
    """The byte-level vocabulary at ``path``, loaded once per worker process."""

    def load():
        import json

        import tiktoken

        table = json.load(open(path, encoding="utf-8"))
        # the fixed map from the characters of the file to bytes: printable ones stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"]: t["id"] for t in table["added_tokens"]}
        ranks = {bytes(chars[c] for c in word): n for word, n in table["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level split
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    return hold(("vocabulary", path), load)


_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


def encode(path: str, text: str) -> np.ndarray:
    """The ids of a whole text, as both encoders give them."""
    if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
        import tokenizers

        # such a text is rare and long: the tokenizer is not held besides the faster encoder
        return np.array(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoder(path).encode_to_numpy(text, allowed_special="all")


def cut(size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``size`` tokens: whole sequences, the rest first."""
    first = size % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, size, length)]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, row, piece, start, length, ids_crc32``.

    Whole texts are encoded (a null one as empty) and end with ``end_id``, so
    each document has a piece.  ``row`` tells rows with the same key apart: it
    is a hash of key and text; equal rows share it and their pieces are told
    apart by being rows.  No shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                ids = np.append(encode(tokenizer, text), np.uint32(end_id)).astype("<u4")
                for n, (start, size) in enumerate(cut(len(ids), length)):
                    out.append((doc, row, n, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """Fewest sequences that could hold ``sizes``, by dual-feasible functions.

    A dual-feasible function never lets a full sequence sum to over 1, so the
    sum over all pieces bounds the count.  Tried: the identity, and for each
    threshold t the function that counts pieces over length - t as whole, leaves
    out pieces under t and keeps the rest.
    """
    return lower_bound_of_counts(dict(enumerate(np.bincount(sizes).tolist())), length) if len(sizes) else 0


def lower_bound_of_counts(counts: dict[int, int], length: int = LENGTH) -> int:
    """:func:`lower_bound` from the number of pieces of each size."""
    if not counts:
        return 0
    count = np.zeros(length + 1, np.int64)
    count[list(counts)] = list(counts.values())
    total = np.concatenate(([0], np.cumsum(count * np.arange(length + 1))))
    number = np.concatenate(([0], np.cumsum(count)))
    t = np.arange(0, length // 2 + 1)
    whole = number[-1] - number[length - t + 1]
    middle = total[length - t + 1] - total[t]
    return int((whole + -(-middle // length)).max())


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bin of each piece: largest first, each into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    spaces: list[int] = []  # the different amounts of room there are, sorted
    bins: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            room = spaces[at]
            own = bins[room]
            b = own.pop()
            if not own:
                del bins[room]
                spaces.pop(at)
        else:
            room, b, used = length, used, used + 1
        out[i] = b
        left = room - size
        if left:
            if left not in bins:
                bins[left] = []
                insort(spaces, left)
            bins[left].append(b)
    return out


def _pack_groups(rows: DataFrame, length: int) -> DataFrame:
    """Pack each ``grp``; adds ``bin`` and the ``fill`` of the bin.  A group that meets its own bound is certified as it is."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece", "tie"], ascending=[False, True, True, True], kind="stable")
        sizes = group["length"].to_numpy(np.int64)
        b = best_fit(sizes, length)
        fill = np.bincount(b, sizes)[b].astype(np.int64)
        gap = int(b.max()) + 1 - lower_bound(sizes, length)
        return group[["tie", "row", "piece", "length", "grp"]].assign(bin=b, fill=fill, gap=gap)

    return rows.groupBy("grp").applyInPandas(run, "tie long, row long, piece int, length long, grp long, bin long, fill long, gap long")


def pack(table: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``least_sequences`` to a table of :func:`pieces`.

    A piece of full length is a sequence of its own.  All other pieces are dealt
    by hash into groups of about ``group`` pieces, which no key can make hot,
    and each group is packed by best-fit decreasing.  Dual-feasible functions bound the
    count of each group, and of the whole table from the number of pieces of each
    length.  While the whole has a gap, groups keep their full bins and exchange the
    pieces of all others (a group that meets its own bound too, as many groups
    can each have one sequence more than the whole needs): these are dealt anew into half as
    many, mixed groups and packed again, until the whole meets its bound, a round
    saves no bin, or one group is left.  ``least_sequences`` is the bound, on
    every row: the count of sequences minus it is the gap that stays.  A sequence is named by its least piece.
    """
    table = settle(table.withColumn("tie", F.monotonically_increasing_id()), "pieces")
    full = table.filter(F.col("length") == length)
    short = table.filter(F.col("length") < length).select("tie", "row", "piece", "length")
    lengths = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    whole = lengths.pop(length, 0)
    count = sum(lengths.values())
    bound = lower_bound_of_counts(lengths, length)

    def packed(rows: DataFrame, number: int, groups: int) -> tuple[DataFrame, int, int, int]:
        """The packed rows with their count of bins, and bins and pieces that have room."""
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(number), "row", "piece", "tie"), F.lit(groups)))
        out = settle(_pack_groups(dealt, length), "packed").withColumn("bin", F.concat_ws("-", F.lit(number), "grp", "bin"))
        each = out.groupBy("bin").agg(F.first("fill").alias("fill"), F.count(F.lit(1)).alias("pieces"))
        room = F.col("fill") < length
        facts = each.agg(F.count(F.lit(1)), F.count_if(room), F.coalesce(F.sum(F.when(room, F.col("pieces"))), F.lit(0))).first()
        return out, facts[0], facts[1], facts[2]

    number, groups, closed = 0, max(1, -(-count // group)), 0
    rows, bins, open_bins, pieces_left = packed(short, number, groups)
    done: list[DataFrame] = []
    while groups > 1 and closed + bins > bound and open_bins > 1:
        number, groups = number + 1, max(1, min(groups // 2, -(-pieces_left // group)))
        again = packed(rows.filter(F.col("fill") < length).select("tie", "row", "piece", "length"), number, groups)
        if again[1] >= open_bins:
            break
        done.append(rows.filter(F.col("fill") == length))
        closed += bins - open_bins
        rows, bins, open_bins, pieces_left = again
    bins_of = [r.select("tie", "bin", "length") for r in (*done, rows)]
    bins = bins_of[0]
    for more in bins_of[1:]:
        bins = bins.union(more)
    # a bin has at most ``length`` pieces
    placed = bins.withColumn("offset", F.expr("cast(coalesce(sum(length) over (partition by bin order by length desc, tie rows between unbounded preceding and 1 preceding), 0) as long)"))
    placed = placed.withColumn("sequence_id", F.expr("min(tie) over (partition by bin)")).select("tie", "sequence_id", "offset")
    short_rows = table.filter(F.col("length") < length).join(placed, "tie")
    full_rows = full.withColumn("sequence_id", F.col("tie")).withColumn("offset", F.lit(0).cast("long"))
    return short_rows.unionByName(full_rows).drop("tie").withColumn("least_sequences", F.lit(bound + whole).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_bound: bool = False) -> DataFrame:
    """Pack whole documents; one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``,
    and ``least_sequences`` if asked for.

    A null text is empty and still has its end id; a null key stays null;
    repeated rows are packed one by one; an empty table gives no rows; other
    columns are ignored.  A document longer than a sequence is cut into whole
    sequences, its first piece taking the rest.
    """
    more = ["least_sequences"] if with_bound else []
    return pack(pieces(docs, tokenizer, key, text, length), length).select(
        F.col("doc_id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more
    )
