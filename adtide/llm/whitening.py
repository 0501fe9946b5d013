"""Whitening of embeddings on the leading components of their covariance, found by contour integration.

Spark sums the covariance from the vectors of all tasks.  Its size is the square
of the dimension whatever the number of vectors, so it is sent to the tasks that
share the work on it: inertia counts of shifts, and complex solves at the
quadrature nodes around intervals of eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtide.llm.staging import settle, ship

COMPONENTS = 8
#: An entry is scaled and cut down to a whole number (fixed); entries beyond the limit have none.
SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**53
#: Quadrature nodes on the half circle around an interval; further vectors of a subspace besides those looked for.
NODES = 8
SPARE = 8
#: Shifts counted in one job; intervals span at most this factor; eigenvalues under this share of the largest count as 0.
SHIFTS = 24
SPAN = 8.0
RANK = 1e-12
#: Groups in which the tasks' parts of a covariance are summed first.
SALTS = 64
#: Vectors of one block of a task's work.
ROWS = 1024


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]:
    """Per length of vectors in a batch: places of its rows, the batch, and their scaled whole numbers as a matrix."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            lists = batch.column(batch.schema.get_field_index("v"))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                values = flat[(ends[rows] - size)[:, None] + np.arange(size)[None, :]]
                yield rows, batch, np.floor(SCALE * values).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: the number of vectors and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, _, x in _blocks(batches):
            own = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            own[0] += len(x)
            own[1] = [a + b for a, b in zip(own[1], x.sum(0).tolist(), strict=True)]  # a block's sum fits a long
        flat = [(dim, place, own[0], str(s)) for dim, own in held.items() for place, s in enumerate(own[1])]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["dim", "place", "n", "s"])

    parts = rows.select("v").mapInArrow(run, "dim int, place int, n long, s string")
    found = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("dim", "place").collect():  # a row per entry of a vector
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def _covariances(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length: the covariance, from products of centred vectors."""
    means = {dim: np.array([s / n for s in total]) for dim, (n, total) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, _, x in _blocks(batches):
            y = x - means[x.shape[1]]
            held[x.shape[1]] = held.get(x.shape[1], 0) + y.T @ y
        for dim, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "place", "row"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        return group.head(1).assign(row=[np.sum(np.stack(group["row"].to_list()), axis=0)])

    parts = rows.select("v").mapInArrow(run, "dim int, place int, row array<double>").withColumn("part", F.spark_partition_id())
    schema = "dim int, place int, row array<double>, part int"
    parts = settle(parts, "covariance-parts").withColumn("salt", F.col("part") % SALTS)
    parts = parts.groupBy("dim", "place", "salt").applyInPandas(lambda g: add(g)[["dim", "place", "row", "salt"]].rename(columns={"salt": "part"}), schema)
    whole = parts.groupBy("dim", "place").applyInPandas(lambda g: add(g)[["dim", "place", "row", "part"]], schema)
    out = {dim: np.zeros((dim, dim)) for dim in sums}
    for r in whole.collect():  # the square of the dimension, whatever the number of vectors
        out[r.dim][r.place] = r.row
    return {dim: (m + m.T) / (2 * sums[dim][0]) for dim, m in out.items()}


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues over ``shift``: positive pivots of the symmetric factorisation
    of the shifted matrix, with diagonal pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    at, size, above, bound = 0, len(a), 0, (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while at < size:
        pivot = abs(a[at, at])
        beside = np.abs(a[at + 1 :, at])
        most = beside.max(initial=0.0)
        two = False
        if most and pivot < bound * most:
            other = at + 1 + int(beside.argmax())
            column = np.abs(a[at:, other])
            column[other - at] = 0
            if pivot * column.max() < bound * most * most:
                two = abs(a[other, other]) < bound * column.max()
                swap(at + two, other)
        if two:
            block, rest = a[at : at + 2, at : at + 2].copy(), a[at + 2 :, at : at + 2].copy()
            above += int((np.linalg.eigvalsh(block) > 0).sum())
            a[at + 2 :, at + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        else:
            above += int(a[at, at] > 0)
            if a[at, at]:
                a[at + 1 :, at + 1 :] -= np.outer(a[at + 1 :, at], a[at + 1 :, at]) / a[at, at]
        at += 1 + two
    return above


def _shared_out(spark: SparkSession, number: int, work: Callable[[int], np.ndarray]) -> list[np.ndarray]:
    """``work(0)`` to ``work(number - 1)``, each in a task of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                yield pd.DataFrame({"id": [k], "out": [np.asarray(work(int(k)), float).ravel()]})

    rows = spark.range(0, number, 1, number).mapInPandas(run, "id long, out array<double>").collect()
    return [np.array(r.out) for r in sorted(rows, key=lambda r: r.id)]


def _bracket(count: Callable[[list[float]], list[int]], top: float, wanted: int) -> dict[float, int]:
    """Shifts and the number of eigenvalues over each: down to one with ``wanted`` of them or a few
    more (all of a tie), or to the rank."""
    known = {top: 0}
    low, high = top * RANK, top
    while True:
        shifts = [float(s) for s in np.geomspace(low, high, SHIFTS + 1)[:-1]]
        known |= dict(zip(shifts, count(shifts), strict=True))
        enough = [s for s, n in known.items() if n >= wanted]
        if not enough:
            return known  # all that are not 0
        low = max(enough)
        high = min(s for s in known if s > low)
        if known[low] <= wanted + SPARE or high - low <= 1e-13 * top:
            return {s: n for s, n in known.items() if s >= low}


def _intervals(known: dict[float, int]) -> list[tuple[float, float, int]]:
    """Neighbouring shifts joined to intervals of at most ``SPAN`` that hold an eigenvalue, with their number."""
    ends = sorted(known)
    out: list[tuple[float, float, int]] = []
    for a, b in zip(ends, ends[1:], strict=False):
        inside = known[a] - known[b]
        if inside and out and out[-1][1] == a and b <= SPAN * out[-1][0]:
            out[-1] = (out[-1][0], b, out[-1][2] + inside)
        elif inside:
            out.append((a, b, inside))
    return out


def leading_components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Inertia counts of many shifts give intervals that hold them.  Of each interval
    a few starting vectors are projected onto its eigenspace: a sum over the
    quadrature nodes of a half circle around it, each a complex shifted solve in
    a task.  The Rayleigh-Ritz step on all projections gives the components,
    which start the next round until their residuals fall no more.  If fewer
    lie over the lowest shift than its count says, subspaces grow.  Eigenvalues
    that are 0 (up to rounding) have no component.
    """
    size = len(matrix)
    top = float(np.abs(matrix).sum(1).max()) * (1 + 1e-6)  # no eigenvalue is larger
    if not top:
        return np.zeros(0), np.zeros((size, 0))
    sent = spark.sparkContext.broadcast(matrix)  # the square of the dimension
    known = _bracket(lambda shifts: [int(c[0]) for c in _shared_out(spark, len(shifts), lambda k: eigenvalues_above(sent.value, shifts[k]))], top, min(wanted, size))
    intervals, low = _intervals(known), min(known)
    spots, weights = np.polynomial.legendre.leggauss(NODES)
    random = np.random.default_rng(11)
    spare, values, vectors, last = SPARE, np.zeros(0), np.zeros((size, 0)), np.inf
    while True:
        starts = []
        for a, b, inside in intervals:
            near = vectors[:, np.argsort(np.abs(values - (a + b) / 2), kind="stable")[: inside + spare // 2]]
            fresh = random.standard_normal((size, min(size, inside + spare) - near.shape[1])) if near.shape[1] < min(size, inside + spare) else np.zeros((size, 0))
            starts.append(np.hstack([near, fresh]))
        begun = spark.sparkContext.broadcast(starts)  # the dimension times the vectors of the subspaces

        def solve(k: int, begun=begun) -> np.ndarray:
            a, b, _ = intervals[k // NODES]
            turn = (b - a) / 2 * np.exp(0.5j * np.pi * (1 + spots[k % NODES]))
            shifted = ((a + b) / 2 + turn) * np.eye(size) - sent.value
            return weights[k % NODES] / 2 * (turn * np.linalg.solve(shifted, begun.value[k // NODES])).real

        parts = _shared_out(spark, NODES * len(intervals), solve)
        projected = [sum(parts[NODES * i : NODES * (i + 1)]).reshape(s.shape) for i, s in enumerate(starts)]
        basis, _ = np.linalg.qr(np.hstack([p / np.maximum(np.linalg.norm(p, axis=0), 1e-300) for p in projected]))
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        found = values > low
        residual = float(np.linalg.norm(matrix @ vectors[:, found] - vectors[:, found] * values[found], axis=0).max(initial=0.0))
        if int(found.sum()) == known[low] and (residual <= 1e-15 * top or residual >= last / 4):
            order = np.argsort(-values, kind="stable")[: min(wanted, known[low])]
            return values[order], vectors[:, order]
        if residual >= last / 4 and int(found.sum()) < known[low]:
            spare *= 2
        last = residual


def _deviations(x: np.ndarray, n: int, total: list[int], centred: np.ndarray) -> list[int | None]:
    """Sum of squares of ``n * x - total`` per row, exactly; None where it does not fit a long."""
    sizes = (centred.astype(float) ** 2).sum(1) * float(n) ** 2
    wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in total], np.int64)
    spread = x * np.int64(n) - wrapped  # exact where the difference is small, as whole numbers wrap around
    with np.errstate(over="ignore"):
        out = (spread * spread).sum(1).tolist()
    for k in np.flatnonzero(sizes > 0.99 * 2.0**63):  # near the limit or beyond: with numbers of any size
        exact = sum((n * a - s) ** 2 for a, s in zip(x[k].tolist(), total, strict=True)) if sizes[k] < 1.01 * 2.0**63 else 2**63
        out[k] = exact if exact < 2**63 else None
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: a row per vector and component.

    Sums are exact; the covariance, the projections and the check of the result
    (``identity_error``) are each a pass over all vectors.  Vectors that are null,
    or hold null or non-finite entries, or ones too large for a whole number after
    scaling, are left out.  Vectors of each length have a fit of their own.
    Components with eigenvalue 0 do not exist: equal vectors, or a single one, give
    no rows.  ``deviation`` is null where it does not fit a long.  Null and
    repeated keys and rows count each; an empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.expr(f"size(v) > 0 and forall(v, e -> e is not null and abs(e) < {LIMIT / SCALE}D)"))
    kind = rows.schema["key"].dataType
    sums = _sums(rows)
    fits = {dim: leading_components(spark, m, components) + (float(np.trace(m)),) for dim, m in _covariances(rows, sums).items()} if sums else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, batch, x in _blocks(batches):
            dim = x.shape[1]
            n, total = sums[dim]
            values, axes, _ = fits[dim]
            centred = x - np.array([s / n for s in total])
            out = centred @ (axes / np.sqrt(values))
            ids = batch.column(0).take(pa.array(places))
            columns = [ids, pa.array([dim] * len(x), pa.int32()), pa.array(_deviations(x, n, total, centred), pa.int64()), pa.array(list(out), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "dim", "deviation", "w"])

    done = settle(rows.mapInArrow(run, f"key {kind.simpleString()}, dim int, deviation long, w array<double>"), "whitened")
    facts = [(dim, sums[dim][0], [float(e / trace) for e in values], _identity_error(done.filter(F.col("dim") == dim), len(values))) for dim, (values, _, trace) in fits.items() if len(values)]
    known = spark.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")  # a row per length
    out = done.join(F.broadcast(known), "dim").select("*", F.posexplode("w").alias("place", "whitened"))
    return out.select(F.col("key").alias(key), (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.expr("explained[place]").alias("explained"), "identity_error")


def _identity_error(done: DataFrame, count: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    means = done.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(count)]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    both = done.agg(*[F.avg((F.col("w")[i] - means[i]) * (F.col("w")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(both[k] - (i == j)) for k, (i, j) in enumerate(pairs))
