"""Whitening against numpy's full eigendecomposition and exact sums."""

import math

import numpy as np
import pytest

from adtide.llm import queries, whitening


def test_inertia_counts():
    r = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 30):
        for _ in range(10):
            m = r.standard_normal((size, size))
            m = m + m.T
            if size > 2:
                m[0, 0] = m[1, 1] = 0
            values = np.linalg.eigvalsh(m)
            for shift in (-1.0, 0.0, 0.3, float(values[0]) - 1e-6, float(values[-1]) + 1e-6, float(values.mean())):
                assert whitening.eigenvalues_above(m, shift) == (values > shift).sum()
    assert whitening.eigenvalues_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.eigenvalues_above(np.zeros((4, 4)), 0.0) == 0


SPECTRA = {
    "wide": [10.0**-k for k in range(12)] + [1e-11] * 10,
    "tie at the cut": [9, 8, 7, 6, 5] + [4.0] * 12 + [1.0] * 13,
    "all equal": [3.0] * 30,
    "near the cut": [8.0, 7, 6, 5, 4, 3, 2, 1.0 + 1e-9, 1.0, 1.0 - 1e-9] + [0.5] * 20,
    "few": [5.0, 2.0, 1.0] + [0.0] * 27,
    "one": [1.0] + [0.0] * 29,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_of_known_spectra(spark, name):
    whitening.ship(spark)
    values = np.array(SPECTRA[name])
    turn, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((len(values), len(values))))
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.leading_components(spark, matrix, 8)
    want = np.sort(values[values > 0])[::-1][:8]
    assert len(found) == len(want)
    assert np.abs(found - want).max() <= 1e-13 * want[0]
    assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-12
    assert np.linalg.norm(matrix @ axes - axes * found, axis=0).max() <= 1e-12 * want[0]


def fitted(x):
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return centred, values[::-1], axes[:, ::-1]


def check(rows, vectors):
    """rows of the result for ``vectors`` (key -> list) against a full decomposition."""
    keys = sorted(vectors)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in vectors[k]] for k in keys], object)
    n, total = len(x), x.sum(0)
    centred, values, axes = fitted(x.astype(float))
    count = min(8, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == n * count
    by = {(r.vec_id, r.component): r for r in rows}
    for c in range(count):
        want = centred @ axes[:, c] / np.sqrt(values[c])
        got = np.array([by[k, c + 1].whitened for k in keys])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(by[keys[0], c + 1].explained - values[c] / values.sum()) < 1e-10
    for k, row in zip(keys, x, strict=True):
        assert by[k, 1].n == n and by[k, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True))
    assert max(r.identity_error for r in rows) < 1e-8


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, w string, n int")


def test_equals_numpy_and_leaves_out_bad_rows(spark):
    r = np.random.default_rng(3)
    base = {k: (r.standard_normal(12) * np.arange(1, 13)).tolist() for k in range(400)}
    base |= {k: base[0] for k in range(400, 600)}  # a third are equal
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [1.0] * 11 + [float("inf")]), (1004, []), (1005, [1e300] * 12)]
    out = whitening.whiten(table(spark, [*base.items(), *bad]).repartition(7)).collect()
    assert {r.vec_id for r in out} == set(base)
    check(out, base)


def test_lengths_and_ranks(spark):
    r = np.random.default_rng(4)
    three = {k: [float(a), 2.0 * float(a), 5.0] for k, a in enumerate(r.integers(0, 50, 60))}  # one component
    five = {100 + k: r.standard_normal(5).tolist() for k in range(50)}
    rows = [*three.items(), *five.items(), (500, [1.0, 2.0]), (501, [3.0]), (502, [3.0]), (None, five[100]), (100, five[101])]
    out = whitening.whiten(table(spark, rows)).collect()
    check([r for r in out if r.vec_id is not None and r.vec_id < 100], three)
    rest = [r for r in out if r.vec_id is None or r.vec_id >= 100]
    assert len(rest) == 52 * 5 and {r.n for r in rest} == {52}  # null and repeated keys count; [3.0] twice and single rows vary in nothing
    assert max(r.identity_error for r in rest) < 1e-8


def test_deviation_beyond_a_long():
    x = np.array([[2**52, 0], [0, 5], [2**31, 3], [2**30 + 1, 7]], np.int64)
    total = x.sum(0).tolist()
    exact = [sum((4 * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x.tolist()]
    centred = x - np.array(total) / 4
    assert whitening._deviations(x, 4, total, centred) == [e if e < 2**63 else None for e in exact]
    small = np.array([[10**9, 1], [10**9 + 3, 5], [10**9 - 1, 9]], np.int64)
    total = [10**9 * 10**10 + 7, 10**11]
    exact = [sum((10**10 * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in small.tolist()]
    got = whitening._deviations(small, 10**10, total, small - np.array(total) / 10**10)
    assert got == [e if e < 2**63 else None for e in exact]


def test_empty(spark):
    out = whitening.whiten(table(spark, []))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0


def test_query(spark, sf_dir):
    out = queries.QUERIES["op13_whitening"](spark, sf_dir).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check(out, vectors)
