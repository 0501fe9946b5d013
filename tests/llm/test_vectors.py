"""Vector near duplicates against all pairs."""

import numpy as np

from adtide.llm import queries, vectors


def plain(rows):
    """(n_links, component) by brute force for finite non-zero vectors with distinct keys."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = ids.copy()
    for _ in range(len(ids)):
        low = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (low == label).all():
            break
        label = low
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label, strict=True)}


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op7_embeddings"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_recall_and_precision_on_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    rows = [(n, (base[n % 60] + rng.normal(scale=0.25, size=24) * (n >= 60)).tolist()) for n in range(900)]
    rows += [(900 + n, rows[7][1]) for n in range(40)]
    want = plain(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want) and sum(r.n_links for r in got.values()) >= 0.9 * links
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e299]), (None, [1.0, 0.0]), (12, [1e-300, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    assert {i for i in got if got[i] == (0, i, True)} >= {3, 4, 5, 6, 7, 8, 10} and len(got) == 13
    assert {got[i][:2] for i in (1, 2, 9, 11, 12)} == {(4, 1)}
    assert vectors.near_vectors(frame.limit(0)).count() == 0
