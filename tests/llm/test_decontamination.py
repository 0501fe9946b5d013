"""Benchmark search against its SQL twin and by hand."""

import duckdb

from adtide.llm import decontamination, queries

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def items(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, size int")


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    twin = con.sql(queries.ORACLE["op6_decontamination"])
    got = queries.QUERIES["op6_decontamination"](spark, sf_dir)
    assert sorted(tuple(r[c] for c in twin.columns) for r in got.collect()) == sorted(twin.fetchall())


def test_by_hand(spark, documents):
    long = " ".join(f"w{n}" for n in range(300))
    docs = documents([
        (1, f"{long} {ITEM.upper()}! {long}"), (2, ITEM.replace("iota kappa", "x y")), (3, ITEM.replace("kappa", "x")), (4, "two words"), (5, "a two, words b"), (6, None), (7, ""), (1, "other"), (None, ITEM),
    ])
    bench = items(spark, [(1, ITEM), (1, ITEM), (2, "two words"), (3, None), (4, "..."), (5, ITEM + " more " + long)])
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontamination.contaminated(docs, bench).collect()}
    # of item 5 all but the shingles with "more" are in document 1
    assert got == {(1, 1): (6, 6), (1, 5): (307, 302), (3, 1): (6, 5), (None, 1): (6, 6), (4, 2): (1, 1), (5, 2): (1, 1)}
    small = decontamination.contaminated(docs, bench, block_rows=100)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(got)
    assert sorted(r.doc_id or 0 for r in decontamination.drop_contaminated(docs, bench).collect()) == [0, 2, 6, 7]


def test_empty(spark, documents):
    docs = documents([(1, ITEM)])
    assert decontamination.contaminated(docs, items(spark, [])).count() == 0
    assert decontamination.contaminated(documents([]), items(spark, [(1, ITEM)])).count() == 0


def test_repeated_keys_with_other_texts_equal_sql(spark, documents):
    other = " ".join(f"x{n}" for n in range(8))
    docs = documents([(1, ITEM), (1, other), (2, f"{ITEM} {other}"), (3, other)])
    bench = items(spark, [(1, ITEM), (1, other), (1, f"{ITEM} {other}"), (2, f"{other} more")])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    twin = con.sql(queries.ORACLE["op6_decontamination"])
    got = sorted(tuple(r[c] for c in twin.columns) for r in decontamination.contaminated(docs, bench).collect())
    assert got == sorted(twin.fetchall())
    assert [(d, i, n, m) for d, i, n, m, _ in got] == [(1, 1, 6, 6), (1, 2, 5, 4), (2, 1, 14, 14), (2, 2, 5, 4), (3, 1, 4, 4), (3, 2, 5, 4)]
