"""Packing: round trip of the pieces, capacity, and the bound."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adtide.llm import packing, queries

tokenizers = pytest.importorskip("tokenizers")


def check(rows, texts, end=True):
    """``texts``: key -> whole text; returns the number of sequences."""
    encoder = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(texts)
    for key, text in texts.items():
        ids, at = [*encoder.encode(text or "", add_special_tokens=False).ids, 2], 0
        for n, p in enumerate(sorted(by[key], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (n, at) and (n == 0 or p.length == 1024)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_packing"](spark, sf_dir).collect()
    assert check(rows, texts) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_edges(documents):
    texts = {1: None, 2: "", 3: "<|endoftext|> is a token", 4: "word " * 5_000, 5: "don't  stop\n\n 12 ünïcödé 漢字 🙂", 6: "a" * 3_000}
    rows = packing.pack_documents(documents(list(texts.items())), queries.tokenizer_path()).collect()
    check(rows, texts)
    twice = packing.pack_documents(documents([(1, "same"), (1, "same"), (None, "x")]), queries.tokenizer_path()).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert packing.pack_documents(documents([]), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("run", ["a" + " " * 1_000_000, "\n" * 1_000_000, " \t" * 500_000 + "x", "q" * 300_000, " " * packing.LONG_SPACE + "end", "x" + "\u3000" * 20_000 + "y z"])
def test_very_long_runs(documents, run):
    rows = packing.pack_documents(documents([(1, run), (2, "other")]), queries.tokenizer_path()).collect()
    check(rows, {1: run, 2: "other"})


def test_exchange_reaches_the_bound_of_the_whole(spark):
    sizes = np.random.default_rng(5).integers(1, 700, 4000)
    table = spark.createDataFrame([(int(n), int(n), 0, 0, int(s), 0) for n, s in enumerate(sizes)], packing.PIECES)
    got = packing.pack(table, group=200).collect()
    used = len({r.sequence_id for r in got})
    assert {r.least_sequences for r in got} == {packing.lower_bound(sizes)}
    assert packing.lower_bound(sizes) <= used <= len(set(packing.best_fit(sizes).tolist())) + 1


def test_exchange_between_groups(spark):
    sizes = np.random.default_rng(3).integers(1, 1024, 600)
    rows = [(int(n), int(n), 0, 0, int(s), 0) for n, s in enumerate(sizes)]
    table = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(table, group=60).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 600 and max(fill.values()) <= 1024
    # a group that meets its own bound is done; ten groups of sixty can be up to one sequence each above the whole
    whole = len(set(packing.best_fit(sizes).tolist()))
    assert packing.lower_bound(sizes) <= whole <= len(fill) <= whole * 1.05 + 10
    assert len({r.sequence_id for r in packing.pack(table, group=600).collect()}) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_best_fit(sizes):
    sizes = np.array(sizes, np.int64)
    bins = packing.best_fit(sizes, 20)
    used = len(set(bins.tolist()))
    assert all(sizes[bins == b].sum() <= 20 for b in set(bins.tolist()))
    assert packing.lower_bound(sizes, 20) <= used
