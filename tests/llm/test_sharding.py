"""Shards: counts, slots and mixture."""

import zlib
from collections import Counter

from adtide.llm import queries, sharding


def test_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert all(r.size == len(docs[r.doc_id].text.encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].text.encode()) for r in rows)
    per = Counter((docs[r.doc_id].source, r.shard) for r in rows)
    of = Counter(d.source for d in docs.values())
    assert all(abs(per[s, k] - of[s] / 8) <= 2 for s in of for k in range(8))


def test_edges(documents):
    rows = [(n % 40, None if n % 7 == 0 else f"t{n % 5}", None, None if n % 3 == 0 else "hot" if n % 3 == 1 else f"s{n}") for n in range(203)]
    got = sharding.shard(documents([*rows, (None, None)]), shards=5).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == 204 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in sizes.items())
    assert all((r.size, r.text_crc32) == (1, 0) for r in got if r.doc_id is None)
    assert sharding.shard(documents([])).count() == 0
