"""The pipeline's stages against plain versions of their decisions."""

import re

import corpus_pipeline
from adtide.llm.staging import leave_out, settle
from test_near_dup import plain


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "decontamination", "secrets", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    lang = {i for i, r in rows.items() if any(c.isalpha() for c in r.text)}
    assert set(seen["language"]) == lang
    low = plain([(i, rows[i].text) for i in lang], corpus_pipeline.SHINGLE_WORDS)
    assert set(seen["near-duplicates"]) == {i for i, (_, c) in low.items() if c == i}
    bench = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in bench]
    for i in seen["near-duplicates"]:
        w = re.findall(r"\w+", rows[i].text.lower())
        own = {tuple(w[n : n + 5]) for n in range(len(w) - 4)}
        assert (i in seen["decontamination"]) == (not any(g and len(g & own) >= 0.8 * len(g) for g in grams))
    assert set(seen["secrets"]) == set(seen["decontamination"]) == set(seen["packing"])
    assert not any(re.search(r"(?i)token = \"[0-9a-f]{40}", r.text) for r in seen["secrets"].values())
    clean = [i for i, r in seen["secrets"].items() if "[SECRET]" not in r.text]
    assert clean and all(seen["secrets"][i].text == rows[i].text for i in clean)


def test_leave_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    named = spark.createDataFrame([(2,), (2,), (None,), (9,)], "doc_id long")
    for most in (10, 1):  # sent to all tasks, and by shuffle
        kept = leave_out(docs, named, "doc_id", most)
        assert sorted(map(str, kept.toPandas()["text"])) == ["None", "a", "d"] and kept.columns == docs.columns
    text = docs.select("text", "doc_id")
    assert leave_out(text, text.filter("doc_id = 2"), "text").count() == 3


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
