"""Language identification: accuracy on rows that were not learned from, and edges."""

import zlib

from adtide.llm import language, queries


def test_held_out_accuracy(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_language"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_parse_is_the_greedy_longest_match():
    model = language.Model({"x": "banana bandana", "y": "cabbage"})
    for lang, sample in (("x", "banana bandana"), ("y", "cabbage")):
        for text in ("banana", "bandcabba nab", "zzz", "a", "cabbage banana"):
            at = count = 0
            while at < len(text):
                size = max((n for n in range(1, len(text) - at + 1) if text[at : at + n] in sample), default=1)
                at, count = at + size, count + 1
            assert model.phrases([text])[0][model.langs.index(lang)][0] == count


def test_edges(documents):
    learn = documents([(n, f"the quick brown fox number {'abcdefgh'[n]} jumps", "en") for n in range(8)] + [(n, f"der schnelle braune fuchs {'abcdefgh'[n - 8]} springt", "de") for n in range(8, 16)] + [(20, None, "en"), (21, "lost", None)])
    docs = documents([(1, "brown fox jumps"), (2, "brauner fuchs"), (3, None), (4, ""), (5, "12 34 !!"), (1, "brown fox jumps"), (None, "fox " * 20_000)])
    got = [(r.doc_id, r.lang_pred) for r in language.identify(docs, learn).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (1, "en"), (None, "en")], key=str)
    assert {r.lang_pred for r in language.identify(docs, documents([])).collect()} == {"und"}
    assert language.identify(documents([]), learn).count() == 0
