"""Quality signals and adaptive fences against a plain Python version and by hand."""

import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from adtide.llm import quality, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_signals(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in quality.SYMBOLS for c in text or "")
    return (len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated))


def got_signals(df):
    return [tuple(r.signals) for r in df.collect()]


TEXTS = [
    None, "", " \t\n\x0b\f\r", "one", "a b c", "a b c a b c", "a a a a", "a a a a a b a a a", "x\ny\nx\n \n\nx", "#a |b| <c> $d% & e*",
    "é ß \U0001f600\U0001f600  z", "a b c d a b c e a b", "l1 w\r\nl1 w\nl1 w", "\x1c\x1d a\x85b", "\n\n\n", "w " * 5000, " " * 300000, "q" * 200000,
]


def test_signals_match_plain(spark, documents):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)]).withColumn("signals", F.lit(1)).withColumn("doc", F.lit(2))
    rows = quality.measure(docs).orderBy("doc.doc_id")
    assert got_signals(rows) == [plain_signals(t) for t in TEXTS]


def test_signals_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality.measure(docs.select("doc_id", "text")).select("doc.text", "signals").collect()
    assert [tuple(r.signals) for r in rows] == [plain_signals(r.text) for r in rows]


@pytest.mark.parametrize("value", [0, 1, 127, 128, 129, 255, 256, 1000, 65535, 65536, 10**9])
def test_bins_hold_their_value(spark, value):
    b = spark.range(1).select(F.expr(quality._bin(f"bigint({value})"))).first()[0]
    low = b if b < 128 else (b - 64 * (b // 64 - 1)) << (b // 64 - 1)
    high = b if b < 128 else ((b + 1 - 64 * ((b + 1) // 64 - 1)) << ((b + 1) // 64 - 1)) - 1
    assert low <= value <= high
    assert (high - low) * 64 <= low or high == low


def plain_fence(own, lang, rule):
    weights = Counter()
    for v in own:
        weights[v] += Fraction(1)
    for v in lang:
        weights[v] += Fraction(quality.PRIOR, len(lang))
    total, upto, q1, q3 = sum(weights.values()), 0, None, None
    for v in sorted(weights):
        upto += weights[v]
        q1 = v if q1 is None and 4 * upto >= total else q1
        q3 = v if q3 is None and 4 * upto >= 3 * total else q3
    reach = quality.REACH * max(q3 - q1, rule.spread)
    return q1 - reach, q3 + reach


def test_fences_follow_source_and_language(spark, documents):
    words, table = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}|" for i in range(60))
    rows = [(i, words.replace("w1 ", "#" * (i % 4) + " "), "en", "big") for i in range(300)]
    rows += [(1000 + i, table, "en", "tables") for i in range(400)]  # symbols are usual in this source
    rows += [(2000, table, "en", "big"), (2001, table, "en", "new"), (2002, words, None, None)]
    judged = quality.judge(quality.measure(documents(rows)))
    kept = {r.doc_id: (r.kept, list(r.failed)) for r in judged.select("doc.doc_id", "kept", "failed").collect()}
    assert all(kept[1000 + i][0] for i in range(400))
    assert kept[2000] == (False, ["symbols"])
    assert kept[2001][0]  # a source of one document follows its language
    assert kept[2002][0]
    symbols = next(r for r in quality.RULES if r.name == "symbols")
    values = {"big": [], "tables": [], "new": []}
    for _, text, lang, source in rows:
        if lang:
            n, _, hashes, *_ = plain_signals(text)
            values[source].append(hashes * 1000 // n)
    everything = [v for each in values.values() for v in each]
    fences = {r.source: r.fences["symbols"] for r in quality.fences(quality.sketches(quality.measure(documents(rows)))).filter("lang = 'en'").collect()}
    for source, own in values.items():  # bins are a 64th wide at most, and so are the quartiles
        low, high = plain_fence(own, everything, symbols)
        assert abs(fences[source].high - high) <= 4 + abs(high) // 8 and abs(fences[source].low - low) <= 4 + abs(low) // 8


def test_merged_parts_give_the_same_sketch(spark, documents):
    rows = [(i, " ".join(["ab"] * (i % 7 + 1)), "en", "s") for i in range(100)]
    sketch = lambda r: quality.sketches(quality.measure(documents(r)))
    whole = {tuple(r) for r in sketch(rows).collect()}
    parts = sketch(rows[:30]).unionByName(sketch(rows[30:])).groupBy("lang", "source", "rule", "bin").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in parts.collect()} == whole


def test_odd_rows(spark, documents):
    rows = [(1, None), (1, None), (2, ""), (None, "few words here"), (3, "same " * 100), (3, "same " * 100)]
    out = quality.judge(quality.measure(documents(rows))).select("doc.doc_id", "base_failed", "kept", "failed").collect()
    assert len(out) == 6 and all(r.base_failed and not r.kept for r in out)
    clash = documents([(1, " ".join(f"w{i}" for i in range(99)))])
    for name in ("signals", "doc", "fences", "kept", "words_", "base_failed"):
        clash = clash.withColumn(name, F.lit(name))
    kept = quality.drop_low_quality(clash)
    assert kept.columns == clash.columns and kept.count() == 1
    assert quality.judge(quality.measure(documents([]))).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    twin = con.sql(queries.ORACLE["op11_quality"])
    got = queries.QUERIES["op11_quality"](spark, sf_dir)
    assert sorted(tuple(r[c] for c in twin.columns) for r in got.collect()) == sorted(twin.fetchall())
