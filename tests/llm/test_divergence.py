"""Source divergence against a plain Python version and its SQL twin."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from adtide.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def price(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows):
    """rows of (text, lang, source) -> the rows of the audit."""
    counts, holding, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(FOLD))
        groups.add((lang, source))
        counts[lang, source].update(words)
        holding[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holding[lang].items() if n >= divergence.LEAST_DOCUMENTS]
        sources = [s for g, s in groups if g == lang]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(price(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-price(of[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > whole[t])
            out |= {(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(terms[: divergence.TOP], 1)}
    return out


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, v int")
    out = divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(out) == len({tuple(r) for r in out})
    return {tuple(r) for r in out}


def corpus(seed, sources=9):
    r = random.Random(seed)
    vocabulary = ["Wort", "été", "日本", "ÄÖ", "don't", "a1b", "x" * 300, *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))]
    rows = []
    for _ in range(220):
        source = f"s{min(r.randrange(sources), r.randrange(sources))}"
        words = [vocabulary[min(r.randrange(len(vocabulary)), r.randrange(len(vocabulary)))] for _ in range(r.randrange(60))]
        rows.append((" ".join(words), r.choice(["en", "de", None]), source))
    return [*rows, *rows[:5], (None, "en", "s0"), ("", None, None), ("Z " * 20000, "en", "s1"), (None, "xx", "a"), ("rare", "xx", "b"), ("12 34", "en", "lonely")]


@pytest.mark.parametrize("options", [{}, {"term_block": 16, "source_block": 2}, {"term_block": 50, "source_block": 100}])
def test_equals_plain_whatever_the_blocks(spark, options):
    rows = corpus(3)
    assert audited(spark, rows, **options) == plain(rows)


def test_products_in_many_column_blocks(monkeypatch):
    r = random.Random(5)
    sources = [f"s{k}" for k in range(7)]
    rows = [("en", 0, 0, 1, s, None, 0, 5 + k, int(k > 3)) for k, s in enumerate(sources)]
    rows += [("en", 0, 0, 1, s, f"t{t}", n, 10 * n + k, int(k > 3)) for k, s in enumerate(sources) for t in range(40) if (n := r.randrange(12))]
    frame = pd.DataFrame(rows, columns=["lang", "block", "i", "j", "source", "term", "n", "p", "own"])
    whole = divergence._joint_prices(frame)
    monkeypatch.setattr(divergence, "ROWS", 7)
    monkeypatch.setattr(divergence, "COLUMNS", 9)
    small = divergence._joint_prices(frame)
    assert sorted(map(tuple, whole.values.tolist())) == sorted(map(tuple, small.values.tolist()))
    shares = {s: dict.fromkeys({f"t{t}" for t in range(40)} & set(frame["term"].dropna()), 5 + k) for k, s in enumerate(sources)}
    for row in frame[frame["term"].notna()].itertuples():
        shares[row.source][row.term] = row.p
    want = {(a, b): sum(price(shares[a][t], shares[b][t]) for t in shares[a]) for a in sources[:4] for b in sources[4:]}
    assert {(a, b): v for _, a, b, v, _ in whole.values.tolist()} == want | {(b, a): v for (a, b), v in want.items()}


def test_counts_are_passed_on_in_parts(spark, documents):
    held = divergence.HELD_TERMS
    text = " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(held + 10))
    rows = divergence.term_counts(documents([(1, text, "en", "s"), (2, text, "en", "s"), (3, "aaaaa", "en", "s")]).coalesce(1))
    assert rows.filter("n <> 2 or docs <> 2").collect()[0][2:] == ("aaaaa", 3, 3)
    assert rows.count() == held + 10


def test_empty(spark):
    assert audited(spark, []) == set()


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    twin = con.sql(queries.ORACLE["op12_divergence"])
    got = queries.QUERIES["op12_divergence"](spark, sf_dir)
    assert sorted(tuple(r[c] for c in twin.columns) for r in got.collect()) == sorted(twin.fetchall())
