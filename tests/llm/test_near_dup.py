"""Near duplicates against all pairs."""

import random
import re

import pytest

from adtide.llm import near_dup, queries
from adtide.llm.components import components


def sets_of(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain(rows, words=4):
    """(n_shingles, component) by comparing all pairs; keys are distinct."""
    sets = [(i, sets_of(t, words)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b) if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) else 0
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: (len(s), top(i)) for i, s in sets}


def same(spark, rows):
    got = near_dup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, comp string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows)
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op10_near_duplicates"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows)


def test_hot_groups_passages_and_short_texts(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(3000)]
    base = rng.choices(words, k=90)
    passage = rng.choices(words, k=30)
    rows = []
    for n in range(160):  # a large group of near copies: some link to few others only
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(90)] = rng.choice(words)
        rows.append((n, " ".join(own)))
    rows += [(200 + n, " ".join(passage + rng.choices(words, k=rng.choice((8, 30, 60))))) for n in range(150)]
    for n in range(60):
        own = rng.choices(words, k=rng.randint(2, 40))
        rows += [(400 + 3 * n, " ".join(own)), (401 + 3 * n, " ".join(own[:-1])), (402 + 3 * n, " ".join(own).upper())]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE\n"), (905, "one "), (906, "É b c d"), (907, "é b c d"), (908, " ".join(rng.choices(words, k=20_000)))]
    rng.shuffle(rows)
    same(spark, rows)


def test_passage_that_is_most_of_many_short_texts(spark):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(5000)]
    passage = rng.choices(words, k=60)
    rows = [(n, " ".join(passage + rng.choices(words, k=25))) for n in range(500)]
    for n in range(0, 60, 3):  # links among them: one word changed at the end, some twice
        own = rows[n][1].split()
        own[-1 - n % 5] = "other"
        rows.append((600 + n, " ".join(own)))
        own[60] = "another"
        rows.append((601 + n, " ".join(own)))
    rows += [(700 + n, " ".join(passage + rng.choices(words, k=k))) for n, k in enumerate((1, 2, 4, 8, 12, 14, 15, 16, 18))]  # most of these are linked by the passage alone
    rng.shuffle(rows)
    same(spark, rows)


def test_null_and_repeated_keys(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "alone text of no other row"), (2, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = near_dup.drop_near_duplicates(spark.createDataFrame([(3, "a b c d e"), (4, "A b c d e"), (None, "a b c d e")], "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None"]


@pytest.mark.parametrize("order", [1, -1])
def test_components_of_a_long_chain(spark, order):
    links = [(order * n, order * (n + 1)) for n in range(300)] + [(5000, 5001), (5001, 5001), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = min(0, order * 300)
    assert got == {**{order * n: low for n in range(301)}, 5000: 5000, 5001: 5000}


def test_components_of_chains_of_shuffled_ids(spark):
    rng = random.Random(11)
    chains = [list(range(1_000, 1_200)), rng.sample(range(10_000, 90_000), 2_000), [200_000 + n + (n % 2) * 100_000 for n in range(64)]]
    chains[0].insert(100, 999)  # the smallest stands inside; the next smallest at an end
    links = [pair for chain in chains for pair in zip(chain, chain[1:])]
    links += [(500_000 + n, 600_000 + n // 7) for n in range(70)] + [(600_000 + n, 600_001 + n) for n in range(0, 9, 2)]
    rng.shuffle(links)
    want = {}
    for a, b in links:
        want.setdefault(a, {a}), want.setdefault(b, {b})
    for a, b in links:
        if want[a] is not want[b]:
            small, big = sorted((want[a], want[b]), key=len)
            big |= small
            for n in small:
                want[n] = big
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.comp for r in got} == {n: min(group) for n, group in want.items()}
