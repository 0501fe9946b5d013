"""Personal data against a plain version, and discovery by context."""

import hashlib
import re

from adtide.llm import pii, queries, secrets

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (2 if n % 2 else 1) for n, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


TEXTS = [
    None, "", "a@b.c_d@e.f x@y z@@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 12", "+1 (310) 555-4510. +12 +1((((", "é" * 9 + " q@r.st",
    "7" * 2_000, "a" * 3_000 + "@", "b@c" + ".d" * 3_000, "1 " * 2_000, "++1 2345678901+44 20 7946 0958",
]


def test_query_equals_plain_search(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_edge_texts(documents):
    rows = pii.find_pii(documents(list(enumerate(TEXTS)) + [(2, TEXTS[2])])).orderBy("doc_id")
    got = rows.select("doc_id", secrets.spans_text(pii.KINDS, "pii_", by_start=False).alias("s")).collect()
    assert [(r.doc_id, r.s) for r in got] == sorted((n, ",".join(plain(TEXTS[n]))) for n in [*range(len(TEXTS)), 2])
    assert pii.find_pii(documents([])).count() == 0


def test_context_gives_away_unseen_identifiers(documents):
    known = [(n, f"Some words. Please call us {'' if n % 2 else 'now '}at phone number +1 (310) 555-45{n:02d} before noon today") for n in range(8)]
    docs = documents([*known, (50, "You may reach the desk at phone number (310) 555-9999 before noon"), (51, "The part is (310) 555-8888 in our list")])
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert [s.m for s in found[50].pii_more_phone] == ["(310) 555-9999"]
    assert not found[51].pii_more_phone and not found[0].pii_more_phone and len(found[0].pii_phone) == 1


def test_rounds_go_on_until_nothing_is_new(documents):
    # each level shares a context with the one before it only, and is found a round later
    rows, at = [], 0
    for depth, (count, left, right) in enumerate([(125, "desk alpha", "red zero"), (25, "desk alpha", "red one"), (5, "desk beta", "red one"), (1, "desk beta", "red two")]):
        for n in range(count):
            number = f"+1 (310) 555-{at:04d}" if not depth else f"(310) 555-{at:04d}"
            rows.append((at, f"Some text here {left} {number} {right} and more text"))
            at += 1
    found = {r.doc_id: [s.m for s in r.pii_more_phone] for r in pii.find_pii(documents(rows)).collect()}
    assert all(found[n] == [f"(310) 555-{n:04d}"] for n in range(125, at))


def test_identifiers_and_words_of_any_length(documents):
    word = "w" * 120
    known = [(n, f"mail {word} address user{n}@site.org {word} for details") for n in range(8)]
    more = [f"{'n' * 70}@localhost", f"{'n' * 9}@{'h' * 400}"]
    docs = documents([*known, *[(50 + n, f"{'- ' * 3000}{word} address {m} {word} for") for n, m in enumerate(more)], (60, f"{word[1:]} address other@localhost {word[1:]} for")])
    found = {r.doc_id: [s.m for s in r.pii_more_email] for r in pii.find_pii(docs).collect()}
    assert [found[50], found[51], found[60]] == [[more[0]], [more[1]], []]


def test_runs_of_digits_and_words_without_end(documents):
    texts = ["7 " * 100_000, "7" * 300_000, "(" * 100_000 + "1", "1-" * 100_000, "a" * 300_000 + " 1.2.3.4 " + "b" * 300_000, "x" * 200_000 + "(at)yyy", " " * 200_000 + "1-2-3-4"]
    found = pii.find_pii(documents(list(enumerate(texts)))).orderBy("doc_id").select("pii_ip").collect()
    assert [len(r.pii_ip) for r in found] == [0, 0, 0, 0, 1, 0, 0]


def test_recall_and_precision_on_planted_contexts(documents):
    contexts = {
        "phone": ("call our office line {} during working hours", "+1 (310) 555-01{:02d}", "(310) 555-77{:02d}"),
        "email": ("write to our contact {} for more details", "user{}@site.org", "name{}@localhost"),
        "ip": ("the host with address {} did respond late", "10.0.0.{}", "10-0-7-{}"),
    }
    others = ("part list number {} from an old catalogue", "the {} was seen again")
    rows, want, at = [], set(), 0
    for kind, (context, known, unseen) in contexts.items():
        for n in range(24):
            rows.append((at := at + 1, "Some text. Please " + context.format(known.format(n)) + ". End."))
        for n in range(8):
            rows.append((at := at + 1, "Other words, " + context.format(unseen.format(n)) + " and so on"))
            want.add((at, kind, unseen.format(n)))
        for n in range(20, 40):  # the same forms where nothing is known
            rows.append((at := at + 1, others[n % 2].format(unseen.format(n))))
    got = {(r.doc_id, k, s.m) for r in pii.find_pii(documents(rows)).collect() for k in pii.KINDS for s in r["pii_more_" + k]}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_columns_with_the_operators_names(spark):
    docs = spark.createDataFrame([(1, "me@x.org", "a", "b", "c")], "doc_id long, text string, pii_text string, pii_doc string, pii_doc_own string")
    row = pii.find_pii(docs).first()
    assert (row.pii_text, row.pii_doc, row.pii_doc_own) == ("a", "b", "c") and row.pii_email[0].m == "me@x.org"
