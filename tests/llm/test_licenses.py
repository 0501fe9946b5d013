"""Licence scan against an unpruned comparison."""

from adtide.llm import licenses, queries


def plain(text):
    """All segments against all templates, no pruning; the operator's choice among overlapping ones."""
    hits = []
    for a, b in licenses.segments(text or ""):
        grams = licenses.bigrams(text[a:b])
        for name, template in licenses.TEMPLATES:
            other = licenses.bigrams(template)
            size = sum(grams.values()) + sum(other.values())
            d = 2 * sum((grams & other).values()) / size
            if d >= 0.8:
                hits.append((-d, a - b, a, name, b))
    out = []
    for d, _, a, name, b in sorted(hits):
        if all(b <= x or y <= a for x, y, *_ in out):
            out.append((a, b, name, -d))
    return sorted(out)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sorted((r.doc_id, r.start, r.end, r.license, r.dice) for r in queries.QUERIES["op8_licenses"](spark, sf_dir).collect())
    assert got == sorted((i, *h) for i, t in texts.items() for h in plain(t))


def test_edges(documents):
    mit = licenses.TEMPLATES[4][1]
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70)).replace("NON\nINFR", "NONINFR")
    texts = [None, "", "word", "spdx-license-identifier:mit", f"Code.\n\n{mit}\n\nMore.", wrapped, "x. Released under the MIT licence. y", "Licensed under CC BY 4.0.\nAll rights reserved.", "one two " * 50_000 + "\nAll rights reserved."]
    rows = licenses.find_licenses(documents([*enumerate(texts), (6, texts[6])])).collect()
    got = sorted((r.doc_id, r.start, r.end, r.license, r.dice) for r in rows)
    assert got == sorted((n, *h) for n in [*range(len(texts)), 6] for h in plain(texts[n]))
    assert {(n, name) for n, *_, name, _ in got} >= {(3, "MIT"), (4, "MIT"), (5, "MIT"), (6, "MIT"), (7, "CC-BY-4.0"), (7, "all-rights-reserved")}
    assert licenses.find_licenses(documents([])).count() == 0


def test_runs_of_paragraphs_and_wrapped_sentences():
    mit = licenses.TEMPLATES[4][1]
    a, b = mit.index("The above copyright"), mit.index("THE SOFTWARE IS")
    three = "\n\n".join("\n".join(part[i : i + 72] for i in range(0, len(part), 72)) for part in (mit[:a].strip(), mit[a:b].strip(), mit[b:]))
    matcher = licenses.Matcher()
    before, after = "A tool to sort files.\n\nCopyright (c) 2020 Some One\n\n", "\n\nimport os\nprint(os.name)\n"
    ((start, end, name, dice),) = matcher.scan(before + three + after)
    assert (name, start, end) == ("MIT", len(before), len(before) + len(three)) and dice > 0.9
    notice = "This work is licensed under the GNU\nGeneral Public License, version 3."
    text = f"We wrote this over years. {notice} Please read\non from here to the end of it."
    assert [h[:3] for h in matcher.scan(text)] == [(26, 26 + len(notice), "GPL-3.0")]
    assert [h[2] for h in matcher.scan(f"{three}\n\n{'Other words stand here. ' * 300}\n\n{three}")] == ["MIT", "MIT"]


def test_whole_bsd_texts():
    by_size = sorted((len(t), name, t) for name, t in licenses.TEMPLATES if name.startswith("BSD"))
    matcher = licenses.Matcher()
    for _, name, text in by_size[-2:]:
        lines = "\n".join(text[i : i + 75] for i in range(0, len(text), 75))
        ((start, end, found, dice),) = matcher.scan(f"Copyright (c) 2020, Some One\n\n{text}\n\nint main() {{}}")
        assert found == name and dice == 1.0 and end - start == len(text)
        assert [h[2] for h in matcher.scan(lines)] == [name]
    assert by_size[-1][1] == "BSD-3-Clause" and by_size[-2][1] == "BSD-2-Clause"
    conditions = by_size[-1][2].split(" THIS SOFTWARE")[0]
    assert [h[2] for h in matcher.scan(conditions.replace(" 2. ", "\n2. ").replace(" 3. ", "\n3. "))] == ["BSD-3-Clause"]
