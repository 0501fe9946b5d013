"""Quality rules whose thresholds come from quantile sketches per language and source.

A sketch is a table of counts per bin.  Bins have a constant relative width, so a
group has a bounded number of them whatever its size; sketches of parts of a
group are merged by adding counts, in any order, with one result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtide.llm.spans import bound
from adtide.llm.staging import settle

#: White space between words, and the characters counted as symbols (fixed by the rule).
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The fixed part of the verdict: fewest words, and most repeated words of a hundred.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Bins of a sketch per doubling of the value: a quantile is wrong by a 64th at most.
BINS = 64
#: A source's sketch is mixed with its language's, which weighs as much as so many documents.
PRIOR = 100
#: Fences stand so many quartile distances outside of the quartiles.
REACH = 3
#: Rows of fences that may be sent to all tasks; more are joined by shuffle.
BROADCAST_FENCES = 100_000


@dataclass(frozen=True)
class Rule:
    """A measure (SQL over the signals, a whole number), the least quartile
    distance taken for it, and which of its two sides has a fence."""

    name: str
    measure: str
    spread: int
    low: bool
    high: bool


RULES = (
    Rule("word_length", "word_chars * 100 div n_words", 50, True, True),
    Rule("symbols", "n_symbols * 1000 div n_words", 20, False, True),
    Rule("dup_lines", "n_dup_lines * 1000 div greatest(n_lines, 1)", 100, False, True),
    Rule("repeats", "n_repeat_words * 1000 div n_words", 100, False, True),
)


def _signals(text: Column, words: str) -> Column:
    """The signals of one text, whose words are in the column ``words``, as a struct of longs."""
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        *_lines(text),
        _repeated(words).cast("long").alias("n_repeat_words"),
    )


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _lines(text: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")]


def _repeated(words: str) -> Column:
    """Words inside of three-word windows that the text holds twice or more.

    Windows are sorted by hash and place, so equal ones are neighbours; the
    words decide whether neighbours of one hash are equal."""
    same = "coalesce(get(s, {0}).h = get(s, {1}).h and get(w, get(s, {0}).i) = get(w, get(s, {1}).i)" \
           " and get(w, get(s, {0}).i + 1) = get(w, get(s, {1}).i + 1) and get(w, get(s, {0}).i + 2) = get(w, get(s, {1}).i + 2), false)"  # fmt: skip
    places = f"sort_array(transform(filter(s, (e, k) -> {same.format('k', 'k - 1')} or {same.format('k', 'k + 1')}), e -> e.i))"
    covered = f"aggregate({places}, named_struct('n', 0, 'end', 0), (a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.end), 'end', i + 3), a -> a.n)"
    counted = bound("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "s", f"array({covered})", "array<int>")
    windows = "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))"
    some = bound(windows, "h", f"case when size(array_distinct(h)) = size(h) then array(0) else {counted} end", "array<int>")
    return F.expr(bound(words, "w", f"case when size(w) < 4 then array(0) else {some} end", "array<int>") + "[0]")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc, signals)``: the row of ``docs`` as one struct, so that no name can
    clash, and the signals of its whole text (null: no words, no characters)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    rows = rows.withColumn("words_", _words(body))
    return rows.select("doc", _signals(body, "words_").alias("signals"))


def _bin(value: str) -> str:
    size = BINS.bit_length()
    shift = f"length(bin({value})) - {size}"
    return f"case when {value} < {2 * BINS} then {value} else {BINS} * ({shift}) + shiftright({value}, {shift}) end"


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, rule, bin, n)``: the sketch of each rule's measure, of all documents with a word."""
    entries = ", ".join(f"named_struct('rule', '{r.name}', 'v', {r.measure})" for r in RULES)
    rows = measured.select(*_group(lang, source), "signals.*").filter("n_words > 0").selectExpr("lang", "source", f"inline(array({entries}))")
    return rows.groupBy("lang", "source", "rule", F.expr(_bin("v")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col("doc")[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]


def fences(sketch: DataFrame) -> DataFrame:
    """``(lang, source, fences)``: per rule its lowest and highest passing measure, as a map from the rule's name.

    Quartiles are read from the source's sketch plus its language's, scaled to
    ``PRIOR`` documents: a source of few documents follows its language, a large
    one itself, and nothing switches between the two.  Weights are whole numbers.
    """
    sketch = settle(sketch, "sketches")
    whole = settle(sketch.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")), "language-sketches")
    totals = whole.groupBy("lang", "rule").agg(F.sum("n").cast("decimal(19,0)").alias("all"))
    sources = sketch.select("lang", "source").distinct()
    own = sketch.join(totals, ["lang", "rule"]).select("lang", "source", "rule", "bin", (F.col("n").cast("decimal(18,0)") * F.col("all")).alias("weight"))
    prior = whole.join(sources, "lang").select("lang", "source", "rule", "bin", (F.col("n") * F.lit(PRIOR)).cast("decimal(38,0)").alias("weight"))
    mixed = own.unionByName(prior).groupBy("lang", "source", "rule", "bin").agg(F.sum("weight").cast("decimal(36,0)").alias("weight"))
    group = Window.partitionBy("lang", "source", "rule")  # as many rows as a sketch has bins
    upto = mixed.withColumns({"upto": F.sum("weight").over(group.orderBy("bin")), "total": F.sum("weight").over(group)})
    low, high = "min(bin) filter (where upto * 4 >= total)", "min(bin) filter (where upto * 4 >= total * 3)"
    quarters = upto.groupBy("lang", "source", "rule").agg(F.expr(low).alias("q1"), F.expr(high).alias("q3"))
    edge = f"case when {{0}} < {2 * BINS} then bigint({{0}}) else shiftleft(bigint({{0}} - {BINS} * ({{0}} div {BINS} - 1)), int({{0}} div {BINS} - 1)) end"
    quarters = quarters.select("lang", "source", "rule", F.expr(edge.format("q1")).alias("low"), F.expr(edge.format("(q3 + 1)") + " - 1").alias("high"))
    spread = F.greatest(F.col("high") - F.col("low"), F.expr("case rule " + " ".join(f"when '{r.name}' then {r.spread}" for r in RULES) + " end").cast("long")) * REACH
    one = F.struct("rule", F.struct((F.col("low") - spread).alias("low"), (F.col("high") + spread).alias("high")))
    return quarters.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(one)).alias("fences"))  # an entry per rule


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``base_failed``, ``failed`` (names of the rules a document
    fails, adaptive ones) and ``kept``.

    Few fences are sent to all tasks; many are joined by shuffle, where adaptive
    execution splits a language and source of very many documents.  Null languages
    and sources count as ``''``.  A document without a word fails the base rule and
    no other, and is in no sketch.  Repeated rows count each, and an empty
    table gives none.
    """
    limits = settle(fences(sketches(measured, lang, source)), "fences")
    if limits.count() <= BROADCAST_FENCES:
        limits = F.broadcast(limits)
    rows = measured.select("doc", "signals", *_group(lang, source)).join(limits, ["lang", "source"], "left")
    parts = []
    for r in RULES:
        value = F.expr(r.measure.replace("n_", "signals.n_").replace("word_chars", "signals.word_chars"))
        limit = F.col("fences")[r.name]
        outside = F.lit(False)
        if r.low:
            outside = outside | (value < limit["low"])
        if r.high:
            outside = outside | (value > limit["high"])
        parts.append(F.when(outside, F.lit(r.name)))
    words, repeats = F.col("signals.n_words"), F.col("signals.n_repeat_words")
    base = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)
    failed = F.when(words > 0, F.array_compact(F.array(*parts))).otherwise(F.array().cast("array<string>"))
    judged = rows.select("doc", "signals", base.alias("base_failed"), failed.alias("failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def drop_low_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return judge(measure(docs, text), lang, source).filter("kept").select("doc.*")
