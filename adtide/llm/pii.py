"""Personal data in text: fixed patterns, then bootstrapped contextual extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.llm.spans import SPAN, bound, found, free_name
from adtide.llm.staging import settle

#: Fixed patterns.  Possessive runs and look-behinds only save backtracking; the matches are those of the plain forms.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: What may be an identifier the fixed patterns miss: a token with an at sign, or a run of seven or more characters
#: from digit to digit.  Runs are of any length and possessive, so a text is read once.
_JOIN = r"(?:[().:/-]|\x20(?=[(0-9]))*+"
CANDIDATE = (
    r"(?:(?<!\S)|\G)[^\s@]+(?:@|\(at\)|\[at\])[^\s@]{3,}+"
    rf"|(?<!\S)(?=[(+]?[0-9](?:[0-9().:/-]|\x20(?=[(0-9])){{5}}{_JOIN}[0-9])[(+]?[0-9](?:{_JOIN}[0-9])++(?![^\s.,;!?\x22\x27)\]])"
)
#: The form a candidate needs for a kind (``m`` is its text, ``d`` its number of digits).
FORMS = {
    "email": r"m rlike '(?i)(@|\\(at\\)|\\[at\\])[a-z0-9.-]+'",
    "ip": r"d between 4 and 12 and m rlike '^[0-9]{1,3}([.:-][0-9]{1,3}){3}$'",
    "card": r"d between 13 and 19 and m rlike '^[0-9][0-9 ./-]+[0-9]$'",
    "phone": r"d between 7 and 15 and m rlike '^[(+]?[0-9][0-9 ().-]+$' and m rlike '[ ().-]'",
}
#: A pattern is trusted with at least this many different known instances, making up at least this share of all its instances.
MIN_KNOWN = 3
MIN_CONFIDENCE = 0.6
#: An instance is accepted when its trusted patterns fail to name it with at most 1 - this chance.
MIN_SCORE = 0.8
#: Characters beside an identifier in which its two words are sought first; where they do not end there, the next
#: size is read, then the whole side of the text.  The words found are the same with any sizes.
_SIDES = (80, 4096)
#: Finds of up to so many bytes are sent to all tasks; more are joined by shuffle.
SENT_BYTES = 16_000_000
_WORD, _GAP = r"[^\s\pP\pS]", r"[\s\pP\pS]"


def _base(text: str) -> dict[str, Column]:
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    keep = {
        "email": "true",
        "ip": r"forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(p, 3) as int) <= 255)",
        "card": f"{digits} between 13 and 19 and luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
        "phone": f"{digits} between 9 and 15",
    }
    hints = {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')", "ip": "true", "card": f"{text} rlike '[0-9][\\\\x20-]?[0-9]'"}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    # kept spans of a kind: the failing ones are dropped, their places are not searched again
    return {k: (found(text, patterns[k], hints[k]), keep[k]) for k in KINDS}


def find_base(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """Add arrays ``pii_email``, ``pii_ip``, ``pii_card`` and ``pii_phone`` of (a, b, m) for the fixed patterns.

    A null text counts as empty.  One projection without a shuffle.
    """
    own = free_name("pii_text", docs.columns)
    body = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    parts = _base(own)
    body = body.withColumns({prefix + k: col for k, (col, _) in parts.items()})
    return body.withColumns({prefix + k: F.expr(f"filter({prefix}{k}, x -> {keep})") for k, (_, keep) in parts.items()}).drop(own)


def _text_key(text: str) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), F.col(text)).alias("g"))


def _beside(left: bool) -> tuple[Column, Column]:
    """The nearest and the next word to one side of span ``s`` of ``txt``, lower case, empty where there is none."""
    side = F.lower(F.expr("substring(txt, 1, s.a)" if left else "substring(txt, s.b + 1)"))
    for n in reversed(_SIDES):
        near = F.lower(F.expr(f"substring(txt, greatest(s.a - {n}, 0) + 1, least(s.a, {n}))" if left else f"substring(txt, s.b + 1, {n})"))
        ended = near.rlike(f"{_GAP}{_WORD}++{_GAP}++{_WORD}++{_GAP}*+$" if left else f"^{_GAP}*+{_WORD}++{_GAP}++{_WORD}++{_GAP}")
        side = F.when(ended, near).otherwise(side)
    # read away from the span, so that a search ends at the second word
    side = F.reverse(side) if left else side
    words = [F.regexp_extract(side, p, 1) for p in (f"^{_GAP}*+({_WORD}++)", f"^{_GAP}*+{_WORD}++{_GAP}++({_WORD}++)")]
    return tuple(F.reverse(w) for w in words) if left else tuple(words)


def _occurrences(docs: DataFrame, text: str) -> DataFrame:
    """One row per known or possible identifier with its two words to either side."""
    body = find_base(docs.select(_text_key(text).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("txt")), "txt")
    known = ", ".join(f"transform(pii_{k}, x -> named_struct('kind', '{k}', 'a', x.a, 'b', x.b, 'm', x.m))" for k in KINDS)
    body = body.withColumn("known", F.expr(f"concat({known})")).withColumn("cand", found("txt", CANDIDATE, "txt rlike '[0-9@]|\\\\(at\\\\)|\\\\[at\\\\]'"))
    free = "filter(cand, c -> not exists(own, k -> k.a < c.b and c.a < k.b))"
    every = f"concat(own, transform({free}, x -> named_struct('kind', cast(null as string), 'a', x.a, 'b', x.b, 'm', x.m)))"
    every = bound("known", "own", every, "array<struct<kind:string,a:int,b:int,m:string>>")
    # explode_outer: a filter on the array would be pushed below and find everything twice
    rows = body.select("doc", "txt", F.explode_outer(F.expr(every)).alias("s")).filter("s.m is not null")
    (l1, l2), (r1, r2) = _beside(left=True), _beside(left=False)
    rows = rows.select("doc", "s.kind", "s.a", "s.b", "s.m", l1.alias("l1"), l2.alias("l2"), r1.alias("r1"), r2.alias("r2"))
    l1, l2, r1, r2 = (F.col(c) for c in ("l1", "l2", "r1", "r2"))
    pats = [F.concat_ws(" ", F.lit(tag), x, y) for tag, x, y in (("L", l2, l1), ("R", r1, r2), ("B", l1, r1))]
    valid = [F.when((x != "") & (y != ""), p) for p, (x, y) in zip(pats, ((l2, l1), (r1, r2), (l1, r1)), strict=True)]
    d = F.length(F.regexp_replace("m", "[^0-9]", "")).alias("d")
    return rows.select("doc", "kind", "a", "b", "m", d, F.array_compact(F.array(*valid)).alias("patterns"))


def discover(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc, kind, a, b, m)``: identifiers that contexts of known ones give away; ``doc`` is a 128-bit hash of the text.

    The fixed patterns' matches are the seeds.  The words around an identifier
    are its lexical patterns (two to the left, two to the right, one on either
    side).  A round scores every (pattern, kind) by the share of known
    instances among all its different instances, trusts those with enough of
    both, and accepts a candidate of the kind's form whose trusted patterns
    together (noisy or) reach ``MIN_SCORE``; accepted ones are known in the next
    round.  Rounds go on until one accepts nothing.  Scores are aggregates over the pattern-instance links of the whole
    table, counted per distinct instance, so copies of a document add nothing.
    """
    seen = settle(_occurrences(docs, text), "identifiers")
    links = seen.select("m", "d", "kind", F.explode("patterns").alias("pattern")).distinct()
    links = settle(links, "patterns")
    accepted = None
    while True:
        now = links if accepted is None else links.join(accepted, "m", "left").select("m", "d", F.coalesce("kind", "new_kind").alias("kind"), "pattern")
        counts = now.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
        best = F.array_max(F.array(*[F.struct(F.col(k).alias("known"), F.lit(k).alias("k")) for k in KINDS]))
        trusted = counts.withColumn("best", best).select("pattern", F.col("best.k").alias("k"), F.col("best.known").alias("known"), (F.col("best.known") / F.col("n")).alias("conf"))
        trusted = trusted.filter((F.col("known") >= MIN_KNOWN) & (F.col("conf") >= MIN_CONFIDENCE))
        form = F.expr("case k " + " ".join(f"when '{k}' then {f}" for k, f in FORMS.items()) + " end")
        votes = now.filter("kind is null").join(trusted, "pattern").filter(form).groupBy("m", "k").agg((1 - F.product(1 - F.col("conf") + 1e-9)).alias("score"))
        fresh = votes.filter(F.col("score") >= MIN_SCORE).groupBy("m").agg(F.max_by("k", F.struct("score", "k")).alias("new_kind"))
        fresh = settle(fresh, "accepted")
        if fresh.isEmpty():
            break
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
    accepted = fresh if accepted is None else accepted
    return seen.filter("kind is null").join(accepted, "m").select("doc", F.col("new_kind").alias("kind"), "a", "b", "m")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add arrays ``pii_<kind>`` (fixed patterns) and ``pii_more_<kind>`` (found by context) of (a, b, m) to each row.

    A null text counts as empty and has no spans.  Columns with these names are
    replaced, others stay.  Equal texts (repeated rows among them) get equal
    spans; an empty table stays empty.
    """
    mine, other = free_name("pii_doc_own", docs.columns), free_name("pii_doc", docs.columns)
    finds = settle(discover(docs, text).distinct(), "finds")
    extra = finds.groupBy("doc").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("a", "b", "m")))).alias("pii_more_" + k) for k in KINDS]
    ).withColumnRenamed("doc", other)
    # copies of a text are not brought together for a few finds
    if (finds.agg(F.sum(F.octet_length("m") + 64)).first()[0] or 0) <= SENT_BYTES:
        extra = F.broadcast(extra)
    base = find_base(docs.drop(*["pii_more_" + k for k in KINDS]), text).withColumn(mine, _text_key(text))
    both = base.join(extra, F.col(mine) == F.col(other), "left").drop(mine, other)
    return both.withColumns({"pii_more_" + k: F.coalesce("pii_more_" + k, F.expr(f"cast(array() as array<{SPAN}>)")) for k in KINDS})
