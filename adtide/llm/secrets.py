"""Secrets in text: fixed patterns, and tokens of high sliding-window entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtide.llm.spans import SPAN, bound, found, free_name

#: Fixed patterns.  A run that ends a pattern is possessive, so long runs need no stack; matches are the same.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy search, and the allow-list that clears them.
TOKEN = r"(?:(?<![A-Za-z0-9+/_=-])|\G)[A-Za-z0-9+/_-]{20,}+={0,2}+"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # UUIDs
    r"^sha(1|256|384|512)-",  # integrity values
    r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh",  # samples
    r"^[A-Za-z0-9]{0,15}+(?:[/_-][A-Za-z0-9]{0,15}+)++$",  # paths and names of short parts
)
#: Characters of each class, the least entropy of a window in bits per character, and what a token of the class must hold.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-="
WINDOW = 20
CLASSES = {"hex": (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), "alphanumeric": (r"^[0-9A-Za-z]+$", 3.8), "base64": (r"^[0-9A-Za-z+/_=-]+$", 3.9)}


def window_entropy(token: str, window: int = WINDOW) -> str:
    """SQL for the highest Shannon entropy (bits per character) of any
    ``window`` characters of ``token``, 0 if it is shorter.

    One pass: counts per character change by the character that enters and the
    one that leaves, and so does the sum of c*log2(c) that the entropy needs.
    """
    size = len(ALPHABET) + 1
    count = "element_at(s.counts, {} + 1)"
    c, d = count.format("x.i"), "element_at(s.counts, x.o + 1) + if(x.o = x.i, 1, 0)"
    f = "if({0} > 1, ({0}) * log2({0}), 0D)".format
    codes = f"transform(split({token}, ''), ch -> instr('{ALPHABET}', ch))"
    steps = f"transform(cs, (i, n) -> named_struct('i', i, 'o', if(n >= {window}, element_at(cs, n + 1 - {window}), -1), 'n', n + 1))"
    steps = bound(codes, "cs", steps, "array<struct<i:int,o:int,n:int>>")
    total = f"s.total + {f(f'({c} + 1)')} - {f(c)} + if(x.o < 0, 0D, {f(f'({d} - 1)')} - {f(f'({d})')})"
    # the state's total is needed twice, so it is bound by an inner aggregate
    return f"""aggregate({steps}, named_struct('counts', array_repeat(0, {size}), 'total', 0D, 'best', 0D),
      (s, x) -> aggregate(array({total}), s, (y, t) -> named_struct(
        'counts', transform(s.counts, (c, j) -> c + if(j = x.i, 1, 0) - if(j = x.o, 1, 0)), 'total', t,
        'best', if(x.n >= {window}, greatest(s.best, log2({window}D) - t / {window}D), s.best))),
      s -> s.best)"""


def _entropy_spans(text: str, taken: str) -> Column:
    """Tokens of a mixed class whose window entropy reaches the level of the class, outside of spans ``taken``."""
    level = "case " + " ".join(f"when t.m rlike r'{p}' then {low}D" for p, low in CLASSES.values()) + " else 9D end"
    clear = " and ".join(f"not t.m rlike r'{p}'" for p in ALLOWED)
    free = "not exists(taken, k -> k.a < t.b and t.a < k.b)"
    keep = f"length(t.m) >= {WINDOW} and t.m rlike '[0-9]' and t.m rlike '[A-Za-z]' and {clear} and {free}"
    tokens = f"filter({text}, t -> {keep})"
    return F.expr(bound(taken, "taken", f"filter({tokens}, t -> {window_entropy('t.m')} >= {level})", f"array<{SPAN}>"))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add to each row of ``docs`` the arrays ``secret_assign``, ``secret_access``, ``secret_hex`` and
    ``secret_entropy`` of (a, b, m): first code point, code point past the last, matched text.

    The first three hold the fixed patterns (an assignment needs a value of 8
    or more characters, an access key 16, a hex run 32).  The last holds further
    candidate tokens: of each, the Shannon entropy of every window of
    ``WINDOW`` characters is followed by counts, and the highest decides by a
    level per character class.  A token must mix letters and digits, overlap no
    fixed match and match no pattern of the allow-list.

    One projection without a shuffle.  A null text counts as empty: no spans.
    A column of ``docs`` named as one of the four is replaced.  Repeated rows
    give the same spans each; an empty table stays empty.
    """
    own = free_name("secret_text", docs.columns)
    body = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    low = f"{own} rlike '(?i)(?:pass|secret|token|api_?key)'"
    value = f"length(regexp_extract(x.m, {_sql(ASSIGN_VALUE)}, 1)) >= 8"
    spans = body.withColumns({
        "secret_assign": found(own, ASSIGN, low),
        "secret_access": found(own, ACCESS, f"contains({own}, 'AKIA')"),
        "secret_hex": found(own, HEX),
        "secret_entropy": found(own, TOKEN),
    }).withColumn("secret_assign", F.expr(f"filter(secret_assign, x -> {value})"))
    taken = "concat(secret_assign, secret_access, secret_hex)"
    return spans.withColumn("secret_entropy", _entropy_spans("secret_entropy", taken)).drop(own)


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def spans_text(kinds: tuple[str, ...], prefix: str, by_start: bool) -> Column:
    """``kind:start:end`` of the arrays named ``prefix`` + kind, comma-joined, by kind and start or by start and kind."""
    one = "transform({0}{1}, x -> named_struct('p', {2}, 'q', {3}, 't', concat('{1}:', x.a, ':', x.b)))"
    parts = [one.format(prefix, k, *(("x.a", n) if by_start else (n, "x.a"))) for n, k in enumerate(kinds)]
    return F.expr(f"array_join(transform(array_sort(concat({', '.join(parts)})), x -> x.t), ',')")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret that :func:`find_secrets` sees replaced by ``mask``.

    Overlapping spans become one.  Rows without a secret, and null texts, stay
    as they are; where a text changes, ``n_chars`` (if there is such a column)
    is set to its new length.
    """
    columns = docs.columns
    # the row travels as one struct, so no column can clash with the spans
    marked = find_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text")), "text")
    spans = "array_sort(concat(secret_assign, secret_access, secret_hex, secret_entropy))"
    # walk the spans by start: copy the text before each, skip what a former span has covered
    walk = f"""aggregate({spans}, named_struct('at', 0, 'out', ''), (s, x) -> if(x.a < s.at,
        named_struct('at', greatest(s.at, x.b), 'out', s.out),
        named_struct('at', x.b, 'out', concat(s.out, substring(text, s.at + 1, x.a - s.at), '{mask}'))),
      s -> concat(s.out, substring(text, s.at + 1)))"""
    any_ = F.expr("size(secret_assign) + size(secret_access) + size(secret_hex) + size(secret_entropy) > 0")
    out = marked.select("row", any_.alias("any"), F.when(any_, F.expr(walk)).otherwise(F.col("text")).alias("new"))
    changed = {text: F.col("new")}
    if n_chars in columns:
        kind = docs.schema[n_chars].dataType
        changed[n_chars] = F.when(F.col("any"), F.char_length("new").cast(kind)).otherwise(F.col("row")[n_chars])
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


__all__ = ["KINDS", "SPAN", "find_secrets", "redact", "spans_text", "window_entropy"]
