"""Matches of a pattern with their places, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<a:int,b:int,m:string>"


def bound(value: str, name: str, body: str, kind: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, worked out once.

    The optimizer may put a projected expression in place of its name, inside
    of lambdas too, and would then work it out for each element.  ``kind`` is
    the type of the array that ``body`` gives.
    """
    return f"aggregate(array({value}), cast(array() as {kind}), (unused_, {name}) -> {body})"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"'


def found(text: str, pattern: str, hint: str = "true") -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in column ``text``: an
    array of (first code point, code point past the last, matched text).

    ``hint`` is a cheap SQL condition without which there can be no match.  The
    places follow from the lengths of the pieces between the matches.
    """
    p = _quoted(pattern)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0))"
    at = "s.at + length(x.`0`)"
    walk = f"""aggregate({zipped}, named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
      (s, x) -> named_struct('at', {at} + coalesce(length(x.`1`), 0), 'out',
        if(x.`1` is null, s.out, concat(s.out, array(named_struct('a', {at}, 'b', {at} + length(x.`1`), 'm', x.`1`))))),
      s -> s.out)"""
    return F.expr(f"case when ({hint}) and {text} rlike {p} then {walk} else cast(array() as array<{SPAN}>) end")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with marks at its end until no column of ``taken`` has it (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
