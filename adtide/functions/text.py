"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze_spaces(text: Column) -> Column:
    """Trim and collapse every run of (Unicode) white space to one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# Stands for "a word starts here" while the text is being capitalised.
_MARK = "\u0001 "


def title_case(text: Column) -> Column:
    """Upper-case the first letter after any non-letter, lower-case the rest.

    ``initcap`` starts words at blanks only, so a marked blank is put before
    every letter that follows a non-letter and taken out again afterwards.
    """
    marked = F.regexp_replace(text, r"(?<=[^\p{L}])(?=\p{L})", _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def clean_campaign_name(name: Column) -> Column:
    return title_case(squeeze_spaces(name))
