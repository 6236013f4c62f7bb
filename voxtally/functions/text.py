"""Unicode normalisation and term patterns."""

from __future__ import annotations

import unicodedata

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normal_form(text: str) -> str:
    """Compatibility composition, case folding, white space to single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def _normal_forms(texts: pd.Series) -> pd.Series:
    return texts.map(normal_form, na_action="ignore")


def normalized(text: Column) -> Column:
    """normal_form as a column. ASCII text stays in the JVM; Python only gets the other rows, nulls for the rest."""
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    native = F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x1C-\x20]+", " "))
    other = F.pandas_udf(_normal_forms, StringType())(F.when(~ascii_only, text))
    return F.when(ascii_only, native).otherwise(other)


def quoted(term: str) -> str:
    """A term as a Java pattern that matches it alone."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def term_pattern(term: str) -> str:
    """An ASCII term stands between other characters than ASCII letters, digits and underscores; any other term anywhere.

    What stands before is looked at last, so that the search runs for the term's own characters."""
    own = quoted(term)
    return f"{own}(?<![A-Za-z0-9_]{own})(?![A-Za-z0-9_])" if term.isascii() else own


def any_pattern(terms: list[str]) -> str:
    return "|".join(map(term_pattern, terms))


def may_overlap(terms: list[str]) -> bool:
    """Whether matches of two terms, or of one with another's inside, can share characters: a term's end is another's beginning, or
    one stands in the other. The time is that of all beginnings and ends, not of all pairs."""
    terms = list(dict.fromkeys(terms))
    begins: dict[str, set[int]] = {}
    for i, term in enumerate(terms):
        for n in range(1, len(term)):
            begins.setdefault(term[:n], set()).add(i)
    if any(begins.get(term[-n:], set()) - {i} for i, term in enumerate(terms) for n in range(1, len(term))):
        return True
    inner = ahocorasick.Automaton()
    for term in terms:
        inner.add_word(term, len(term))
    inner.make_automaton()
    return any(size < len(term) for term in terms for _, size in inner.iter(term))
