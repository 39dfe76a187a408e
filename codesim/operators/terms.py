"""Counts of many watch terms at once, by one automaton.

``functions.text.term_count`` runs a regular expression for every term over every text, which is well for a handful of
terms.  Here all terms stand in one Aho-Corasick automaton, and a text is read once however many there are.  The
counts are those of the expressions: lower-cased text, letters equal under Unicode case folding, a match neither preceded nor
followed by a word character, and of a term's own matches those that don't overlap, from the left; matches of different terms
may overlap and count for each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: From this many terms on, the automaton takes less time than the expressions.
MANY = 16


@lru_cache(1 << 16)
def folded(c: str) -> str:
    """A character as a case-insensitive expression compares it: to upper and to lower case, where that is one character."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


@lru_cache(1 << 16)
def in_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def fold(text: str) -> str:
    return text if text.isascii() else "".join(map(folded, text))


class TermCounter:
    """Counts of ``terms``, in their order, in a lower-cased text."""

    def __init__(self, terms: tuple[str, ...]):
        import ahocorasick

        patterns: dict[str, int] = {}
        #: terms that differ in case only are one pattern
        self.pattern_of = [patterns.setdefault(fold(t.lower()), len(patterns)) for t in terms]
        self.automaton = ahocorasick.Automaton()
        for p, i in patterns.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.n = len(patterns)

    def counts(self, text: str) -> list[int]:
        text = fold(text)
        size, found, ends = len(text), [0] * self.n, [0] * self.n
        for last, (i, n) in self.automaton.iter(text):
            start = last + 1 - n
            if start >= ends[i] and (not start or not in_word(text[start - 1])) and (last + 1 == size or not in_word(text[last + 1])):
                found[i] += 1
                ends[i] = last + 1
        return [found[i] for i in self.pattern_of]


def term_counts(content: Column, terms: tuple[str, ...]) -> Column:
    """Array of the counts of ``terms`` in ``content``; null for null."""

    @pandas_udf("array<bigint>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TermCounter(terms)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else counter.counts(t))

    return counted(F.lower(content))
