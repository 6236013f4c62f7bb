"""Every occurrence of any number of spellings in one pass over a text, and the spans that stay."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an ASCII spelling may not stand beside.
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")

#: A normalised spelling, its term's place in the dictionary and its own place in the term.
Spelling = tuple[str, int, int]


class Matcher:
    """An Aho-Corasick automaton over normalised spellings: a text costs its length and its matches, however many spellings there are."""

    def __init__(self, spellings: Iterable[Spelling]):
        owners: dict[str, list[tuple[int, int]]] = {}
        for form, term, place in spellings:
            owners.setdefault(form, []).append((term, place))
        self.automaton = ahocorasick.Automaton()
        for number, (form, of) in enumerate(owners.items()):
            if form:
                self.automaton.add_word(form, (number, len(form), form.isascii(), of))
        self.automaton.make_automaton()

    def spans(self, text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """start, end and owners of each spelling's occurrences, which are found from the left and don't overlap with themselves."""
        last: dict[int, int] = {}
        for at, (number, size, ascii_only, of) in self.automaton.iter(text) if len(self.automaton) else ():
            start, end = at + 1 - size, at + 1
            if ascii_only and (start and text[start - 1] in _WORD or end < len(text) and text[end] in _WORD):
                continue
            if start >= last.get(number, 0):
                last[number] = end
                yield start, end, of

    def counts(self, text: str) -> dict[tuple[int, int], int]:
        """How often each spelling (term, place) stands in the text."""
        found: dict[tuple[int, int], int] = {}
        for _, _, of in self.spans(text):
            for own in of:
                found[own] = found.get(own, 0) + 1
        return found

    def kept(self, text: str, resolve: bool = True) -> dict[int, list[int]]:
        """For each term that the text names, the places of its spellings that keep a span (without `resolve`: none), in order."""
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, of in self.spans(text):
            for term, place in of:
                spans.setdefault(term, []).append((start, end, place))
        return {term: kept_places(spans[term], len(text)) if resolve else [] for term in sorted(spans)}


def kept_places(spans: Sequence[tuple[int, int, int]], length: int) -> list[int]:
    """Of one term's spans (start, end, place) in a text the places of those that stay: longer spans first, then those further left,
    then earlier spellings. What already stays is at least as long, so it covers an end of any span that it overlaps; each character is
    marked once."""
    places = {place for _, _, place in spans}
    if len(places) == 1:
        return list(places)
    taken, kept = bytearray(length), set()
    for start, end, place in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if not taken[start] and not taken[end - 1]:
            taken[start:end] = b"\x01" * (end - start)
            kept.add(place)
    return sorted(kept)


_BUILT: dict[str, Matcher] = {}


def _built(key: str, spellings: Sequence[Spelling]) -> Matcher:
    """One matcher for a Python worker, which keeps the last two: entities and topics take turns."""
    if key not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Matcher(spellings)
    return _BUILT[key]


def _over(text: Column, spellings: Sequence[Spelling], kind: pa.DataType, ddl: str, one: Callable[[Matcher, str], list]) -> Column:
    key = hashlib.sha256(repr(spellings).encode()).hexdigest()

    def run(texts: pa.Array) -> pa.Array:
        matcher = _built(key, spellings)
        return pa.array((one(matcher, t.as_py()) if t.is_valid else [] for t in texts), kind)

    return F.arrow_udf(run, ddl)(text)


_HIT = pa.list_(pa.struct([("ord", pa.int32()), ("spellings", pa.list_(pa.string()))]))
_COUNT = pa.list_(pa.struct([("ord", pa.int32()), ("place", pa.int32()), ("n", pa.int64())]))


def hits(text: Column, spellings: Sequence[Spelling], names: dict[tuple[int, int], str], resolve: bool) -> Column:
    """Structs (ord, spellings that keep a span) of the terms that a normalised text names, in dictionary order; none for null."""
    return _over(
        text, spellings, _HIT, "array<struct<ord:int,spellings:array<string>>>",
        lambda matcher, t: [{"ord": term, "spellings": [names[term, p] for p in places]} for term, places in matcher.kept(t, resolve).items()],
    )


def counts(text: Column, spellings: Sequence[Spelling]) -> Column:
    """Structs (ord, place, n) of the spellings that stand in a normalised text; none for null."""
    return _over(text, spellings, _COUNT, "array<struct<ord:int,place:int,n:bigint>>", lambda matcher, t: [{"ord": o, "place": p, "n": n} for (o, p), n in matcher.counts(t).items()])


def places(text: Column, patterns: Sequence[str]) -> Column:
    """The places of one term's normalised spellings that keep a span; none for null."""
    return _over(text, [(p, 0, i) for i, p in enumerate(patterns)], pa.list_(pa.int32()), "array<int>", lambda matcher, t: matcher.kept(t).get(0, []))
