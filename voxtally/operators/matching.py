"""Tagging texts with a dictionary's terms: existence, resolved spans, occurrence counts, hit rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.text import may_overlap, normalized, term_pattern
from voxtally.operators import automaton
from voxtally.sources.dictionaries import Dictionary, Term

NORMAL = "normal_text"


def with_normal_text(df: DataFrame, text_col: str = "comment_text") -> DataFrame:
    """Adds the normalised text once, for entities and topics alike."""
    return df.withColumn(NORMAL, normalized(F.col(text_col)))


def stands_in(text: Column, spelling: str) -> Column:
    """Whether a normalised spelling stands in the text. A plain search comes first, which settles most rows without a pattern."""
    there = F.contains(text, F.lit(spelling))
    return there & text.rlike(term_pattern(spelling)) if spelling.isascii() else there


def is_named(text: Column, term: Term) -> Column:
    """Whether any spelling stands in the text. The longest span always stays, so overlaps don't matter here."""
    return reduce(or_, (stands_in(text, p) for p in term.patterns))


def occurrences(text: Column, spelling: str) -> Column:
    """How often a normalised spelling stands in the text, from the left, without overlap with itself."""
    return F.regexp_count(text, F.lit(term_pattern(spelling)))


def spelling_places(text: Column, term: Term) -> Column:
    """The places (in dictionary order) of the spellings that keep a span when longer spans, then earlier ones, win.

    Spellings that can't overlap each other, and one that stands alone, keep theirs, so they are only looked for. Spans are
    resolved where several spellings of a term stand in one text; Python only gets such texts, and the time is linear in their spans."""
    patterns = term.patterns
    standing = F.array_compact(F.array(*(F.when(stands_in(text, p), F.lit(i)) for i, p in enumerate(patterns))))
    several = F.size(standing) > 1
    return F.when(several, _resolved(F.when(several, text), patterns)).otherwise(standing) if may_overlap(list(patterns)) else standing


def _resolved(text: Column, patterns: tuple[str, ...]) -> Column:
    return automaton.places(text, patterns)


#: Spellings up to which a dictionary becomes an expression with a part for each, which is compiled but grows with the dictionary. A larger
#: one is an automaton, for which a text costs the same however many spellings there are.
INLINE_SPELLINGS = 200
#: Characters of the spellings that one automaton holds, at about 50 bytes each in a worker; a larger dictionary takes more passes.
AUTOMATON_CHARS = 4_000_000


def _spellings(terms: list[tuple[int, Term]]) -> list[automaton.Spelling]:
    return [(p, i, place) for i, term in terms for place, p in enumerate(term.patterns)]


def _passes(dictionary: Dictionary) -> list[list[tuple[int, Term]]]:
    """The terms with their places in the dictionary, as many together as one pass holds."""
    parts, size = [[]], 0
    for i, term in enumerate(dictionary.terms):
        own = sum(map(len, term.patterns))
        if parts[-1] and size + own > AUTOMATON_CHARS:
            parts.append([])
            size = 0
        parts[-1].append((i, term))
        size += own
    return parts


def _hits(text: Column, terms: list[tuple[int, Term]], resolve: bool, inline: bool) -> Column:
    """Structs (ord, spellings) of the terms that a text names, in dictionary order."""
    if not inline:
        names = {(i, place): s for i, term in terms for place, s in enumerate(term.spellings)}
        return automaton.hits(text, _spellings(terms), names, resolve)
    each = []
    for i, term in terms:
        names = _names(text, term) if resolve else F.array().cast("array<string>")
        each.append(F.when(is_named(text, term), F.struct(F.lit(i).alias("ord"), names.alias("spellings"))))
    return F.array_compact(F.array(*each))


def _names(text: Column, term: Term) -> Column:
    spellings = F.array(*map(F.lit, term.spellings))
    return F.transform(spelling_places(text, term), lambda p: F.element_at(spellings, p + 1))


def _inline(dictionary: Dictionary) -> bool:
    return sum(len(t.spellings) for t in dictionary.terms) <= INLINE_SPELLINGS


def hit_places(text: Column, dictionary: Dictionary) -> Column:
    """The places in the dictionary of the terms that a normalised text names; it stays in its row, so that nothing is shuffled. None for null."""
    each = [F.transform(_hits(text, terms, False, _inline(dictionary)), lambda h: h["ord"]) for terms in _passes(dictionary)]
    return F.concat(*(F.coalesce(places, F.array().cast("array<int>")) for places in each))


def hit_rows(comments: DataFrame, dictionary: Dictionary, resolve: bool = True) -> DataFrame:
    """A row for each comment and term that it names: the comment's keys and instants, the term's catalog columns and, if
    `resolve`, its spellings that keep a span. `comments` has the normalised text."""
    instants = [c for c in ("published_at", "ingested_at") if c in comments.columns]
    passes = [comments.select("comment_id", "video_id", *instants, F.explode(_hits(F.col(NORMAL), terms, resolve, _inline(dictionary))).alias("hit")) for terms in _passes(dictionary)]
    hits = reduce(DataFrame.unionByName, passes)
    return hits.withColumn("ord", F.col("hit.ord")).join(dictionary.to_join(comments.sparkSession), "ord")


def occurrence_rows(comments: DataFrame, dictionary: Dictionary) -> DataFrame:
    """comment_id, video_id, id (of the term), spelling, n: how often each spelling stands in each comment, from the left, without overlap with
    itself. `comments` has the normalised text; the dictionary may be of any size."""
    passes = [comments.select("comment_id", "video_id", F.explode(automaton.counts(F.col(NORMAL), _spellings(terms))).alias("x")) for terms in _passes(dictionary)]
    found = reduce(DataFrame.unionByName, passes).select("comment_id", "video_id", F.col("x.ord").alias("ord"), F.col("x.place").alias("place"), F.col("x.n").alias("n"))
    return found.join(dictionary.spelling_rows(comments.sparkSession), ["ord", "place"]).select("comment_id", "video_id", "id", "spelling", "n")


def entity_mentions(comments: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Mention rows. A group is never inferred from its members."""
    rows = hit_rows(comments, dictionary)
    return rows.select(
        "comment_id", "video_id", F.col("kind").alias("entity_type"), F.col("id").alias("entity_id"), "group_id", F.col("name").alias("canonical_name"),
        F.col("hit.spellings").alias("matched_aliases"), F.lit(1).alias("mention_count"), "published_at", "ingested_at", "dictionary_version",
    )


def topic_records(comments: DataFrame, dictionary: Dictionary) -> DataFrame:
    rows = hit_rows(comments, dictionary)
    return rows.select(
        "comment_id", "video_id", F.col("id").alias("topic_id"), F.col("name").alias("display_name"), F.col("hit.spellings").alias("matched_keywords"),
        F.lit(1).alias("topic_count"), "published_at", "ingested_at", "dictionary_version",
    )
