"""Versioned dictionaries of entities and topics: loading, checking, and their catalog."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.scalars import filled
from voxtally.functions.text import normal_form, normalized

SCHEMA_VERSION = 1
#: Terms up to which a catalog is broadcast, about 200 bytes each.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class Term:
    """An entity or topic with the spellings that name it, in dictionary order."""

    kind: str  # group, member or topic
    id: str
    name: str
    spellings: tuple[str, ...]
    group_id: str | None = None

    @property
    def patterns(self) -> tuple[str, ...]:
        return tuple(map(normal_form, self.spellings))


@dataclass(frozen=True)
class Dictionary:
    version: str
    description: str
    terms: tuple[Term, ...]  # groups, then members, or topics, in file order

    def catalog(self, spark: SparkSession) -> DataFrame:
        """ord, kind, id, group_id, name, dictionary_version: as many rows as the dictionary has terms."""
        rows = [(i, t.kind, t.id, t.group_id, t.name, self.version) for i, t in enumerate(self.terms)]
        return spark.createDataFrame(rows, "ord int, kind string, id string, group_id string, name string, dictionary_version string")

    def spelling_rows(self, spark: SparkSession) -> DataFrame:
        """ord, place, id, spelling: a row for each spelling, with a hint to broadcast them if there are at most `BROADCAST_TERMS`."""
        rows = [(i, place, t.id, s) for i, t in enumerate(self.terms) for place, s in enumerate(t.spellings)]
        df = spark.createDataFrame(rows, "ord int, place int, id string, spelling string")
        return F.broadcast(df) if len(rows) <= BROADCAST_TERMS else df

    def to_join(self, spark: SparkSession) -> DataFrame:
        """The catalog, with a hint to broadcast it if it has at most `BROADCAST_TERMS` rows."""
        return F.broadcast(self.catalog(spark)) if len(self.terms) <= BROADCAST_TERMS else self.catalog(spark)


def _head(raw: dict, what: str) -> tuple[str, str]:
    if raw.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"Unsupported {what} dictionary schema_version: {raw.get('schema_version')}")
    return filled(raw.get("dictionary_version"), "dictionary_version"), filled(raw.get("description"), "description")


def _spellings(raw: list, label: str, noun: str) -> tuple[str, ...]:
    seen: dict[str, str] = {}
    for value in raw:
        text = filled(value, f"{label}.{noun}")
        if normal_form(text) in seen:
            raise ValueError(f"{label} contains duplicate {noun}: {text}")
        seen[normal_form(text)] = text
    return tuple(seen.values())


def _claim(owners: dict[str, str], spellings: tuple[str, ...], label: str, noun: str) -> None:
    for text in spellings:
        owner = owners.setdefault(normal_form(text), label)
        if owner != label:
            raise ValueError(f"{noun} '{text}' conflicts with {owner}")


def entity_dictionary(raw: dict) -> Dictionary:
    version, description = _head(raw, "alias")
    if not isinstance(raw.get("groups"), list) or not raw["groups"]:
        raise ValueError("groups must be a non-empty list")
    if not isinstance(raw.get("members"), list):
        raise ValueError("members must be a list")
    owners: dict[str, str] = {}
    terms: dict[tuple[str, str], Term] = {}
    for kind in ("group", "member"):
        for item in raw[f"{kind}s"]:
            own = filled(item.get(f"{kind}_id"), f"{kind}.{kind}_id")
            label = f"{kind}[{own}]"
            if (kind, own) in terms:
                raise ValueError(f"Duplicate {kind}_id: {own}")
            group = own
            if kind == "member":
                group = filled(item.get("group_id"), f"{label}.group_id")
                if ("group", group) not in terms:
                    raise ValueError(f"{label} references unknown group_id: {group}")
            name = filled(item.get("canonical_name"), f"{label}.canonical_name")
            if not isinstance(item.get("aliases"), list):
                raise ValueError(f"{label}.aliases must be a list")
            spellings = _spellings([name, *item["aliases"]], label, "alias")
            _claim(owners, spellings, label, "Alias")
            terms[kind, own] = Term(kind, own, name, spellings, group)
    return Dictionary(version, description, tuple(terms.values()))


def topic_dictionary(raw: dict) -> Dictionary:
    version, description = _head(raw, "topic")
    if not isinstance(raw.get("topics"), list) or not raw["topics"]:
        raise ValueError("topics must be a non-empty list")
    owners: dict[str, str] = {}
    terms: dict[str, Term] = {}
    for item in raw["topics"]:
        own = filled(item.get("topic_id"), "topic.topic_id")
        label = f"topic[{own}]"
        if own in terms:
            raise ValueError(f"Duplicate topic_id: {own}")
        name = filled(item.get("display_name"), f"{label}.display_name")
        if not isinstance(item.get("keywords"), list) or not item["keywords"]:
            raise ValueError(f"{label}.keywords must be a non-empty list")
        spellings = _spellings(item["keywords"], label, "keyword")
        _claim(owners, spellings, label, "Keyword")
        terms[own] = Term("topic", own, name, spellings)
    return Dictionary(version, description, tuple(terms.values()))


def load_entities(path: str | Path) -> Dictionary:
    return entity_dictionary(json.loads(Path(path).read_text("utf-8")))


def load_topics(path: str | Path) -> Dictionary:
    return topic_dictionary(json.loads(Path(path).read_text("utf-8")))


#: Spellings that a table may bring into a dictionary, which the driver holds.
TABLE_SPELLINGS = 1_000_000


def dictionary_of(rows: DataFrame, version: str, description: str) -> Dictionary:
    """A dictionary of topics from a table (id, name, spelling), terms ordered by id and spellings by normal form; spellings that the table
    repeats in a term count once, and one that several terms claim goes to the first of them. ValueError beyond `TABLE_SPELLINGS`."""
    forms = rows.select("id", "name", "spelling", normalized(F.col("spelling")).alias("form")).where("form <> ''")
    own = forms.groupBy("form").agg(F.min(F.struct("id", "spelling", "name")).alias("own"))
    if (n := own.count()) > TABLE_SPELLINGS:
        raise ValueError(f"A dictionary may have {TABLE_SPELLINGS} spellings; the table has {n}")
    terms = own.groupBy("own.id").agg(F.min("own.name").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("form", "own.spelling"))), lambda x: x["spelling"]).alias("spellings"))
    return Dictionary(version, description, tuple(Term("topic", x.id, x["name"], tuple(x.spellings)) for x in terms.orderBy("id").toLocalIterator()))


def spelling_conflicts(rows: DataFrame) -> DataFrame:
    """form, term_count, spelling_count, first_term, problem: normal forms that a table of spellings (id, spelling) has more than once, as
    `duplicate` within one term or as `conflict` between several. Null and empty spellings have no form."""
    forms = rows.select("id", normalized(F.col("spelling")).alias("form")).where("form <> ''")
    found = forms.groupBy("form", "id").agg(F.count("*").alias("n"))  # a form that many terms have is summed term by term
    found = found.groupBy("form").agg(F.count("*").alias("term_count"), F.sum("n").alias("spelling_count"), F.min("id").alias("first_term")).where("spelling_count > 1")
    return found.withColumn("problem", F.when(F.col("term_count") > 1, F.lit("conflict")).otherwise(F.lit("duplicate")))
