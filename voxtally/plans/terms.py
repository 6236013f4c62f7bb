"""Registered queries with a dictionary of tens of thousands of spellings, which comes from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.text import normalized
from voxtally.operators import matching
from voxtally.plans import views
from voxtally.plans.registry import COMMENTS, query
from voxtally.sources.dictionaries import Dictionary, dictionary_of, spelling_conflicts

#: Neighbouring words that a spelling has at most; what it neither begins nor ends with.
GRAMS, EDGE = 6, r"^[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+$"

_SPELLINGS = rf"""items AS (SELECT item_id, string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
grams AS (SELECT item_id, regexp_replace(array_to_string(w[i + 1:i + n], ' '), '{EDGE}', '', 'g') AS spelling FROM (SELECT *, unnest(range(len(w))) AS i FROM items), range(1, {GRAMS + 1}) lengths(n) WHERE i + n <= len(w)),
spellings AS (SELECT 'item-' || item_id AS id, spelling FROM grams UNION ALL SELECT 'part-' || p_brand, lower(p_name) FROM part)"""


def table_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, spelling: every run of up to `GRAMS` words of each benchmark item, and the names of each brand's parts."""
    words = F.split(normalized(F.col("text")), " ")
    items = views.table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.posexplode("w").alias("i", "word"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(GRAMS), F.size("w") - F.col("i")))
    runs = items.select("item_id", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice("w", F.col("i") + 1, n), " "))).alias("run"))
    grams = runs.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"), F.regexp_replace("run", EDGE, "").alias("spelling"))
    parts = views.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_brand")).alias("id"), F.col("p_name").alias("spelling"))
    return grams.unionByName(parts).select("id", F.col("id").alias("name"), "spelling")


def table_dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    return dictionary_of(table_spellings(spark, sf_dir), "tables_v1", "Runs of words of benchmark items, and names of parts.")


@query(f"""WITH {_SPELLINGS}, each AS (SELECT spelling, id, count(*) AS n FROM spellings WHERE spelling <> '' GROUP BY ALL)
SELECT spelling AS form, count(*) AS term_count, CAST(sum(n) AS BIGINT) AS spelling_count, min(id) AS first_term, CASE WHEN count(*) > 1 THEN 'conflict' ELSE 'duplicate' END AS problem FROM each GROUP BY spelling HAVING sum(n) > 1""")
def dictionary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that the tables repeat within a term, or that several terms claim."""
    return spelling_conflicts(table_spellings(spark, sf_dir))


# Marks around each run of ASCII word characters make a term's boundaries part of the text, so that plain searches find it.
_STANDING = rf"""{COMMENTS}, {_SPELLINGS}, owned AS (SELECT spelling, min(id) AS id FROM spellings WHERE spelling <> '' GROUP BY spelling),
marked AS (SELECT *, spelling SIMILAR TO '[\x00-\x7F]*' AS plain, regexp_replace(spelling, '([A-Za-z0-9_]+)', chr(1) || '\1' || chr(2), 'g') AS s FROM owned),
texts AS (SELECT comment_id, video_id, published_at, ingested_at, t, regexp_replace(t, '([A-Za-z0-9_]+)', chr(1) || '\1' || chr(2), 'g') AS m FROM docs),
standing AS (SELECT comment_id, video_id, published_at, ingested_at, id, spelling, (length(m) - length(replace(m, s, ''))) // length(s) AS n FROM texts JOIN marked ON plain AND contains(m, s)
UNION ALL SELECT comment_id, video_id, published_at, ingested_at, id, spelling, (length(t) - length(replace(t, spelling, ''))) // length(spelling) FROM texts JOIN marked ON NOT plain AND contains(t, spelling))"""


@query(f"WITH {_STANDING} SELECT id, spelling, count(*) AS comment_count, CAST(sum(n) AS BIGINT) AS occurrence_count FROM standing GROUP BY ALL")
def large_dictionary_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each spelling of a large dictionary stands in the comments, and in how many."""
    rows = matching.occurrence_rows(views.normal_comments(spark, sf_dir), table_dictionary(spark, sf_dir))
    return rows.groupBy("id", "spelling").agg(F.count("*").alias("comment_count"), F.sum("n").alias("occurrence_count"))


@query(f"WITH {_STANDING} SELECT DISTINCT comment_id, video_id, id AS topic_id, id AS display_name, 1 AS topic_count, published_at, ingested_at, 'tables_v1' AS dictionary_version FROM standing")
def large_dictionary_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic rows with a large dictionary; spans are resolved, which tests hold against a plain version."""
    return matching.topic_records(views.normal_comments(spark, sf_dir), table_dictionary(spark, sf_dir)).drop("matched_keywords")
