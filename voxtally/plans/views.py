"""Views that lay the engine's datasets over the driver's tables, with a dictionary of tokens that occur in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.matching import NORMAL, with_normal_text
from voxtally.sources.dictionaries import entity_dictionary, topic_dictionary

VERSION = "tokens_v1"

ENTITY_TERMS = {
    "schema_version": 1,
    "dictionary_version": VERSION,
    "description": "Tokens of four invented languages: words, substrings, an overlapping pair, and one that never occurs.",
    "groups": [
        {"group_id": "english", "canonical_name": "the", "aliases": ["and"]},
        {"group_id": "german", "canonical_name": "für", "aliases": ["und"]},
    ],
    "members": [
        {"member_id": "que", "group_id": "english", "canonical_name": "que", "aliases": ["qui"]},
        {"member_id": "cion", "group_id": "english", "canonical_name": "ción", "aliases": ["ciónas", "asción"]},
        {"member_id": "accent", "group_id": "german", "canonical_name": "é", "aliases": ["è"]},
        {"member_id": "der", "group_id": "german", "canonical_name": "Der", "aliases": []},
        {"member_id": "never", "group_id": "german", "canonical_name": "zzqx", "aliases": ["qxzz"]},
    ],
}
TOPIC_TERMS = {
    "schema_version": 1,
    "dictionary_version": VERSION,
    "description": "Three disjoint sets of tokens.",
    "topics": [
        {"topic_id": "being", "display_name": "Being", "keywords": ["is", "ist", "est"]},
        {"topic_id": "place", "display_name": "Place", "keywords": ["from", "von", "sur"]},
        {"topic_id": "with", "display_name": "With", "keywords": ["with", "mit", "avec"]},
    ],
}
ENTITIES, TOPICS = entity_dictionary(ENTITY_TERMS), topic_dictionary(TOPIC_TERMS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as comments of the video `source`, published on one of 30 days of 2024-01 and ingested a day later."""
    docs = table(spark, sf_dir, "documents")
    published = F.timestamp_add("DAY", (F.col("doc_id") % 30).cast("int"), F.lit("2024-01-01 07:30:00").cast("timestamp_ntz"))
    return docs.select(
        F.col("doc_id").cast("string").alias("comment_id"), F.col("source").alias("video_id"), F.col("lang").alias("author_name"), F.col("text").alias("comment_text"),
        F.col("n_chars").alias("like_count"), (F.col("doc_id") % 4).alias("total_reply_count"), published.alias("published_at"), published.alias("updated_at"),
        F.timestamp_add("DAY", F.lit(1), published).alias("ingested_at"),
    )


def normal_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_normal_text(text_comments(spark, sf_dir)).select("comment_id", "video_id", "published_at", "ingested_at", NORMAL)


def dialogue_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as comments of the video `conv_id`."""
    rows = table(spark, sf_dir, "conversations")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.col("conv_id").cast("string").alias("video_id"), F.col("role").alias("author_name"),
        F.col("text").alias("comment_text"), F.length("text").cast("bigint").alias("like_count"), F.col("turn").alias("total_reply_count"),
        at.alias("published_at"), at.alias("updated_at"), at.alias("ingested_at"),
    )


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def comment_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions of the comment (user, type), updated at the beginning of their week; content is k modulo 2."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat_ws("-", "user_id", "event_type").alias("comment_id"), (_k() % 2).alias("content"),
        F.date_trunc("week", "ts").cast("timestamp_ntz").alias("updated_at"), F.col("ts").alias("ingested_at"),
    )


def kpi_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as comments of the video `event_type`."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").cast("string").alias("comment_id"), F.col("event_type").alias("video_id"), F.col("user_id").cast("string").alias("author_name"),
        _k().alias("like_count"), F.greatest(_k() - 50, F.lit(0)).alias("total_reply_count"), F.col("ts").alias("published_at"), F.col("ts").alias("ingested_at"),
    )


def dirty_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a batch with negative counts, missing texts, wrong orders and repeated keys."""
    events = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat_ws("-", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))).alias("comment_id"),
        F.col("event_type").alias("video_id"), F.lit(None).cast("string").alias("author_name"), F.when(_k() != 7, F.col("props")).alias("comment_text"),
        (_k() - 50).alias("like_count"), F.when(_k() < 97, _k()).alias("total_reply_count"), ts.alias("published_at"),
        (ts - F.make_interval(hours=F.when(_k() == 3, 1).otherwise(0))).alias("updated_at"), (ts + F.make_interval(hours=F.when(_k() == 5, -2).otherwise(1))).alias("ingested_at"),
        F.col("event_id"),
    )
