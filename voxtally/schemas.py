"""One declaration for each dataset; DDL, read schemas and checks derive from it."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"STRING": StringType(), "BIGINT": LongType(), "INT": IntegerType(), "DOUBLE": DoubleType(), "DATE": DateType(), "TIMESTAMP": TimestampType(), "ARRAY<STRING>": ArrayType(StringType())}


def _struct(columns: str) -> StructType:
    """Of flat columns; needs no session, unlike Spark's own parser."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: Fields of a comment as parsed; all but author_name are required.
COMMENT = _struct(
    "comment_id STRING, video_id STRING, author_name STRING, comment_text STRING, like_count BIGINT, total_reply_count BIGINT,"
    " published_at TIMESTAMP, updated_at TIMESTAMP, ingested_at TIMESTAMP"
)
REQUIRED = ("comment_id", "video_id", "comment_text", "published_at", "updated_at", "ingested_at", "like_count", "total_reply_count")
COUNTS = ("like_count", "total_reply_count")
INSTANTS = ("published_at", "updated_at", "ingested_at")

#: A landed page of comment threads. Counts are VARIANT so that 5, "5", 5.0 and true stay apart.
RAW_PAGE = (
    "video_id STRING, page_number INT, ingested_at STRING, raw_response STRUCT<nextPageToken: STRING, items: ARRAY<STRUCT<id: STRING,"
    " snippet: STRUCT<totalReplyCount: VARIANT, topLevelComment: STRUCT<id: STRING, snippet: STRUCT<videoId: STRING,"
    " authorDisplayName: STRING, textOriginal: STRING, likeCount: VARIANT, publishedAt: STRING, updatedAt: STRING>>>>>>"
)

MENTION = _struct(
    "comment_id STRING, video_id STRING, entity_type STRING, entity_id STRING, group_id STRING, canonical_name STRING,"
    " matched_aliases ARRAY<STRING>, mention_count INT, published_at TIMESTAMP, ingested_at TIMESTAMP, dictionary_version STRING"
)
TOPIC = _struct(
    "comment_id STRING, video_id STRING, topic_id STRING, display_name STRING, matched_keywords ARRAY<STRING>, topic_count INT,"
    " published_at TIMESTAMP, ingested_at TIMESTAMP, dictionary_version STRING"
)

_ENTITY = (
    "entity_type STRING, entity_id STRING, group_id STRING, canonical_name STRING, dictionary_version STRING, comment_count BIGINT,"
    " mention_comment_count BIGINT, comment_share_of_voice DOUBLE, entity_type_mention_comment_count BIGINT, entity_share_of_voice DOUBLE,"
    " snapshot_at TIMESTAMP"
)
_TOPIC_METRIC = (
    "topic_id STRING, display_name STRING, dictionary_version STRING, comment_count BIGINT, topic_comment_count BIGINT,"
    " comment_share_of_voice DOUBLE, topic_comment_count_total BIGINT, topic_share_of_voice DOUBLE, snapshot_at TIMESTAMP"
)
#: Gold datasets by the name of their table.
GOLD = {
    "video_entity_sov": _struct(f"video_id STRING, {_ENTITY}"),
    "daily_entity_sov": _struct(f"video_id STRING, comment_date DATE, {_ENTITY}"),
    "video_topic_metrics": _struct(f"video_id STRING, {_TOPIC_METRIC}"),
    "daily_topic_metrics": _struct(f"video_id STRING, comment_date DATE, {_TOPIC_METRIC}"),
}
VIDEO_KPIS = _struct(
    "video_id STRING, comment_count BIGINT, comment_like_count_total BIGINT, comment_like_count_avg DOUBLE, reply_count_total BIGINT,"
    " reply_count_avg DOUBLE, comments_with_replies_count BIGINT, comments_with_replies_ratio DOUBLE, distinct_author_name_count BIGINT,"
    " first_published_at TIMESTAMP, latest_published_at TIMESTAMP, snapshot_at TIMESTAMP"
)
DAILY_KPIS = _struct(
    "video_id STRING, comment_date DATE, comment_count BIGINT, comment_like_count_total BIGINT, reply_count_total BIGINT,"
    " comments_with_replies_count BIGINT, comments_with_replies_ratio DOUBLE, distinct_author_name_count BIGINT, snapshot_at TIMESTAMP"
)
PUBLICATION = _struct(
    "run_id STRING, video_id STRING, run_started_at TIMESTAMP, published_at TIMESTAMP, table_count BIGINT, total_row_count BIGINT, row_counts_json STRING"
)


def ddl(schema: StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in schema.fields)
