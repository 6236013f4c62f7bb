"""Gold facts: comment KPIs, and shares of voice and of topics by one builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.scalars import ratio, utc_date
from voxtally.sources.dictionaries import Dictionary


def with_date(comments: DataFrame) -> DataFrame:
    return comments.withColumn("comment_date", utc_date(F.col("published_at")))


def _kpis(comments: DataFrame, grain: list[str]) -> DataFrame:
    replied = F.count_if(F.col("total_reply_count") > 0)
    return comments.groupBy(*grain).agg(
        F.count("*").alias("comment_count"),
        F.sum("like_count").alias("comment_like_count_total"),
        F.avg("like_count").alias("comment_like_count_avg"),
        F.sum("total_reply_count").alias("reply_count_total"),
        F.avg("total_reply_count").alias("reply_count_avg"),
        replied.alias("comments_with_replies_count"),
        (replied / F.count("*")).alias("comments_with_replies_ratio"),
        F.count_distinct("author_name").alias("distinct_author_name_count"),
        F.min("published_at").alias("first_published_at"),
        F.max("published_at").alias("latest_published_at"),
        F.max("ingested_at").alias("snapshot_at"),
    )


def video_kpis(comments: DataFrame) -> DataFrame:
    return _kpis(comments, ["video_id"])


def daily_kpis(comments: DataFrame) -> DataFrame:
    return _kpis(with_date(comments), ["video_id", "comment_date"]).drop("comment_like_count_avg", "reply_count_avg", "first_published_at", "latest_published_at")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def once() -> Column:
    """The number of rows of a group, which fails the query if there are several."""
    return F.when(F.count("*") == 1, F.lit(1).cast("long")).otherwise(F.raise_error(F.lit("Comments must contain one latest row per video_id/comment_id")).cast("long"))


def shares(comments: DataFrame, hits: DataFrame, dictionary: Dictionary, daily: bool = False) -> DataFrame:
    """For each group of comments (video, or video and UTC day) and each term: comments, comments that name it, the total of
    those over the terms of its kind, both shares, and the group's latest ingestion. Terms that nobody named have zeros. A comment that
    comes twice fails the query.

    hits: comment_id, video_id, id (of the term), and published_at, from which their day comes. Repeated hits count once. Counts join the
    catalog by id alone."""
    grain = ["video_id", "comment_date"] if daily else ["video_id"]
    comments, hits = (with_date(comments), with_date(hits)) if daily else (comments, hits)
    day = [F.min("comment_date").alias("comment_date")] if daily else []
    each = comments.groupBy("video_id", "comment_id").agg(once().alias("n"), *day, F.max("ingested_at").alias("at"))
    groups = each.groupBy(*grain).agg(F.sum("n").alias("comment_count"), F.max("at").alias("snapshot_at"))
    named = hits.select(*grain, "comment_id", "id")
    counts = named.groupBy(*grain, "id").agg(F.count_distinct("comment_id").alias("named"))
    return dense_shares(groups, counts, dictionary, grain)


def dense_shares(groups: DataFrame, counts: DataFrame, dictionary: Dictionary, grain: list[str]) -> DataFrame:
    """The rows of `shares` from groups (grain, comment_count, snapshot_at) and counts (grain, id, named)."""
    dense = groups.crossJoin(dictionary.to_join(groups.sparkSession)).join(counts, [*grain, "id"], "left").withColumn("named", F.coalesce("named", F.lit(0).cast("long")))
    total = F.sum("named").over(Window.partitionBy(*grain, "kind"))
    return dense.withColumn("total", total).select(
        *grain, "ord", "kind", "id", "group_id", "name", "dictionary_version", "comment_count", "named",
        (F.col("named") / F.col("comment_count")).alias("comment_share"), "total", ratio(F.col("named"), F.col("total")).alias("share"), "snapshot_at",
    )


def entity_sov(comments: DataFrame, mentions: DataFrame, dictionary: Dictionary, daily: bool = False) -> DataFrame:
    return entity_rows(shares(comments, mentions.withColumnRenamed("entity_id", "id"), dictionary, daily))


def entity_rows(rows: DataFrame) -> DataFrame:
    """The rows of `shares` as facts of entities."""
    return rows.select(
        *(c for c in ("video_id", "comment_date") if c in rows.columns), F.col("kind").alias("entity_type"), F.col("id").alias("entity_id"), "group_id",
        F.col("name").alias("canonical_name"), "dictionary_version", "comment_count", F.col("named").alias("mention_comment_count"),
        F.col("comment_share").alias("comment_share_of_voice"), F.col("total").alias("entity_type_mention_comment_count"),
        F.col("share").alias("entity_share_of_voice"), "snapshot_at",
    )


def topic_metrics(comments: DataFrame, topics: DataFrame, dictionary: Dictionary, daily: bool = False) -> DataFrame:
    return topic_rows(shares(comments, topics.withColumnRenamed("topic_id", "id"), dictionary, daily))


def topic_rows(rows: DataFrame) -> DataFrame:
    """The rows of `shares` as facts of topics."""
    return rows.select(
        *(c for c in ("video_id", "comment_date") if c in rows.columns), F.col("id").alias("topic_id"), F.col("name").alias("display_name"), "dictionary_version",
        "comment_count", F.col("named").alias("topic_comment_count"), F.col("comment_share").alias("comment_share_of_voice"),
        F.col("total").alias("topic_comment_count_total"), F.col("share").alias("topic_share_of_voice"), "snapshot_at",
    )


def in_order(rows: DataFrame, dictionary: Dictionary, id_col: str) -> DataFrame:
    """Sorted by group, then catalog order; for sinks that keep order."""
    catalog = dictionary.to_join(rows.sparkSession).select(F.col("id").alias(id_col), "ord")
    grain = [c for c in ("video_id", "comment_date") if c in rows.columns]
    return rows.join(catalog, id_col).orderBy(*grain, "ord").select(*rows.columns)


def hit_problems(hits: DataFrame, comments: DataFrame, dictionary: Dictionary, id_col: str, count_col: str) -> DataFrame:
    """problem, row_count: hit rows whose version isn't the dictionary's, whose count isn't 1, whose term the dictionary lacks, whose
    group is another, or whose comment isn't there."""
    catalog = dictionary.to_join(hits.sparkSession).select(F.col("id").alias("c_id"), F.col("kind").alias("c_kind"), F.col("group_id").alias("c_group"))
    typed, grouped = "entity_type" in hits.columns, "group_id" in hits.columns
    match = F.col(id_col) == F.col("c_id")
    rows = hits.join(catalog, match & (F.col("entity_type") == F.col("c_kind")) if typed else match, "left")
    known = comments.select("video_id", "comment_id").distinct().withColumn("there", F.lit(True))
    rows = rows.join(known, ["video_id", "comment_id"], "left")
    tests = {
        "dictionary_version": ~F.col("dictionary_version").eqNullSafe(F.lit(dictionary.version)),
        count_col: ~F.col(count_col).eqNullSafe(F.lit(1)),
        "unknown_term": F.col("c_id").isNull(),
        "unknown_comment": F.col("there").isNull(),
    }
    if grouped:
        tests["group_id"] = F.col("c_id").isNotNull() & ~F.col("group_id").eqNullSafe(F.col("c_group"))
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return rows.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("row_count"))


def require_clean(problems: DataFrame, what: str) -> None:
    """ValueError if a table of problems has rows; it has one for each kind of problem at most."""
    found = sorted(map(tuple, problems.collect()))
    if found:
        raise ValueError(f"{what}: " + ", ".join(" ".join(map(str, f)) for f in found))
