"""KPIs whose daily facts merge into any longer period, distinct authors included, without the comments being read again.

Authors get numbers, and a day's authors are bits of 32,768 numbers each. Bits are joined by OR, so distinct counts stay exact over any
number of days; all other KPIs are sums and maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.metrics import with_date

#: Parts that number authors on their own. A set of numbers keeps the number of parts that it began with.
PARTS = 64

_SUMS = ("comment_count", "comment_like_count_total", "reply_count_total", "comments_with_replies_count")


def author_numbers(comments: DataFrame, known: DataFrame | None = None, author_col: str = "author_name") -> DataFrame:
    """author_name, number: those that `known` has, and the comments' other authors with the next numbers. Numbers are dense, as each part
    numbers its authors in turn; null isn't an author."""
    authors = comments.where(F.col(author_col).isNotNull()).select(F.col(author_col).alias("author_name")).distinct()
    part = F.pmod(F.xxhash64("author_name"), F.lit(PARTS))
    place = F.row_number().over(Window.partitionBy("part").orderBy("author_name")) - 1
    if known is None:
        return authors.withColumn("part", part).select("author_name", (place * PARTS + F.col("part")).cast("long").alias("number"))
    last = known.groupBy(F.pmod("number", F.lit(PARTS)).alias("part")).agg((F.floor(F.max("number") / PARTS) + 1).alias("next"))  # a row for each part
    new = authors.join(known, "author_name", "left_anti").withColumn("part", part).join(F.broadcast(last), "part", "left")
    new = new.select("author_name", ((place + F.coalesce("next", F.lit(0))) * PARTS + F.col("part")).cast("long").alias("number"))
    return known.select("author_name", "number").unionByName(new)


def daily_facts(comments: DataFrame, numbers: DataFrame) -> DataFrame:
    """video_id, comment_date, bucket, sums, snapshot_at, authors: facts of one day, a row for each bucket of author numbers (null: comments
    without an author). Every author must have a number."""
    rows = with_date(comments).join(numbers, "author_name", "left")
    lost = F.raise_error(F.concat(F.lit("An author has no number: "), F.col("author_name"))).cast("long")
    number = F.when(F.col("author_name").isNotNull() & F.col("number").isNull(), lost).otherwise(F.col("number"))
    rows = rows.withColumn("number", number).withColumn("bucket", F.bitmap_bucket_number("number"))
    return rows.groupBy("video_id", "comment_date", "bucket").agg(
        F.count("*").alias("comment_count"), F.sum("like_count").alias("comment_like_count_total"), F.sum("total_reply_count").alias("reply_count_total"),
        F.count_if(F.col("total_reply_count") > 0).alias("comments_with_replies_count"), F.max("ingested_at").alias("snapshot_at"),
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("authors"),
    )


def merged(facts: DataFrame, *grain: Column | str) -> DataFrame:
    """Facts at a coarser grain, which merge further: sums, maxima and the union of authors, still by bucket."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return facts.groupBy(*grain, "bucket").agg(*sums, F.max("snapshot_at").alias("snapshot_at"), F.bitmap_or_agg("authors").alias("authors"))


def kpis(facts: DataFrame, *grain: Column | str) -> DataFrame:
    """The KPIs that `metrics` has for groups of comments, from daily or merged facts."""
    rows = merged(facts, *grain)
    own = [c for c in rows.columns if c not in (*_SUMS, "snapshot_at", "authors", "bucket")]
    rows = rows.groupBy(*own).agg(*(F.sum(c).alias(c) for c in _SUMS), F.sum(F.bitmap_count("authors")).alias("distinct_author_name_count"), F.max("snapshot_at").alias("snapshot_at"))
    return rows.withColumn("comments_with_replies_ratio", F.col("comments_with_replies_count") / F.col("comment_count"))
