"""From landed pages to valid comments: flattening, rules, and the split into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType, TimestampNTZType, TimestampType, VariantType

from voxtally.functions.scalars import is_integer, parse_instant
from voxtally.schemas import COUNTS, INSTANTS, REQUIRED


def flatten_pages(pages: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each comment thread of the pages, in page and thread order within a page.

    Counts stay VARIANT for the rules to judge. In strict mode a thread whose timestamps don't parse, or that lacks a part that
    only the author may lack, fails the query; otherwise it becomes null and is rejected later."""
    top = "thread.snippet.topLevelComment"
    threads = pages.select("ingested_at", "page_number", F.posexplode("raw_response.items").alias("thread_number", "thread"))

    def text(path: str) -> Column:
        return F.col(path)

    def instant(column: Column, what: str) -> Column:
        parsed = parse_instant(column)
        if not strict:
            return parsed
        return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"{what} must be an ISO timestamp with an offset: "), F.coalesce(column, F.lit("null")))).cast("timestamp")).otherwise(parsed)

    return threads.select(
        text(f"{top}.id").alias("comment_id"),
        text(f"{top}.snippet.videoId").alias("video_id"),
        text(f"{top}.snippet.authorDisplayName").alias("author_name"),
        text(f"{top}.snippet.textOriginal").alias("comment_text"),
        F.col(f"{top}.snippet.likeCount").alias("like_count"),
        F.col("thread.snippet.totalReplyCount").alias("total_reply_count"),
        instant(text(f"{top}.snippet.publishedAt"), "publishedAt").alias("published_at"),
        instant(text(f"{top}.snippet.updatedAt"), "updatedAt").alias("updated_at"),
        instant(F.col("ingested_at"), "ingested_at").alias("ingested_at"),
    )


def check_batch(pages: DataFrame) -> tuple[str, str]:
    """The one video and ingestion time of a batch of pages; ValueError if there are none or several."""
    got = pages.agg(F.count("*").alias("n"), F.collect_set("video_id").alias("videos"), F.count_distinct("ingested_at").alias("times"), F.first("ingested_at").alias("at")).first()
    if not got["n"]:
        raise ValueError("At least one raw document is required")
    if len(got["videos"]) != 1:
        raise ValueError("Raw documents must belong to one video_id")
    if got["times"] != 1:
        raise ValueError("Raw documents must share one ingested_at")
    return got["videos"][0], got["at"]


def _is_null(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column.isNull() | F.is_variant_null(column) if isinstance(df.schema[name].dataType, VariantType) else column.isNull()


def _count_rules(df: DataFrame, name: str) -> list[Column]:
    """An integer, and not negative. What counts as an integer depends on how the column came in."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, VariantType):
        whole = is_integer(column)
        number = F.try_variant_get(column, "$", "bigint")
    elif isinstance(kind, StringType):
        whole, number = column.rlike(r"^-?(0|[1-9][0-9]*)$"), column.try_cast("bigint")
    elif isinstance(kind, IntegralType):
        whole, number = F.lit(True), column
    else:
        whole, number = F.lit(False), column.cast("double") if isinstance(kind, NumericType) else F.lit(0)
    there = ~_is_null(df, name)
    return [F.when(there & ~whole, f"{name} must be an integer").when(there & (number < 0), f"{name} must be non-negative")]


def _instant_rules(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The error of a timestamp field and its instant. Text is no datetime; a timestamp without zone says no instant."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, TimestampType):
        return F.lit(None).cast("string"), column
    error = f"{name} must include timezone information" if isinstance(kind, TimestampNTZType) else f"{name} must be a datetime"
    return F.when(~_is_null(df, name), error), F.lit(None).cast("timestamp")


def validation_errors(df: DataFrame) -> Column:
    """The messages of all rules that a row breaks, in the order of the rules; columns that are missing count as null."""
    missing = [n for n in REQUIRED if n not in df.columns]
    rules: list[Column] = [F.lit(f"{n} is required") if n in missing else F.when(_is_null(df, n), f"{n} is required") for n in REQUIRED]
    for name in COUNTS:
        rules += _count_rules(df, name) if name not in missing else []
    instants = {}
    for name in INSTANTS:
        if name not in missing:
            error, instants[name] = _instant_rules(df, name)
            rules.append(error)
    if len(instants) == len(INSTANTS):
        known = F.lit(True)
        for column in instants.values():
            known = known & column.isNotNull()
        for early, late in zip(INSTANTS, INSTANTS[1:], strict=False):
            rules.append(F.when(known & (instants[early] > instants[late]), f"{early} must not be after {late}"))
    return F.array_compact(F.array(*rules))


def with_errors(df: DataFrame, key: str = "comment_id") -> DataFrame:
    """Adds validation_errors, with the batch's rule that a key is unique; every copy of a repeated key breaks it."""
    seen = F.count("*").over(Window.partitionBy(key))
    twice = F.when(F.col(key).isNotNull() & (seen > 1), F.array(F.lit(f"{key} must be unique within the batch"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("validation_errors", F.concat(validation_errors(df), twice))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, with counts as BIGINT, and rejected rows with their errors. `df` may be judged already (with_errors); who reads
    both caches it and lets it go."""
    judged = df if "validation_errors" in df.columns else with_errors(df)
    valid = judged.where(F.size("validation_errors") == 0).drop("validation_errors")
    for name in COUNTS:
        kind = df.schema[name].dataType
        valid = valid.withColumn(name, F.try_variant_get(name, "$", "bigint") if isinstance(kind, VariantType) else F.col(name).cast("bigint"))
    return valid, judged.where(F.size("validation_errors") > 0)
