"""File sinks: raw pages, the Silver log, quarantine, and snapshots that are replaced as a whole.

JSON keeps nulls and writes instants in UTC with their offset and microseconds. Spark's commit protocol makes each write
appear whole or not at all; snapshots are replaced in one static directory, also by no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voxtally.functions.scalars import iso_text
from voxtally.operators.metrics import in_order
from voxtally.operators.quality import kind_of, require_gold
from voxtally.session import path_exists, remove_dir
from voxtally.sources.dictionaries import Dictionary
from voxtally.sources.manifests import STAMP, write_document

#: Spark's name for ISO text with an offset; used where instants aren't written as text already.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx", "ignoreNullFields": "false"}


def _stamped(base: str | Path, own: str, at: datetime, name: str) -> Path:
    at = at.astimezone(UTC)
    return Path(base) / own / at.strftime("%Y-%m-%d") / f"{at.strftime(STAMP)}_{name}.json"


def write_page(page: dict, video_id: str, number: int, at: datetime, base: str | Path) -> Path:
    document = {"video_id": video_id, "page_number": number, "ingested_at": at.isoformat(), "raw_response": page}
    return write_document(_stamped(base, video_id, at, f"page_{number:04d}"), document)


def land_pages(pages: DataFrame, base: str) -> str:
    """Many pages at once: `pages` has video_id, page_number and the document as text. Each becomes a file of its own, in folders by video and page."""
    own = pages.select("document", F.col("video_id").alias("of_video"), F.col("page_number").alias("of_page"))
    own.repartition("of_video", "of_page").write.mode("overwrite").partitionBy("of_video", "of_page").text(base)
    return base


def write_video(video: dict, video_id: str, at: datetime, base: str | Path) -> Path:
    return write_document(_stamped(base, video_id, at, "video"), {"video_id": video_id, "ingested_at": at.isoformat(), "raw_response": video})


def write_replies(page: dict, video_id: str, parent_id: str, number: int, at: datetime, base: str | Path) -> Path:
    parent = hashlib.sha256(parent_id.encode()).hexdigest()[:16]
    document = {"video_id": video_id, "parent_comment_id": parent_id, "page_number": number, "ingested_at": at.isoformat(), "raw_response": page}
    return write_document(_stamped(base, video_id, at, f"parent_{parent}_page_{number:04d}"), document)


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: iso_text(F.col(f.name)) for f in df.schema if f.dataType.typeName() == "timestamp"} | {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() == "variant"})


def append_rows(df: DataFrame, base: str, at: datetime, kind: str) -> tuple[str | None, int]:
    """Adds rows to a log partitioned by video and day of ingestion, in a directory of its own name for the run, and returns its place and
    the number of rows; nothing is left for no rows. The rows are counted as they are written. The run's directories sort in the order of
    time, which is the order of arrival."""
    at = at.astimezone(UTC)
    place = f"{base}/{at.strftime('%Y-%m-%d')}/{at.strftime(STAMP)}_{kind}.json"
    there = path_exists(df.sparkSession, place)
    rows, n = counted(_as_text(df))
    rows.write.mode("append").options(**JSON_OPTIONS).json(place)
    if n() or there:
        return place, n()
    remove_dir(df.sparkSession, place)
    return None, 0


def counted(df: DataFrame, **more: Column) -> tuple[DataFrame, Callable[[], int | dict]]:
    """`df` with its rows, and what `more` aggregates, counted by the first job that goes through all of it; and what tells the number,
    or with `more` all of them by name, when that job is done."""
    seen = Observation()
    rows = df.observe(seen, F.count("*").alias("n"), *(c.alias(k) for k, c in more.items()))
    return rows, lambda: seen.get if more else seen.get["n"]


def append_silver(comments: DataFrame, base: str, video_id: str, at: datetime) -> tuple[str | None, int]:
    return append_rows(comments, f"{base}/{video_id}", at, "comments")


def append_rejected(rejected: DataFrame, base: str, video_id: str, at: datetime) -> tuple[str | None, int]:
    return append_rows(rejected, f"{base}/{video_id}", at, "rejected_comments")


def replace_snapshot(df: DataFrame, base: str, version: str, video_id: str, name: str, **more: Column) -> tuple[str, int | dict]:
    """The current snapshot of a dictionary version and video, whole; it may be empty. Its place, and what `counted` counts as it is written."""
    place = f"{base}/{version}/{video_id}/{name}.json"
    rows, n = counted(df, **more)
    _as_text(rows).write.mode("overwrite").options(**JSON_OPTIONS).json(place)
    return place, n()


def replace_hits(hits: DataFrame, base: str, dictionary: Dictionary, video_id: str) -> tuple[str, dict]:
    """The snapshot's place, and its rows (n), those of groups and of members."""
    entities = "entity_id" in hits.columns
    kinds = {k: F.count_if(F.col("entity_type") == k if entities else F.lit(False)) for k in ("group", "member")}
    return replace_snapshot(hits, base, dictionary.version, video_id, "current_mentions" if entities else "current_topics", **kinds)


def replace_gold(df: DataFrame, table: str, base: str, dictionary: Dictionary, video_id: str | None) -> tuple[str, int]:
    """Checked first, then replaced, in the order of groups and catalog; its place and number of rows. Without a video, the facts of all
    videos are one snapshot."""
    require_gold(df, table, video_id, dictionary.version)
    ordered = in_order(df, dictionary, "entity_id" if kind_of(table) == "entity" else "topic_id")
    return replace_snapshot(ordered, f"{base}/{table}", dictionary.version, video_id or "all", "current")
