"""One run for one video: fetch, flatten, judge, merge, tag, measure, write, and the manifest last of all."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators import comments, matching, metrics, versions
from voxtally.schemas import COMMENT
from voxtally.sinks import files
from voxtally.sources import landing, manifests
from voxtally.sources.dictionaries import Dictionary
from voxtally.sources.rest import Client, pages

logger = logging.getLogger(__name__)

#: Stages of a run, in order, as manifests name them.
STAGES = ("video_metadata_ingestion", "comment_ingestion", "raw_comment_read", "transformation", "run_manifest_write")
#: Result counters that a failed run's manifest keeps as well.
FAILED_COUNTS = ("records_parsed", "valid_records", "rejected_records", "merged_silver_records", "entity_mention_records", "topic_records")


@dataclass(frozen=True)
class Settings:
    video_id: str
    max_pages: int = 2
    page_size: int = 10
    base: str = "data"

    def place(self, *parts: str) -> str:
        return "/".join([self.base, *parts])


def transform(spark: SparkSession, raw: DataFrame, settings: Settings, entities: Dictionary, topics: Dictionary, at: datetime) -> dict:
    """From raw pages to Silver, quarantine, snapshots and Gold. Tagging and Gold cover the whole merged history, so a changed
    dictionary tags old comments anew. Returns counts and artifacts. Rows are counted as they are written or kept: no job only counts."""
    video_id, _ = comments.check_batch(raw)
    judged, seen = files.counted(comments.with_errors(comments.flatten_pages(raw)), valid=F.count_if(F.size("validation_errors") == 0))
    log, logged = files.counted(landing.read_silver(spark, settings.place("silver", "comments"), video_id))
    caches = [judged := judged.persist()]
    try:
        valid, rejected = comments.split_valid(judged)
        # arrival in the log is the order of its files; one file holds a comment once at most
        merged, delta = versions.merge_batch(log, valid.select(*COMMENT.names), existing_ordinal=F.col("source_file"))
        merged, merged_rows = files.counted(matching.with_normal_text(merged.where(F.col("video_id") == video_id)))
        caches.append(merged := merged.persist())
        merged.write.format("noop").mode("overwrite").save()  # reads the log and the batch once, before the log grows
        silver, written = files.append_silver(delta, settings.place("silver", "comments"), video_id, at)
        quarantine, refused = files.append_rejected(rejected, settings.place("quarantine", "comments"), video_id, at)
        counts = {"records_parsed": seen()["n"], "valid_records": seen()["valid"], "rejected_records": refused, "existing_silver_records": logged(), "merged_silver_records": merged_rows(), "silver_records_written": written}
        artifacts: dict[str, object] = {"silver_comments": silver, "rejected_comments": quarantine}
        for dictionary, hits, kind in ((entities, matching.entity_mentions(merged, entities), "entity"), (topics, matching.topic_records(merged, topics), "topic")):
            caches.append(hits := hits.persist())
            metrics.require_clean(metrics.hit_problems(hits, merged, dictionary, f"{kind}_id", "mention_count" if kind == "entity" else "topic_count"), f"{kind} hits")
            build = metrics.entity_sov if kind == "entity" else metrics.topic_metrics
            place, by = files.replace_hits(hits, settings.place("silver", "comment_entity_mentions" if kind == "entity" else "comment_topics"), dictionary, video_id)
            artifacts["silver_entity_mentions" if kind == "entity" else "silver_comment_topics"] = place
            counts |= {"entity_mention_records": by["n"], "group_mention_records": by["group"], "member_mention_records": by["member"]} if kind == "entity" else {"topic_records": by["n"]}
            for grain in ("video", "daily"):
                table = f"{grain}_entity_sov" if kind == "entity" else f"{grain}_topic_metrics"
                caches.append(gold := build(merged, hits, dictionary, daily=grain == "daily").persist())
                artifacts[f"gold_{table}"], counts[f"{table}_records"] = files.replace_gold(gold, table, settings.place("gold"), dictionary, video_id)
                gold.unpersist()
    finally:
        for cached in caches:
            cached.unpersist()
    return {"counts": counts, "artifacts": artifacts, "dictionary_versions": {"entity": entities.version, "topic": topics.version}}


def manifest_of(settings: Settings, started: datetime, took: float, raw_video: object, raw_pages: list, result: dict | None, failure: tuple[str, str] | None = None) -> dict:
    """The manifest of a run that succeeded, or of one that failed after it got this far."""
    counts = {"raw_comment_pages": len(raw_pages)}
    if result is not None:
        counts |= {k: v for k, v in result["counts"].items() if failure is None or k in FAILED_COUNTS}
    manifest = {
        "schema_version": manifests.VERSION,
        "run_id": f"{settings.video_id}_{started.astimezone(UTC).strftime(manifests.STAMP)}",
        "status": "failed" if failure else "succeeded",
        "video_id": settings.video_id,
        "started_at": started,
        "completed_at": datetime.now(UTC),
        "execution_time_seconds": took,
        "parameters": {"max_pages": settings.max_pages, "page_size": settings.page_size},
        "dictionary_versions": result["dictionary_versions"] if result else {},
        "counts": counts,
        "artifacts": {"raw_video_metadata": raw_video, "raw_comment_pages": raw_pages} | (result["artifacts"] if result else {}),
    }
    return manifest | ({"failure": dict(zip(("stage", "error_type"), failure, strict=True))} if failure else {})


def run(spark: SparkSession, client: Client, settings: Settings, entities: Dictionary, topics: Dictionary, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> Path:
    """All of a run; returns the manifest's path. A failure is noted in a manifest of its own and raised; a failing manifest never
    hides what failed first."""
    started, clock = now(), time.perf_counter()
    stage, raw_video, raw_pages, result = STAGES[0], None, [], None
    try:
        raw_video = files.write_video(client.video(settings.video_id), settings.video_id, started, settings.place("raw", "videos"))
        stage = STAGES[1]
        for number, page in pages(client.comments, settings.video_id, settings.max_pages, settings.page_size):
            raw_pages.append(files.write_page(page, settings.video_id, number, started, settings.place("raw", "comments")))
        stage = STAGES[2]
        raw = landing.read_pages(spark, [str(p) for p in raw_pages]).persist()
        raw.count()
        stage = STAGES[3]
        result = transform(spark, raw, settings, entities, topics, started)
        stage = STAGES[4]
        return manifests.write(manifest_of(settings, started, time.perf_counter() - clock, raw_video, raw_pages, result), settings.place("runs"))
    except Exception as error:
        logger.exception("run of %s failed in %s", settings.video_id, stage)
        try:
            manifests.write(manifest_of(settings, started, time.perf_counter() - clock, raw_video, raw_pages, result, (stage, type(error).__name__)), settings.place("runs"))
        except Exception:
            logger.exception("the manifest of the failed run could not be written")
        raise
