"""Registered queries over facts, versions and distinct sets that are kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators import distinct, metrics
from voxtally.plans import registry, views
from voxtally.plans.registry import query
from voxtally.plans.views import ENTITIES, TOPICS
from voxtally.session import fresh_dir
from voxtally.sources.dictionaries import Dictionary
from voxtally.streaming import keyed
from voxtally.warehouse.facts import FactStore

# --- shares of voice after each of four batches ---


def comment_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All documents; a third edited and a third ingested again as it was; late old versions, and some edited back; and some that move to the next day."""
    docs = views.text_comments(spark, sf_dir)
    doc_id, text = F.col("comment_id").cast("bigint"), F.col("comment_text")

    def later(chosen, updated: int, ingested: int, said=text, published: int = 0) -> DataFrame:  # noqa: ANN001
        day = lambda n, c: F.timestamp_add("DAY", F.lit(n), F.col(c))
        return docs.where(chosen).withColumns({"comment_text": said, "updated_at": day(updated, "published_at"), "published_at": day(published, "published_at"), "ingested_at": day(ingested, "published_at")})

    edited = later(doc_id % 3 == 0, 1, 40, F.concat(F.lit("the und from "), text))
    return [
        docs,
        edited.unionByName(later(doc_id % 3 == 1, 0, 40)),
        later(doc_id % 6 == 0, -1, 41, F.concat(F.lit("der avec "), text)).unionByName(later(doc_id % 6 == 3, 2, 41)),
        later(doc_id % 7 == 0, 3, 42, text, 1),
    ]


_P = "TIMESTAMP '2024-01-01 07:30:00' + to_days(CAST(doc_id % 30 AS INTEGER))"
_TEXT = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
#: All versions, and of each batch those that stand after it, as the comments that facts are made of.
_AFTER = f"""versions AS (SELECT 0 AS b, doc_id, source, text, {_P} AS published, 0 AS updated, 1 AS ingested FROM documents
UNION ALL SELECT 1, doc_id, source, 'the und from ' || text, {_P}, 1, 40 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1, doc_id, source, text, {_P}, 0, 40 FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT 2, doc_id, source, 'der avec ' || text, {_P}, -1, 41 FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT 2, doc_id, source, text, {_P}, 2, 41 FROM documents WHERE doc_id % 6 = 3
UNION ALL SELECT 3, doc_id, source, text, {_P} + INTERVAL 1 DAY, 3, 42 FROM documents WHERE doc_id % 7 = 0),
docs AS (SELECT after || ':' || source AS video_id, CAST(doc_id AS VARCHAR) AS comment_id, CAST(published AS DATE) AS comment_date, published AS published_at,
{_P} + to_days(CAST(ingested AS INTEGER)) AS ingested_at, {_TEXT.format('text')} AS t FROM versions, range(4) batches(after) WHERE b <= after QUALIFY row_number() OVER (PARTITION BY after, doc_id ORDER BY updated DESC, ingested) = 1)"""


def _of_batches(sql: str) -> str:
    """The SQL of facts, over what stands after each batch; its number is put before the video's name."""
    assert registry.COMMENTS in sql
    return sql.replace(registry.COMMENTS, _AFTER)


def _maintained(spark: SparkSession, sf_dir: str, dictionary: Dictionary, daily: bool) -> DataFrame:
    batches = comment_batches(spark, sf_dir)
    store = FactStore(spark, fresh_dir(spark, "facts"), dictionary, texts=False)  # documents stay where they are
    for number, batch in enumerate(batches):
        store.apply(number, batch)
    instant, out = batches[0].schema["ingested_at"], None
    for number in range(len(batches)):
        rows = store.shares(instant, daily, before=number + 1).withColumn("video_id", F.concat_ws(":", F.lit(number), "video_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"{_of_batches(registry._entity_sql())} SELECT * FROM sov")
def maintained_entity_sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of entities after each batch, from counts that are kept up to date; equal to what all comments that stand then give."""
    return metrics.entity_rows(_maintained(spark, sf_dir, ENTITIES, daily=False))


@query(f"{_of_batches(registry._topic_sql(True))} {registry.DAY} metrics")
def maintained_daily_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of topics and days after each batch, some comments of which move to another day."""
    return registry._day(metrics.topic_rows(_maintained(spark, sf_dir, TOPICS, daily=True)))




# --- versions on keyed state ---


def event_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Versions of events, ten days at a time; then the second ten days once more, and versions that are older than all."""
    rows = views.comment_versions(spark, sf_dir)
    day = F.dayofmonth("ingested_at")
    parts = [rows.where((day > low) & (day <= low + 10)) for low in (0, 10, 20)] + [rows.where(day > 30)]
    older = rows.where(day <= 2).withColumn("updated_at", F.timestamp_add("DAY", F.lit(-30), F.col("updated_at"))).withColumn("content", F.lit(9).cast("bigint"))
    return [*parts, parts[1], older]


@query(registry.ORACLES["latest_versions"])
def streamed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version fold on keyed state: batches land one after the other, and the stream takes what is new."""
    base, batches = fresh_dir(spark, "stream"), event_batches(spark, sf_dir)
    for number, batch in enumerate(batches):
        batch.write.parquet(f"{base}/landed/{number}")
        landed = spark.readStream.schema(batch.schema).parquet(f"{base}/landed/*")
        keyed.fold_keyed(landed, f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    return keyed.standing(spark, f"{base}/changes", batches[0].schema).drop("settled")


# --- distinct authors of longer periods, from daily facts ---


def _period(unit: str) -> str:
    return f"""SELECT '{unit}' AS period, video_id, CAST(CAST(date_trunc('{unit}', ts) AS DATE) AS VARCHAR) AS begins, count(*) AS comment_count, CAST(sum(likes) AS BIGINT) AS comment_like_count_total,
CAST(sum(replies) AS BIGINT) AS reply_count_total, count(*) FILTER (replies > 0) AS comments_with_replies_count, count(*) FILTER (replies > 0) / count(*) AS comments_with_replies_ratio,
count(DISTINCT user_id) AS distinct_author_name_count, max(ts) AS snapshot_at FROM k GROUP BY ALL"""


@query(f"WITH {registry._KPI_ROWS} {' UNION ALL '.join(map(_period, ('week', 'month', 'year')))}")
def rolled_up_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of weeks, months and years from daily facts, which two batches left: the second one numbers only the authors that are new."""
    rows, base = views.kpi_comments(spark, sf_dir), fresh_dir(spark, "daily-facts")
    late = F.dayofmonth("published_at") > 15
    numbers = None
    for batch, chosen in enumerate((~late, late)):
        distinct.author_numbers(rows.where(chosen), numbers).write.parquet(f"{base}/numbers/{batch}")
        numbers = spark.read.parquet(f"{base}/numbers/{batch}")
        distinct.daily_facts(rows.where(chosen), numbers).write.parquet(f"{base}/facts/batch={batch}")
    facts, out = spark.read.parquet(f"{base}/facts"), None
    for unit in ("week", "month", "year"):
        each = distinct.kpis(facts, "video_id", F.to_date(F.date_trunc(unit, "comment_date")).cast("string").alias("begins")).withColumn("period", F.lit(unit))
        out = each if out is None else out.unionByName(each)
    return out
