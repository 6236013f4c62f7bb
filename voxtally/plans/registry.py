"""The registered queries of the engine's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions import scalars
from voxtally.operators import comments, matching, metrics, quality, versions
from voxtally.plans import views
from voxtally.plans.views import ENTITIES, TOPICS, VERSION
from voxtally.schemas import INSTANTS, RAW_PAGE
from voxtally.sources.dictionaries import Dictionary, Term

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL that the oracles share: RE2's \b is the boundary of ASCII words ---

COMMENTS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS comment_id, source AS video_id, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS comment_date,
  TIMESTAMP '2024-01-01 07:30:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS published_at, TIMESTAMP '2024-01-02 07:30:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS ingested_at,
  trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS t FROM documents)"""


def _matches(term: str) -> str:
    return f"regexp_matches(t, '\\b{term}\\b')" if term.isascii() else f"contains(t, '{term}')"


def _named(term: Term) -> str:
    return "(" + " OR ".join(map(_matches, term.patterns)) + ")"


def _hits(dictionary: Dictionary) -> str:
    each = (f"SELECT comment_id, video_id, comment_date, published_at, ingested_at, {i} AS ord FROM docs WHERE {_named(t)}" for i, t in enumerate(dictionary.terms))
    return "hits AS (" + " UNION ALL ".join(each) + ")"


def _catalog(dictionary: Dictionary) -> str:
    rows = ", ".join(f"({i}, '{t.kind}', '{t.id}', {f"'{t.group_id}'" if t.group_id else 'NULL'}, '{t.name}')" for i, t in enumerate(dictionary.terms))
    return f"catalog(ord, kind, id, group_id, name) AS (VALUES {rows})"


def _shares(dictionary: Dictionary, daily: bool) -> str:
    grain = "video_id, comment_date" if daily else "video_id"
    return f"""WITH {COMMENTS}, {_hits(dictionary)}, {_catalog(dictionary)},
groups AS (SELECT {grain}, count(*) AS comment_count, max(ingested_at) AS snapshot_at FROM docs GROUP BY ALL),
counts AS (SELECT {grain}, ord, count(DISTINCT comment_id) AS named FROM hits GROUP BY ALL),
dense AS (SELECT groups.*, catalog.*, coalesce(named, 0) AS named FROM groups CROSS JOIN catalog LEFT JOIN counts USING ({grain}, ord)),
shares AS (SELECT *, CAST(sum(named) OVER (PARTITION BY {grain}, kind) AS BIGINT) AS total FROM dense)"""


def _entity_sql(daily: bool = False) -> str:
    return f"""{_shares(ENTITIES, daily)}, sov AS (SELECT video_id, {'comment_date, ' if daily else ''}kind AS entity_type, id AS entity_id, group_id, name AS canonical_name, '{VERSION}' AS dictionary_version,
comment_count, named AS mention_comment_count, named / comment_count AS comment_share_of_voice, total AS entity_type_mention_comment_count,
CASE WHEN total = 0 THEN 0.0 ELSE named / total END AS entity_share_of_voice, snapshot_at FROM shares)"""


def _topic_sql(daily: bool = False) -> str:
    return f"""{_shares(TOPICS, daily)}, metrics AS (SELECT video_id, {'comment_date, ' if daily else ''}id AS topic_id, name AS display_name, '{VERSION}' AS dictionary_version,
comment_count, named AS topic_comment_count, named / comment_count AS comment_share_of_voice, total AS topic_comment_count_total,
CASE WHEN total = 0 THEN 0.0 ELSE named / total END AS topic_share_of_voice, snapshot_at FROM shares)"""


#: Days leave queries as ISO text, which reads alike in every client.
DAY = "SELECT * REPLACE (CAST(comment_date AS VARCHAR) AS comment_date) FROM"


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("comment_date", F.col("comment_date").cast("string"))


# --- tagging ---


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Comments and hits. Nothing is cached: grouping the comments reads their keys alone, and texts are read once."""
    rows = views.normal_comments(spark, sf_dir)
    return rows, matching.hit_rows(rows, ENTITIES, resolve=False).withColumnRenamed("id", "entity_id")


def _topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = views.normal_comments(spark, sf_dir)
    return rows, matching.hit_rows(rows, TOPICS, resolve=False).withColumnRenamed("id", "topic_id")


@query(f"{_entity_sql()} SELECT * FROM sov")
def video_entity_sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entity_sov(*_mentions(spark, sf_dir), ENTITIES)


def _daily_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entity_sov(*_mentions(spark, sf_dir), ENTITIES, daily=True)


@query(f"{_entity_sql(True)} {DAY} sov")
def daily_entity_sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_daily_entities(spark, sf_dir))


@query(f"{_topic_sql()} SELECT * FROM metrics")
def video_topic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topic_metrics(*_topics(spark, sf_dir), TOPICS)


def _daily_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topic_metrics(*_topics(spark, sf_dir), TOPICS, daily=True)


@query(f"{_topic_sql(True)} {DAY} metrics")
def daily_topic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_daily_topics(spark, sf_dir))


@query(f"WITH {COMMENTS}, {_hits(ENTITIES)}, {_catalog(ENTITIES)} SELECT comment_id, video_id, kind AS entity_type, id AS entity_id, group_id, name AS canonical_name, 1 AS mention_count, published_at, ingested_at, '{VERSION}' AS dictionary_version FROM hits JOIN catalog USING (ord)")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.entity_mentions(views.normal_comments(spark, sf_dir), ENTITIES).drop("matched_aliases")


@query(f"WITH {COMMENTS}, {_hits(TOPICS)}, {_catalog(TOPICS)} SELECT comment_id, video_id, id AS topic_id, name AS display_name, 1 AS topic_count, published_at, ingested_at, '{VERSION}' AS dictionary_version FROM hits JOIN catalog USING (ord)")
def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.topic_records(views.normal_comments(spark, sf_dir), TOPICS).drop("matched_keywords")


def _plain_aliases() -> str:
    """Aliases of the entities whose spellings can't overlap."""
    each = []
    for term in ENTITIES.terms:
        if term.id != "cion":
            names = ", ".join(f"CASE WHEN {_matches(p)} THEN '{s}' END" for s, p in zip(term.spellings, term.patterns, strict=True))
            each.append(f"SELECT comment_id, '{term.id}' AS entity_id, concat_ws('|', {names}) AS matched FROM docs WHERE {_named(term)}")
    # a longer spelling takes its place first; what is left of the shorter ones is looked for around it. Both longer ones
    # have one length, so of two that overlap the earlier stays.
    left = "regexp_replace(t, 'ciónas|asción', chr(1), 'g')"
    cion = f"concat_ws('|', CASE WHEN contains({left}, 'ción') THEN 'ción' END, CASE WHEN list_contains(regexp_extract_all(t, 'ciónas|asción'), 'ciónas') THEN 'ciónas' END, CASE WHEN list_contains(regexp_extract_all(t, 'ciónas|asción'), 'asción') THEN 'asción' END)"
    each.append(f"SELECT comment_id, 'cion' AS entity_id, {cion} AS matched FROM docs WHERE contains(t, 'ción')")
    return " UNION ALL ".join(each)


@query(f"WITH {COMMENTS} {_plain_aliases()}")
def matched_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.entity_mentions(views.normal_comments(spark, sf_dir), ENTITIES)
    return rows.select("comment_id", "entity_id", F.array_join("matched_aliases", "|").alias("matched"))


@query(f"WITH {COMMENTS} SELECT comment_id, len(regexp_extract_all(t, '\\bthe\\b')) AS n_the, len(regexp_extract_all(t, '\\bque\\b')) AS n_que, len(regexp_extract_all(t, 'für')) AS n_fuer, len(regexp_extract_all(t, 'ción')) AS n_cion FROM docs")
def alias_occurrence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col(matching.NORMAL)
    names = {"the": "n_the", "que": "n_que", "für": "n_fuer", "ción": "n_cion"}
    return views.normal_comments(spark, sf_dir).select("comment_id", *(matching.occurrences(t, s).cast("bigint").alias(n) for s, n in names.items()))


@query(f"WITH {COMMENTS} SELECT comment_id, t AS normal_text FROM docs")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.normal_comments(spark, sf_dir).select("comment_id", matching.NORMAL)


# --- facts over comments ---

_KPI_ROWS = "k AS (SELECT event_type AS video_id, CAST(ts AS DATE) AS comment_date, ts, user_id, CAST(props->>'$.k' AS BIGINT) AS likes, greatest(CAST(props->>'$.k' AS BIGINT) - 50, 0) AS replies FROM events)"


@query(f"""WITH {_KPI_ROWS} SELECT video_id, count(*) AS comment_count, CAST(sum(likes) AS BIGINT) AS comment_like_count_total, avg(likes) AS comment_like_count_avg, CAST(sum(replies) AS BIGINT) AS reply_count_total,
avg(replies) AS reply_count_avg, count(*) FILTER (replies > 0) AS comments_with_replies_count, count(*) FILTER (replies > 0) / count(*) AS comments_with_replies_ratio, count(DISTINCT user_id) AS distinct_author_name_count,
min(ts) AS first_published_at, max(ts) AS latest_published_at, max(ts) AS snapshot_at FROM k GROUP BY video_id""")
def video_comment_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.video_kpis(views.kpi_comments(spark, sf_dir))


@query(f"""WITH {_KPI_ROWS} SELECT video_id, CAST(comment_date AS VARCHAR) AS comment_date, count(*) AS comment_count, CAST(sum(likes) AS BIGINT) AS comment_like_count_total, CAST(sum(replies) AS BIGINT) AS reply_count_total,
count(*) FILTER (replies > 0) AS comments_with_replies_count, count(*) FILTER (replies > 0) / count(*) AS comments_with_replies_ratio, count(DISTINCT user_id) AS distinct_author_name_count, max(ts) AS snapshot_at FROM k GROUP BY video_id, k.comment_date""")
def daily_comment_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(metrics.daily_kpis(views.kpi_comments(spark, sf_dir)))


# --- analysts' queries over Gold ---


@query(f"{_entity_sql()} SELECT video_id, canonical_name AS member_name, mention_comment_count, comment_share_of_voice, entity_share_of_voice, snapshot_at FROM sov WHERE video_id = 'src1' AND dictionary_version = '{VERSION}' AND entity_type = 'member' ORDER BY mention_comment_count DESC, member_name")
def member_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = video_entity_sov(spark, sf_dir).where((F.col("video_id") == "src1") & (F.col("dictionary_version") == VERSION) & (F.col("entity_type") == "member"))
    return rows.select("video_id", F.col("canonical_name").alias("member_name"), "mention_comment_count", "comment_share_of_voice", "entity_share_of_voice", "snapshot_at").orderBy(F.desc("mention_comment_count"), "member_name")


@query(f"{_entity_sql()} SELECT video_id, mention_comment_count, comment_share_of_voice, snapshot_at FROM sov WHERE video_id = 'src1' AND dictionary_version = '{VERSION}' AND entity_type = 'group' AND entity_id = 'english'")
def group_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = video_entity_sov(spark, sf_dir).where((F.col("video_id") == "src1") & (F.col("dictionary_version") == VERSION) & (F.col("entity_type") == "group") & (F.col("entity_id") == "english"))
    return rows.select("video_id", "mention_comment_count", "comment_share_of_voice", "snapshot_at")


@query(f"{_entity_sql(True)} SELECT CAST(comment_date AS VARCHAR) AS comment_date, canonical_name AS member_name, mention_comment_count, comment_share_of_voice, entity_share_of_voice FROM sov WHERE video_id = 'src1' AND dictionary_version = '{VERSION}' AND entity_type = 'member' ORDER BY comment_date, member_name")
def daily_member_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_entity_sov(spark, sf_dir).where((F.col("video_id") == "src1") & (F.col("dictionary_version") == VERSION) & (F.col("entity_type") == "member"))
    return rows.select("comment_date", F.col("canonical_name").alias("member_name"), "mention_comment_count", "comment_share_of_voice", "entity_share_of_voice").orderBy("comment_date", "member_name")


@query(f"{_topic_sql()} SELECT display_name AS topic_name, topic_comment_count, comment_share_of_voice, topic_share_of_voice, snapshot_at FROM metrics WHERE video_id = 'src1' AND dictionary_version = '{VERSION}' ORDER BY topic_comment_count DESC, topic_name")
def topic_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = video_topic_metrics(spark, sf_dir).where((F.col("video_id") == "src1") & (F.col("dictionary_version") == VERSION))
    return rows.select(F.col("display_name").alias("topic_name"), "topic_comment_count", "comment_share_of_voice", "topic_share_of_voice", "snapshot_at").orderBy(F.desc("topic_comment_count"), "topic_name")


@query(f"{_topic_sql(True)} SELECT CAST(comment_date AS VARCHAR) AS comment_date, display_name AS topic_name, topic_comment_count, comment_share_of_voice, topic_share_of_voice FROM metrics WHERE video_id = 'src1' AND dictionary_version = '{VERSION}' ORDER BY comment_date, topic_name")
def daily_topic_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_topic_metrics(spark, sf_dir).where((F.col("video_id") == "src1") & (F.col("dictionary_version") == VERSION))
    return rows.select("comment_date", F.col("display_name").alias("topic_name"), "topic_comment_count", "comment_share_of_voice", "topic_share_of_voice").orderBy("comment_date", "topic_name")


# --- flattening and rules ---


@query("""SELECT CAST(doc_id AS VARCHAR) AS comment_id, source AS video_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS author_name, text AS comment_text, n_chars AS like_count, doc_id % 4 AS total_reply_count,
TIMESTAMP '2024-01-01 00:30:00' AS published_at, TIMESTAMP '2024-01-01 01:30:00' AS updated_at, TIMESTAMP '2024-01-02 00:00:00' AS ingested_at FROM documents""")
def comment_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are built as JSON, read with the landing schema and flattened."""
    pages = documents_as_pages(spark, sf_dir)
    return as_columns(comments.flatten_pages(pages.select(F.from_json("document", RAW_PAGE).alias("p")).select("p.*")))


def documents_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, page_number, document: landed pages of up to 1,000 threads, as JSON."""
    docs = views.table(spark, sf_dir, "documents")
    snippet = F.struct(F.col("source").alias("videoId"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("authorDisplayName"), F.col("text").alias("textOriginal"), F.col("n_chars").alias("likeCount"), F.lit("2024-01-01T08:30:00+08:00").alias("publishedAt"), F.lit("2024-01-01T01:30:00Z").alias("updatedAt"))
    top = F.struct(F.col("doc_id").cast("string").alias("id"), snippet.alias("snippet"))
    thread = F.struct(F.col("doc_id").cast("string").alias("id"), F.struct((F.col("doc_id") % 4).alias("totalReplyCount"), top.alias("topLevelComment")).alias("snippet"))
    pages = docs.groupBy(F.col("source").alias("video_id"), F.floor(F.col("doc_id") / 1000).cast("int").alias("page_number")).agg(F.collect_list(thread).alias("items"))
    return pages.select("video_id", "page_number", F.to_json(F.struct("video_id", "page_number", F.lit("2024-01-02T00:00:00+00:00").alias("ingested_at"), F.struct("items").alias("raw_response"))).alias("document"))


def as_columns(flat: DataFrame) -> DataFrame:
    """Flattened comments with counts as numbers and instants as timestamps in UTC."""
    counts = {n: F.try_variant_get(n, "$", "bigint") for n in ("like_count", "total_reply_count")}
    return flat.withColumns(counts | {n: scalars.in_utc(F.col(n)) for n in INSTANTS})


_DIRTY = """d AS (SELECT event_id, concat_ws('-', user_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END) AS comment_id, event_type AS video_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
e AS (SELECT *, concat_ws('|', CASE WHEN k = 7 THEN 'comment_text is required' END, CASE WHEN k >= 97 THEN 'total_reply_count is required' END, CASE WHEN k < 50 THEN 'like_count must be non-negative' END,
CASE WHEN k = 3 THEN 'published_at must not be after updated_at' END, CASE WHEN k = 5 THEN 'updated_at must not be after ingested_at' END,
CASE WHEN count(*) OVER (PARTITION BY comment_id) > 1 THEN 'comment_id must be unique within the batch' END) AS errors FROM d)"""


@query(f"WITH {_DIRTY} SELECT event_id, comment_id, errors FROM e WHERE errors <> ''")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments.with_errors(views.dirty_comments(spark, sf_dir)).where(F.size("validation_errors") > 0)
    return rows.select("event_id", "comment_id", F.array_join("validation_errors", "|").alias("errors"))


@query(f"WITH {_DIRTY} SELECT event_id, errors = '' AS valid FROM e")
def valid_rejected_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = comments.split_valid(views.dirty_comments(spark, sf_dir))
    return valid.select("event_id", F.lit(True).alias("valid")).unionByName(rejected.select("event_id", F.lit(False).alias("valid")))


@query("SELECT event_type AS video_id, CAST(user_id AS VARCHAR) AS comment_id, count(*) AS row_count FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that come twice, which facts refuse."""
    events = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id"), F.col("user_id").cast("string").alias("comment_id"))
    return metrics.duplicate_keys(events, ["video_id", "comment_id"])


@query(f"WITH {_DIRTY} SELECT comment_id, count(*) AS row_count FROM d GROUP BY comment_id HAVING count(*) > 1")
def duplicate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplicate_keys(views.dirty_comments(spark, sf_dir), ["comment_id"])


# --- versions ---

_LATEST = """v AS (SELECT concat_ws('-', user_id, event_type) AS comment_id, CAST(props->>'$.k' AS BIGINT) % 2 AS content, CAST(date_trunc('week', ts) AS TIMESTAMP) AS updated_at, ts AS ingested_at{more} FROM events{where}),
newest AS (SELECT * FROM v QUALIFY updated_at = max(updated_at) OVER (PARTITION BY comment_id)),
changed AS (SELECT *, lag(content) OVER (PARTITION BY comment_id ORDER BY ingested_at) AS before FROM newest),
latest AS (SELECT * EXCLUDE (before) FROM changed WHERE before IS NULL OR before <> content QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY ingested_at DESC) = 1)"""


@query("WITH " + _LATEST.format(more="", where="") + " SELECT * FROM latest")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_versions(views.comment_versions(spark, sf_dir))


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log before 2024-01-25, and all versions from then on."""
    rows = views.comment_versions(spark, sf_dir)
    late = F.col("ingested_at") >= F.lit("2024-01-25").cast("timestamp_ntz")
    return rows.where(~late), rows.where(late)


_DELTA = _LATEST.format(more=", ts >= TIMESTAMP '2024-01-25' AS incoming", where="")


@query(f"WITH {_DELTA} SELECT * EXCLUDE (incoming) FROM latest WHERE incoming")
def incremental_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merge_batch(*_batches(spark, sf_dir))[1]


@query(f"WITH {_DELTA} SELECT * EXCLUDE (incoming) FROM latest")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merge_batch(*_batches(spark, sf_dir))[0]


@query(f"""WITH {_DELTA} SELECT counter, CAST(n AS BIGINT) AS n FROM (SELECT 'existing_records' AS counter, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-25' UNION ALL SELECT 'incoming_records', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-25'
UNION ALL SELECT 'merged_records', count(*) FROM latest UNION ALL SELECT 'records_to_write', count(*) FROM latest WHERE incoming)""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = _batches(spark, sf_dir)
    merged, delta = versions.merge_batch(existing, incoming)
    parts = {"existing_records": existing, "incoming_records": incoming, "merged_records": merged, "records_to_write": delta}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# --- integrity and quality ---


@query("SELECT * FROM (VALUES (0, 'group', 'english', 'english', 'the'), (1, 'group', 'german', 'german', 'für'), (2, 'member', 'que', 'english', 'que'), (3, 'member', 'cion', 'english', 'ción'), (4, 'member', 'accent', 'german', 'é'), (5, 'member', 'der', 'german', 'Der'), (6, 'member', 'never', 'german', 'zzqx')) AS t(ord, entity_type, entity_id, group_id, canonical_name)")
def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTITIES.catalog(spark).select("ord", F.col("kind").alias("entity_type"), F.col("id").alias("entity_id"), "group_id", F.col("name").alias("canonical_name"))


def _broken(hits: DataFrame, id_col: str) -> DataFrame:
    """Some hit rows with a wrong version, an unknown term, or a comment that isn't there."""
    n = F.col("comment_id").cast("bigint")
    return hits.withColumn("dictionary_version", F.when(n % 50 == 1, "old").otherwise(F.col("dictionary_version"))).withColumn(id_col, F.when(n % 50 == 2, "nobody").otherwise(F.col(id_col))).withColumn("comment_id", F.when(n % 50 == 3, F.concat(F.lit("x"), "comment_id")).otherwise(F.col("comment_id")))


def _integrity_sql(dictionary: Dictionary) -> str:
    of = lambda rest, name: f"SELECT '{name}' AS problem, count(*) AS row_count FROM hits WHERE CAST(comment_id AS BIGINT) % 50 = {rest} HAVING count(*) > 0"
    return f"WITH {COMMENTS}, {_hits(dictionary)} " + " UNION ALL ".join([of(1, "dictionary_version"), of(2, "unknown_term"), of(3, "unknown_comment")])


@query(_integrity_sql(ENTITIES))
def mention_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.normal_comments(spark, sf_dir)
    return metrics.hit_problems(_broken(matching.entity_mentions(rows, ENTITIES), "entity_id"), rows, ENTITIES, "entity_id", "mention_count")


@query(_integrity_sql(TOPICS))
def topic_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.normal_comments(spark, sf_dir)
    return metrics.hit_problems(_broken(matching.topic_records(rows, TOPICS), "topic_id"), rows, TOPICS, "topic_id", "topic_count")


def _spoiled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video facts of which src3 counts one more mention of accent, src4 has another comment count for Der, and src5 has que twice."""
    sov = video_entity_sov(spark, sf_dir)
    at = lambda video, entity: (F.col("video_id") == video) & (F.col("entity_id") == entity)
    twice = sov.where(at("src5", "que"))
    sov = sov.withColumn("mention_comment_count", F.col("mention_comment_count") + F.when(at("src3", "accent"), 1).otherwise(0))
    return sov.withColumn("comment_count", F.col("comment_count") + F.when(at("src4", "der"), 1).otherwise(0)).unionByName(twice)


_SPOILED = f"""{_entity_sql()}, bad AS (SELECT * REPLACE (mention_comment_count + CASE WHEN video_id = 'src3' AND entity_id = 'accent' THEN 1 ELSE 0 END AS mention_comment_count,
comment_count + CASE WHEN video_id = 'src4' AND entity_id = 'der' THEN 1 ELSE 0 END AS comment_count) FROM sov UNION ALL SELECT * FROM sov WHERE video_id = 'src5' AND entity_id = 'que')"""
_CLOSE = "abs({a} - {b}) <= greatest(1e-12 * greatest(abs({a}), abs({b})), 1e-12)"
_GROUPS = f"""SELECT video_id, dictionary_version, entity_type, count(DISTINCT entity_type_mention_comment_count) AS totals, max(entity_type_mention_comment_count) AS declared, CAST(sum(mention_comment_count) AS BIGINT) AS counted, sum(entity_share_of_voice) AS share_sum
FROM bad GROUP BY ALL HAVING totals <> 1 OR declared <> counted OR NOT ({_CLOSE.format(a='share_sum', b='(CASE WHEN declared > 0 THEN 1.0 ELSE 0.0 END)')})"""
_SNAPSHOTS = "SELECT video_id, dictionary_version, count(DISTINCT comment_count) AS comment_counts, count(DISTINCT snapshot_at) AS snapshots FROM bad GROUP BY ALL HAVING comment_counts <> 1 OR snapshots <> 1"
_KEYS = "SELECT video_id, dictionary_version, entity_type, entity_id, count(*) AS row_count FROM bad GROUP BY ALL HAVING count(*) > 1"


@query(f"{_SPOILED}, g AS ({_GROUPS}) SELECT * REPLACE (round(share_sum, 9) AS share_sum) FROM g")
def group_totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_problems(_spoiled_entities(spark, sf_dir), "video_entity_sov").withColumn("share_sum", F.round("share_sum", 9))


@query(f"{_SPOILED} {_SNAPSHOTS}")
def snapshot_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.snapshot_problems(_spoiled_entities(spark, sf_dir), "video_entity_sov")


@query(f"{_SPOILED} {_KEYS}")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_keys(_spoiled_entities(spark, sf_dir), "video_entity_sov")


def _rule_sql(name: str, test: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS row_count FROM bad WHERE {test} HAVING count(*) > 0"


@query(f"{_SPOILED} " + " UNION ALL ".join([
    _rule_sql("mention_comment_count exceeds comment_count", "mention_comment_count > comment_count"),
    _rule_sql("comment_share_of_voice does not match its numerator and denominator", "NOT (" + _CLOSE.format(a="comment_share_of_voice", b="(mention_comment_count / comment_count)") + ")"),
    _rule_sql("entity_share_of_voice does not match its numerator and denominator", "NOT (" + _CLOSE.format(a="entity_share_of_voice", b="(CASE WHEN entity_type_mention_comment_count = 0 THEN 0.0 ELSE mention_comment_count / entity_type_mention_comment_count END)") + ")"),
    f"SELECT 'group totals', count(*) FROM ({_GROUPS}) HAVING count(*) > 0",
    f"SELECT 'snapshot consistency', count(*) FROM ({_SNAPSHOTS}) HAVING count(*) > 0",
    f"SELECT 'duplicate logical key', count(*) FROM ({_KEYS}) HAVING count(*) > 0",
]))
def gold_entity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(_spoiled_entities(spark, sf_dir), "video_entity_sov")


@query(f"{_topic_sql(True)}, bad AS (SELECT * FROM metrics) " + " UNION ALL ".join([
    _rule_sql("metric video_id does not match output path", "video_id <> 'src1'"),
    _rule_sql("metric dictionary_version does not match output path", "dictionary_version <> 'next'"),
]))
def gold_topic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(_daily_topics(spark, sf_dir), "daily_topic_metrics", video_id="src1", version="next")


# --- publications ---

_RUNS = "runs AS (SELECT CAST(user_id AS VARCHAR) AS video_id, ts AS run_started_at, CAST(ts AS DATE) AS published_on, CAST(event_id AS VARCHAR) AS run_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"
_CURRENT = "latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY run_started_at DESC, published_on DESC, run_id DESC) = 1)"


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("video_id"), F.col("ts").alias("run_started_at"), F.to_date("ts").alias("published_at"), F.col("event_id").cast("string").alias("run_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"WITH {_RUNS}, {_CURRENT} SELECT video_id, run_started_at, run_id FROM latest")
def latest_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.warehouse.store import latest_publications

    return latest_publications(_publications(spark, sf_dir)).select("video_id", "run_started_at", "run_id")


@query(f"WITH {_RUNS}, {_CURRENT} SELECT video_id, run_id AS load_run_id, k FROM latest")
def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.warehouse.store import current_rows

    runs = _publications(spark, sf_dir)
    return current_rows(runs.select("video_id", F.col("run_id").alias("load_run_id"), "k"), runs).select("video_id", "load_run_id", "k")


@query(f"{_entity_sql()} SELECT count(*) AS row_count, count(*) FILTER (video_id IS DISTINCT FROM 'src1' OR dictionary_version IS DISTINCT FROM '{VERSION}') AS mismatched FROM sov")
def lineage_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxtally.warehouse.store import lineage_counts

    return lineage_counts(video_entity_sov(spark, sf_dir), "src1", VERSION)


@query(f"WITH {_RUNS} SELECT run_id, run_started_at FROM runs ORDER BY run_started_at DESC LIMIT 25")
def run_history_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _publications(spark, sf_dir).orderBy(F.desc("run_started_at")).limit(25).select("run_id", "run_started_at")


@query("SELECT max(k) AS largest FROM (SELECT CAST(props->>'$.k' AS BIGINT) AS k FROM events)")
def row_counts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    text = views.table(spark, sf_dir, "events").select(scalars.encode_counts(F.create_map(F.lit("k"), k)).alias("j"))
    return text.select(F.max(scalars.decode_counts(F.col("j"))["k"]).alias("largest"))


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '": ' || n, ', ' ORDER BY event_type) || '}' AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def counts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind of event as JSON with sorted keys."""
    each = views.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(scalars.encode_counts(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("counts"))


# --- scalar functions ---


@query("""SELECT page_id, CASE WHEN page_id % 7 = 6 THEN NULL ELSE lpad(CAST(page_id AS VARCHAR), 11, 'v') END AS video_id FROM pages""")
def video_id_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in all the forms in which they come, built from page ids; one form in seven is none."""
    own = F.lpad(F.col("page_id").cast("string"), 11, "v")
    forms = [F.concat(F.lit("  "), own), F.concat(F.lit("https://WWW.youtube.com/watch?t=3&v="), own), F.concat(F.lit("https://youtu.be/"), own, F.lit("?si=x")), F.concat(F.lit("http://m.youtube.com/embed/"), own, F.lit("/")), F.concat(F.lit("https://music.youtube.com/shorts/"), own), F.concat(F.lit("https://youtube.com/live/"), own, F.lit("#x")), F.concat(F.lit("https://video.example/watch?v="), own)]
    text = F.element_at(F.array(*forms), (F.col("page_id") % 7 + 1).cast("int"))
    return views.table(spark, sf_dir, "pages").select("page_id", scalars.video_id_of(text).alias("video_id"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS prefix FROM documents")
def sha_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", scalars.short_hash(F.col("doc_id").cast("string")).alias("prefix"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS utc_day, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events")
def utc_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return views.table(spark, sf_dir, "events").select("event_id", scalars.utc_date(ts).cast("string").alias("utc_day"), scalars.compact_instant(ts).alias("compact"), scalars.iso_text(ts).alias("iso"))


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 28800000000 END AS VARCHAR) AS micros FROM events")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with Z, with an offset, without a zone, without a time, and none at all."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    forms = [F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("+08:00")), iso, F.date_format("ts", "yyyy-MM-dd"), F.lit("soon")]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select("event_id", F.unix_micros(scalars.parse_instant(text)).cast("string").alias("micros"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) + 19800000000 WHEN 2 THEN epoch_us(date_trunc('second', ts)) END AS VARCHAR) AS micros FROM events")
def timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a space between day and time: with Z, with an offset, of whole seconds, and without a zone."""
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    forms = [F.concat(shown, F.lit("Z")), F.concat(shown, F.lit("-05:30")), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), shown]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "events").select("event_id", F.unix_micros(scalars.parse_instant(text)).cast("string").alias("micros"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def dialogue_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.video_kpis(views.dialogue_comments(spark, sf_dir))
    return rows.select(F.col("video_id").cast("bigint").alias("conv_id"), F.col("comment_count").alias("turns"), F.col("comment_like_count_total").alias("chars"), F.col("distinct_author_name_count").alias("roles"))


from voxtally.plans import maintained, stored, terms  # noqa: E402, F401  their queries register here as well
