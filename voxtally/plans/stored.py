"""Registered queries that go through files, APIs and warehouses: what is written is read back, and has to equal SQL over the tables.

Each writes to new folders under the shared folder."""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally import cli
from voxtally.functions import scalars
from voxtally.functions.text import quoted
from voxtally.operators import comments, matching, metrics, versions
from voxtally.plans import registry, views
from voxtally.plans.registry import COMMENTS, DAY, ORACLES, query
from voxtally.plans.views import ENTITIES, TOPICS, VERSION
from voxtally.schemas import COMMENT, GOLD
from voxtally.session import fresh_dir
from voxtally.sinks import committed, files
from voxtally.sources import landing, manifests, rest
from voxtally.sources.dictionaries import Dictionary, entity_dictionary, load_entities, load_topics, topic_dictionary
from voxtally.warehouse.store import SnapshotLoad, SparkWarehouse

AT = datetime(2024, 2, 1, tzinfo=UTC)


def _instant(text: str):
    return F.lit(text).cast("timestamp")


# --- landed pages, the log and quarantine ---


@query(ORACLES["comment_flatten"])
def landed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are landed as files of one document each, read back and flattened."""
    base = files.land_pages(registry.documents_as_pages(spark, sf_dir), fresh_dir(spark, "pages"))
    return registry.as_columns(comments.flatten_pages(landing.read_pages(spark, base)))


def _silver_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three batches of the log: all documents, then every third edited and the next one ingested again as it was, then one in three edited back."""
    docs = views.text_comments(spark, sf_dir).withColumns({n: F.col(n).cast("timestamp") for n in ("published_at", "updated_at", "ingested_at")}).select(*COMMENT.names)
    rest_of = F.col("comment_id").cast("bigint") % 3
    again = docs.withColumn("ingested_at", F.col("ingested_at") + F.make_interval(days=F.lit(40)))
    edited = again.where(rest_of == 0).withColumn("comment_text", F.concat(F.lit("edited "), "comment_text"))
    back = docs.where(rest_of == 0).withColumn("ingested_at", F.col("ingested_at") + F.make_interval(days=F.lit(41)))
    return [docs, edited.unionByName(again.where(rest_of == 1)), back]


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fresh_dir(spark, "silver")
    for day, batch in enumerate(_silver_batches(spark, sf_dir)):
        files.append_silver(batch, base, "all", AT + timedelta(days=day))
    return landing.read_silver(spark, base)


@query("SELECT CAST(doc_id AS VARCHAR) AS comment_id, text AS comment_text, strftime(TIMESTAMP '2024-01-02 07:30:00' + to_days(CAST(doc_id % 30 AS INTEGER)) + to_days(CASE WHEN doc_id % 3 = 0 THEN 41 ELSE 0 END), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ingested FROM documents")
def silver_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest versions of a log in files, folded in the order of its files."""
    log = _silver(spark, sf_dir)
    log = log.select(*COMMENT.names, F.col("source_file").alias(versions.ORDINAL))
    latest = versions.latest_versions(log, "comment_id", F.col(versions.ORDINAL))
    return latest.select("comment_id", "comment_text", scalars.iso_text(F.col("ingested_at")).alias("ingested"))


@query(ORACLES["silver_log"])
def committed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log through the sink that commits a run as a whole; the second run is written twice, first with too few rows."""
    base, batches = fresh_dir(spark, "committed"), _silver_batches(spark, sf_dir)
    for run, rows in (("0", batches[0]), ("1", batches[1].where("comment_id % 2 = 0")), ("1", batches[1]), ("2", batches[2])):
        committed.append_run(rows, base, run)
    log = committed.read_runs(spark, base, COMMENT).withColumnRenamed("source_file", versions.ORDINAL)
    log = log.withColumn(versions.ORDINAL, F.regexp_extract(versions.ORDINAL, r"/([^/]+)/[^/]+$", 1))
    latest = versions.latest_versions(log, "comment_id", F.col(versions.ORDINAL))
    return latest.select("comment_id", "comment_text", scalars.iso_text(F.col("ingested_at")).alias("ingested"))


@query("SELECT source AS video_id, CAST(count(*) + count(*) FILTER (doc_id % 3 < 2) + count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS versions, 3 AS files FROM documents GROUP BY source")
def silver_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the log by video, and the batches that they stand in."""
    log = _silver(spark, sf_dir).withColumn("batch", F.regexp_extract("source_file", r"/([^/]+_comments\.json)/", 1))
    return log.groupBy("video_id").agg(F.count("*").alias("versions"), F.count_distinct("batch").cast("int").alias("files"))


@query(ORACLES["validation_errors"])
def rejected_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows as they come back from quarantine."""
    _, rejected = comments.split_valid(views.dirty_comments(spark, sf_dir))
    place, _ = files.append_rejected(rejected, fresh_dir(spark, "quarantine"), "all", AT)
    rows = spark.read.schema("event_id bigint, comment_id string, validation_errors array<string>").json(place)
    return rows.select("event_id", "comment_id", F.array_join("validation_errors", "|").alias("errors"))


@query("SELECT event_type AS video_id, '2024-02-01' AS ingested_at, count(*) AS page_count FROM events GROUP BY event_type")
def batch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's pages are a batch of one video and time; all of them together are refused."""
    pages = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id"), F.lit("2024-02-01").alias("ingested_at"))
    videos = [r["video_id"] for r in pages.select("video_id").distinct().collect()]  # kinds of events
    try:
        comments.check_batch(pages)
        refused = len(videos) < 2
    except ValueError:
        refused = True
    rows = [(*comments.check_batch(own), own.count()) for v in videos if refused for own in [pages.where(F.col("video_id") == v)]]
    return spark.createDataFrame(rows, "video_id string, ingested_at string, page_count bigint")


# --- snapshots ---


def _hit_rows(dictionary: Dictionary, kind: str) -> str:
    return f"SELECT '{kind}' AS dictionary, comment_id, id, '{dictionary.version}' AS dictionary_version FROM (WITH {COMMENTS}, {registry._hits(dictionary)}, {registry._catalog(dictionary)} SELECT comment_id, id FROM hits JOIN catalog USING (ord))"


@query(f"{_hit_rows(ENTITIES, 'entity')} UNION ALL {_hit_rows(TOPICS, 'topic')}")
def hit_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention and topic snapshots, replaced whole: an older one of no rows gives way."""
    base, out = fresh_dir(spark, "hits"), []
    rows = views.normal_comments(spark, sf_dir)
    for dictionary, kind, id_col, build in ((ENTITIES, "entity", "entity_id", matching.entity_mentions), (TOPICS, "topic", "topic_id", matching.topic_records)):
        hits = build(rows, dictionary)
        files.replace_hits(hits.where("comment_id IS NULL"), base, dictionary, "all")
        place, _ = files.replace_hits(hits, base, dictionary, "all")
        read = spark.read.schema(f"comment_id string, {id_col} string, dictionary_version string").json(place)
        out.append(read.select(F.lit(kind).alias("dictionary"), "comment_id", F.col(id_col).alias("id"), "dictionary_version"))
    return out[0].unionByName(out[1])


_FACTS = {
    "video_entity_sov": (f"{registry._entity_sql()} SELECT * FROM sov", "entity_id", "mention_comment_count"),
    "daily_entity_sov": (f"{registry._entity_sql(True)} {DAY} sov", "entity_id", "mention_comment_count"),
    "video_topic_metrics": (f"{registry._topic_sql()} SELECT * FROM metrics", "topic_id", "topic_comment_count"),
    "daily_topic_metrics": (f"{registry._topic_sql(True)} {DAY} metrics", "topic_id", "topic_comment_count"),
}


def _fact_rows(name: str) -> str:
    sql, own, count = _FACTS[name]
    day = "comment_date" if name.startswith("daily") else "NULL"
    return f"SELECT '{name}' AS fact, video_id, {day} AS comment_date, {own} AS id, comment_count, {count} AS named, comment_share_of_voice AS share, strftime(snapshot_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS snapshot FROM ({sql})"


def _gold(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The facts of a Gold table with the types that the table declares."""
    rows = views.normal_comments(spark, sf_dir)
    daily = name.startswith("daily")
    if "entity" in name:
        hits = matching.hit_rows(rows, ENTITIES, resolve=False).withColumnRenamed("id", "entity_id")
        df = metrics.entity_sov(rows, hits, ENTITIES, daily)
    else:
        hits = matching.hit_rows(rows, TOPICS, resolve=False).withColumnRenamed("id", "topic_id")
        df = metrics.topic_metrics(rows, hits, TOPICS, daily)
    return df.withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp"))


def _dictionary_of(name: str) -> Dictionary:
    return ENTITIES if "entity" in name else TOPICS


@query(" UNION ALL ".join(map(_fact_rows, _FACTS)))
def gold_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four Gold tables, checked, written in catalog order as JSON and read back."""
    base, out = fresh_dir(spark, "gold"), []
    for name, (_, own, count) in _FACTS.items():
        place, _ = files.replace_gold(_gold(spark, sf_dir, name), name, base, _dictionary_of(name), None)
        read = spark.read.schema(GOLD[name]).option("mode", "FAILFAST").json(place)
        day = F.col("comment_date").cast("string") if name.startswith("daily") else F.lit(None).cast("string")
        columns = F.lit(name).alias("fact"), "video_id", day.alias("comment_date"), F.col(own).alias("id"), "comment_count", F.col(count).alias("named"), F.col("comment_share_of_voice").alias("share")
        out.append(read.select(*columns, scalars.iso_text(F.col("snapshot_at")).alias("snapshot")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"{registry._entity_sql()} SELECT video_id, string_agg(entity_id, '|' ORDER BY ord) AS entities FROM sov JOIN (SELECT ord, kind AS entity_type, id AS entity_id FROM catalog) USING (entity_type, entity_id) GROUP BY video_id")
def emission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a snapshot's files hold each video's entities: that of the catalog."""
    place, _ = files.replace_gold(_gold(spark, sf_dir, "video_entity_sov"), "video_entity_sov", fresh_dir(spark, "gold"), ENTITIES, None)
    rows = spark.read.schema("video_id string, entity_id string").json(place)
    rows = rows.select("video_id", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "entity_id").alias("x"))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["entity_id"]), "|").alias("entities"))


# --- warehouses; a load is one run of all videos, or of one ---

VIDEO = "src1"


def _snapshots(spark: SparkSession, sf_dir: str, video_id: str | None = None) -> list[SnapshotLoad]:
    base, out = fresh_dir(spark, "gold"), []
    for name in _FACTS:
        gold = _gold(spark, sf_dir, name)
        gold = (gold if video_id is None else gold.where(F.col("video_id") == video_id)).persist()  # checked, then written
        place, _ = files.replace_gold(gold, name, base, _dictionary_of(name), video_id)
        gold.unpersist()
        out.append(SnapshotLoad(name, place, "first", AT, video_id, VERSION))
    return out


def _warehouse(spark: SparkSession, sf_dir: str) -> SparkWarehouse:
    """A new warehouse into which all videos' snapshots were loaded as one run, then as a later one, and the first one again, which changes nothing."""
    loads = _snapshots(spark, sf_dir)
    store = SparkWarehouse(spark, Path(fresh_dir(spark, "gold")).name.replace("-", "_"))
    later = [SnapshotLoad(**{**x.__dict__, "run_id": "second", "run_started_at": AT + timedelta(days=1)}) for x in loads]
    for run in (loads, later, [SnapshotLoad(**{**x.__dict__, "source_uri": "/nowhere"}) for x in loads]):
        store.load_snapshots(run)
    return store


_FACT_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS fact, video_id, count(*) AS n FROM ({sql}) GROUP BY video_id" for name, (sql, _, _) in _FACTS.items())


@query(f"SELECT run_id, video_id, 4 AS table_count, total_row_count, row_counts_json FROM (SELECT video_id, CAST(sum(n) AS BIGINT) AS total_row_count, '{{' || string_agg('\"' || fact || '\": ' || n, ', ' ORDER BY fact) || '}}' AS row_counts_json FROM ({_FACT_COUNTS}) GROUP BY video_id), (VALUES ('first'), ('second')) AS runs(run_id)")
def warehouse_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication log after the loads: a row for each video and run."""
    store = _warehouse(spark, sf_dir)
    return spark.table(store.name("publications")).select("run_id", "video_id", F.col("table_count").cast("int").alias("table_count"), "total_row_count", "row_counts_json")


@query(f"SELECT fact, run_id, CAST(sum(n) AS BIGINT) AS n FROM ({_FACT_COUNTS}), (VALUES ('first'), ('second')) AS runs(run_id) GROUP BY ALL")
def warehouse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each run left in the history of each Gold table."""
    store = _warehouse(spark, sf_dir)
    out = [spark.table(store.name(f"{name}_history")).groupBy(F.col("load_run_id").alias("run_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("fact"), "run_id", "n") for name in _FACTS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _own_facts() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_fact_rows(name)}) WHERE video_id = '{VIDEO}'" for name in _FACTS)


@query(" UNION ALL ".join(map(_fact_rows, _FACTS)))
def warehouse_current_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the current views show: the facts of the newest run alone."""
    store = _warehouse(spark, sf_dir)
    out = []
    for name, (_, own, count) in _FACTS.items():
        day = F.col("comment_date").cast("string") if name.startswith("daily") else F.lit(None).cast("string")
        columns = F.lit(name).alias("fact"), "video_id", day.alias("comment_date"), F.col(own).alias("id"), "comment_count", F.col(count).alias("named"), F.col("comment_share_of_voice").alias("share")
        out.append(spark.table(store.name(name)).select(*columns, scalars.iso_text(F.col("snapshot_at")).alias("snapshot")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(_own_facts())
def duckdb_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same snapshots loaded twice into a DuckDB file, whose path has an apostrophe; driver-side, as many rows as one video has."""
    import duckdb

    from voxtally.warehouse.duckdb_store import DuckDbWarehouse

    loads = _snapshots(spark, sf_dir, VIDEO)
    with tempfile.TemporaryDirectory(prefix="it's ") as place:
        store = DuckDbWarehouse(f"{place}/gold.duckdb")
        for _ in range(2):
            store.load_snapshots(loads)
        rows = []
        with duckdb.connect(f"{place}/gold.duckdb") as connection:
            for name, (_, own, count) in _FACTS.items():
                day = "CAST(comment_date AS VARCHAR)" if name.startswith("daily") else "NULL"
                rows += connection.execute(f"SELECT '{name}', video_id, {day}, {own}, comment_count, {count}, comment_share_of_voice, strftime(snapshot_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' FROM gold_{name}").fetchall()
    return spark.createDataFrame(rows, "fact string, video_id string, comment_date string, id string, comment_count bigint, named bigint, share double, snapshot string")


# --- manifests ---


_WEEKS = """w AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, min(ts) AS a, max(ts) AS b, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY a DESC) AS place FROM w),
s AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM r)"""
_WEEKLY = "weeklyruns_"


def _weekly_manifests(spark: SparkSession, sf_dir: str, base: str) -> None:
    """A manifest for each week of events, as many as there are weeks; weeks with an odd number of events failed."""
    week = F.date_trunc("week", "ts").cast("date").cast("string")
    weeks = views.table(spark, sf_dir, "events").groupBy(week.alias("week")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).collect()
    for w in weeks:
        failed = w["n"] % 2 == 1
        manifest = dict.fromkeys(("parameters", "dictionary_versions", "artifacts"), {}) | {"schema_version": manifests.VERSION, "run_id": w["week"], "status": "failed" if failed else "succeeded", "video_id": _WEEKLY, "started_at": w["a"].replace(tzinfo=UTC), "completed_at": w["b"].replace(tzinfo=UTC), "execution_time_seconds": 0.5, "counts": {"events": w["n"]}}
        manifests.write(manifest | ({"failure": {"stage": "transformation", "error_type": "ValueError"}} if failed else {}), base)


@query(f"""WITH {_WEEKS} SELECT CAST(place AS INTEGER) AS place, week AS run_id, status, strftime(a, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at, strftime(b, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at, n AS events,
CASE WHEN status = 'failed' THEN 'transformation' END AS failed_stage, place = 1 AS newest, status = 'succeeded' AND row_number() OVER (PARTITION BY status ORDER BY place) = 1 AS newest_successful FROM s""")
def manifest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly manifests, written, read back newest first and summed up."""
    out = []
    with tempfile.TemporaryDirectory() as base:
        _weekly_manifests(spark, sf_dir, base)
        newest, good = manifests.latest(_WEEKLY, base), manifests.latest(_WEEKLY, base, succeeded=True)
        for place, m in enumerate(manifests.history(_WEEKLY, manifests.MOST_HISTORY, base), 1):
            said = manifests.summary(m)
            instants = [m[n].astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00") for n in ("started_at", "completed_at")]
            out.append((place, said["run_id"], said["status"], *instants, said["counts"]["events"], said.get("failure", {}).get("stage"), m == newest, m == good))
    return spark.createDataFrame(out, "place int, run_id string, status string, started_at string, completed_at string, events bigint, failed_stage string, newest boolean, newest_successful boolean")


@query(f"WITH {_WEEKS} SELECT asked, run_id, status, events FROM (SELECT 'newest' AS asked, week AS run_id, status, n AS events FROM s WHERE place = 1 UNION ALL SELECT * FROM (SELECT 'successful', week, status, n FROM s WHERE status = 'succeeded' ORDER BY place LIMIT 1) UNION ALL SELECT 'history', week, status, n FROM s WHERE place <= 3)")
def cli_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints of the newest run, the newest successful one, and the last three, for a video named by its address."""
    out = []
    with tempfile.TemporaryDirectory() as base:
        _weekly_manifests(spark, sf_dir, f"{base}/runs")
        for asked, more in (("newest", []), ("successful", ["--latest-successful"]), ("history", ["--history", "3"])):
            with contextlib.redirect_stdout(io.StringIO()) as said:
                cli.main(["--base", base, "summary", f"https://youtu.be/{_WEEKLY}?t=1", *more])
            found = json.loads(said.getvalue()) or []
            out += [(asked, m["run_id"], m["status"], m["counts"]["events"]) for m in (found if isinstance(found, list) else [found])]
    return spark.createDataFrame(out, "asked string, run_id string, status string, events bigint")


#: Changes that a manifest doesn't survive, with what is said then: on its check, or only when its tables are to be loaded.
_BREAKS: list[tuple[dict, str, bool]] = [
    ({}, "", False),
    ({"schema_version": 2}, "Unsupported run manifest schema_version", False),
    ({"status": "done"}, "Run manifest status must be succeeded or failed", False),
    ({"run_id": " "}, "run_id must be a non-empty string", False),
    ({"started_at": AT.replace(tzinfo=None)}, "started_at must be timezone-aware", False),
    ({"completed_at": AT - timedelta(days=1)}, "completed_at must not precede started_at", False),
    ({"execution_time_seconds": True}, "execution_time_seconds must be non-negative", False),
    ({"counts": []}, "counts must be an object", False),
    ({"more": 1}, "Run manifest schema mismatch", False),
    ({"dictionary_versions": {"entity": "e"}}, "dictionary_versions must contain entity and topic", True),
    ({"artifacts": {}}, "Missing Gold artifact location: gold_video_entity_sov", True),
    ({"status": "failed", "failure": {"stage": "s", "error_type": "E"}}, "Only succeeded run manifests can be loaded", True),
]


def _said(action: Callable[[dict], object], manifest: dict) -> str:
    try:
        action(manifest)
    except ValueError as e:
        return str(e)
    return ""


def _cases(values: list[str]) -> str:
    return f"CASE n_nationkey % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"SELECT n_nationkey, {_cases(['' if late else words for _, words, late in _BREAKS])} AS checked, {_cases([words for _, words, _ in _BREAKS])} AS loaded FROM nation")
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a manifest that is broken in one way, for each nation in turn."""
    good = {"schema_version": 1, "run_id": "r", "status": "succeeded", "video_id": "v", "started_at": AT, "completed_at": AT, "execution_time_seconds": 1, "parameters": {}, "dictionary_versions": {"entity": "e", "topic": "t"}, "counts": {}, "artifacts": {a: "/p" for a, _ in manifests.GOLD_ARTIFACTS.values()}}
    rows = []
    for r in views.table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        broken = good | _BREAKS[r["n_nationkey"] % len(_BREAKS)][0]
        rows.append((r["n_nationkey"], _said(manifests.check, broken), _said(manifests.snapshot_loads, broken)))
    return spark.createDataFrame(rows, "n_nationkey int, checked string, loaded string")


# --- dictionaries ---


def _spelled(dictionary: Dictionary) -> list[tuple]:
    return [(t.kind, t.id, t.group_id, place, s, p) for t in dictionary.terms for place, (s, p) in enumerate(zip(t.spellings, t.patterns, strict=True))]


def _spelling_sql() -> str:
    sql = [f"SELECT '{kind}' AS kind, '{own}' AS id, {f"'{group}'" if group else 'NULL'} AS group_id, {place} AS place, '{s}' AS spelling, count(*) FILTER ({registry._matches(p)}) AS comments FROM docs" for d in (ENTITIES, TOPICS) for kind, own, group, place, s, p in _spelled(d)]
    return f"WITH {COMMENTS} " + " UNION ALL ".join(sql)


@query(_spelling_sql())
def dictionary_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings of both dictionaries, loaded from JSON files, with the comments in which each stands."""
    with tempfile.TemporaryDirectory() as base:
        raw = {"entities": views.ENTITY_TERMS, "topics": views.TOPIC_TERMS}
        for name, document in raw.items():
            Path(base, name).write_text(json.dumps(document, ensure_ascii=False), "utf-8")
        spelled = _spelled(load_entities(Path(base, "entities"))) + _spelled(load_topics(Path(base, "topics")))
    text = F.col(matching.NORMAL)
    counts = views.normal_comments(spark, sf_dir).agg(*(F.count_if(matching.stands_in(text, p)).alias(f"n{i}") for i, (*_, p) in enumerate(spelled)))
    terms = [F.struct(*(F.lit(v).cast(kind).alias(n) for n, v, kind in zip(("kind", "id", "group_id", "place", "spelling"), t, ("string", "string", "string", "int", "string"), strict=False)), F.col(f"n{i}").alias("comments")) for i, t in enumerate(spelled)]
    return counts.select(F.explode(F.array(*terms)).alias("x")).select("x.*")


# --- the API, and a whole run over it ---


def small_api(options: dict) -> rest.Client:
    """A client of an API that serves the items of its options, by parent, in pages; its first answer each time is an error that passes."""
    items = json.loads(options["items"])
    asked: list[str] = []

    def transport(url: str, params: dict, timeout: float) -> tuple[int, object]:
        asked.append(url)
        if len(asked) == 1:
            return 503, None
        if url.endswith("videos"):
            return 200, {"items": [{"id": params["id"], "count": len(items)}]}
        own = items if "videoId" in params else [i for i in items if i["parent"] == params["parentId"]]
        first, size = int(params.get("pageToken", 0)), params["maxResults"]
        return 200, {"items": own[first : first + size]} | ({"nextPageToken": str(first + size)} if first + size < len(own) else {})

    return rest.Client("key", transport, lambda seconds: None)


_NATIONS = "n AS (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation)"


@query(f"""WITH {_NATIONS} SELECT 'comments' AS resource, 'v' AS id, CAST(i // 10 + 1 AS INTEGER) AS page_number, n_name AS item FROM n WHERE i < 20
UNION ALL SELECT 'replies', CAST(n_regionkey AS VARCHAR), CAST(j // 2 + 1 AS INTEGER), n_name FROM n WHERE j < 4 UNION ALL SELECT 'videos', 'v', 1, CAST(count(*) AS VARCHAR) FROM n""")
def rest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads, replies and a video's metadata by the data source, in pages up to a number; nations are served as comments of their regions."""
    spark.dataSource.register(rest.ApiPages)
    nations = views.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale
    items = json.dumps([{"name": r["n_name"], "parent": str(r["n_regionkey"])} for r in nations])
    read = spark.read.format("api_pages").option("client", f"{__name__}:small_api").option("items", items).option("max_pages", 2)
    regions = ",".join(sorted({str(r["n_regionkey"]) for r in nations}))
    parts = [read.option("ids", "v").option("resource", "comments").option("page_size", 10).load(), read.option("ids", regions).option("resource", "replies").option("page_size", 2).load(), read.option("ids", "v").option("resource", "videos").load()]
    body = F.from_json("body", "struct<items: array<struct<name: string, count: string>>>")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("resource", "id", "page_number", F.explode(body["items"]).alias("item")).withColumn("item", F.coalesce("item.name", "item.count"))


#: Answers of an API that fails, with the error that a client raises, and how often it asks.
_ANSWERS = [
    (429, None, "RateLimited", 3), (403, "rateLimitExceeded", "RateLimited", 3), (403, "quotaExceeded", "QuotaExceeded", 1), (403, "commentsDisabled", "CommentsDisabled", 1),
    (404, "videoNotFound", "VideoNotFound", 1), (404, "commentNotFound", "CommentNotFound", 1), (503, None, "HttpError", 3), (400, "badRequest", "HttpError", 1), (200, None, "", 1),
]


@query(f"SELECT n_nationkey, {_cases([a[2] for a in _ANSWERS])} AS error, CAST({_cases([str(a[3]) for a in _ANSWERS])} AS INTEGER) AS asked FROM nation")
def rest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that a client raises for each kind of answer, and how often it asks before."""
    rows = []
    for r in views.table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        status, reason, _, _ = _ANSWERS[r["n_nationkey"] % len(_ANSWERS)]
        asked: list[str] = []

        def transport(url: str, params: dict, timeout: float, status=status, reason=reason, asked=asked) -> tuple[int, object]:  # noqa: ANN001
            asked.append(url)
            return status, {"error": {"errors": [{"reason": reason}]}} if status >= 400 else {"items": []}

        error = ""
        try:
            rest.Client("key", transport, lambda seconds: None).comments(r["n_name"])
        except rest.ApiError as e:
            error = type(e).__name__
        rows.append((r["n_nationkey"], error, len(asked)))
    return spark.createDataFrame(rows, "n_nationkey int, error string, asked int")


_RUN_VIDEO = "nations_run"


def _run_terms() -> tuple[Dictionary, Dictionary]:
    head = {"schema_version": 1, "dictionary_version": "runs_v1", "description": "Names of nations."}
    entities = entity_dictionary(head | {"groups": [{"group_id": "u", "canonical_name": "united", "aliases": []}], "members": [{"member_id": "fr", "group_id": "u", "canonical_name": "france", "aliases": []}]})
    return entities, topic_dictionary(head | {"topics": [{"topic_id": "region", "display_name": "Region", "keywords": ["region 1", "region 3"]}]})


@query("""WITH n AS (SELECT lower(n_name) AS t, n_regionkey AS r FROM nation), c AS (SELECT count(*) AS n, count(*) FILTER (r = 2) AS edited, count(*) FILTER (regexp_matches(t, '\\bunited\\b')) AS united, count(*) FILTER (t = 'france') AS france, count(*) FILTER (r IN (1, 3)) AS named FROM n)
SELECT run, counter, CAST(n AS BIGINT) AS n FROM (SELECT 1 AS run, 'records_parsed' AS counter, n FROM c UNION ALL SELECT 2, 'records_parsed', n FROM c UNION ALL SELECT 1, 'existing_silver_records', 0 FROM c UNION ALL SELECT 2, 'existing_silver_records', n FROM c
UNION ALL SELECT 1, 'silver_records_written', n FROM c UNION ALL SELECT 2, 'silver_records_written', edited FROM c UNION ALL SELECT run, 'merged_silver_records', n FROM c, (VALUES (1), (2)) AS x(run)
UNION ALL SELECT run, 'entity_mention_records', united + france FROM c, (VALUES (1), (2)) AS x(run) UNION ALL SELECT run, 'topic_records', named FROM c, (VALUES (1), (2)) AS x(run))""")
def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole runs from the API to the manifest. Nations are comments that name their region; for the second run those of region 2 were edited."""
    from voxtally.plans.pipeline import Settings, run

    nations = views.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale
    entities, topics = _run_terms()
    with tempfile.TemporaryDirectory() as base:
        for day in (0, 1):
            items = []
            for r in nations:
                edited = " edited" if day and r["n_regionkey"] == 2 else ""
                snippet = {"videoId": _RUN_VIDEO, "textOriginal": f"{r['n_name']}, region {r['n_regionkey']}{edited}", "likeCount": 1, "publishedAt": "2024-01-01T00:00:00Z", "updatedAt": "2024-01-02T00:00:00Z"}
                own = f"c{r['n_nationkey']}"
                items.append({"id": own, "parent": "", "snippet": {"totalReplyCount": 0, "topLevelComment": {"id": own, "snippet": snippet}}})
            client = small_api({"items": json.dumps(items)})
            run(spark, client, Settings(_RUN_VIDEO, 3, 10, base), entities, topics, lambda day=day: AT + timedelta(days=day))
        done = manifests.history(_RUN_VIDEO, 2, f"{base}/runs")
    counters = ("records_parsed", "existing_silver_records", "silver_records_written", "merged_silver_records", "entity_mention_records", "topic_records")
    return spark.createDataFrame([(2 - i, c, m["counts"][c]) for i, m in enumerate(done) for c in counters], "run int, counter string, n bigint")


# --- texts in SQL and in patterns, strict integers ---


@query("SELECT n_nationkey, 'it' || chr(39) || 's \\' || n_name || chr(39) || ' \\n' AS said FROM nation")
def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and backslashes that went through SQL as literals, under a quoted name."""
    rows = [(r["n_nationkey"], f"it's \\{r['n_name']}' \\n") for r in views.table(spark, sf_dir, "nation").collect()]  # 25 rows at any scale
    each = [f"SELECT {key} AS {scalars.identifier('n_nationkey')}, {scalars.literal(text)} AS {scalars.identifier('said')}" for key, text in rows]
    return spark.sql(" UNION ALL ".join(each))


@query("SELECT doc_id, len(string_split(text, '.')) - 1 AS dots, len(string_split(text, '***')) - 1 AS stars, len(string_split(text, '$$$')) - 1 AS dollars FROM documents")
def escaped_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often texts hold what patterns read otherwise, by escaped patterns."""
    count = lambda term: F.regexp_count("text", F.lit(quoted(term))).cast("bigint")
    return views.table(spark, sf_dir, "documents").select("doc_id", count(".").alias("dots"), count("***").alias("stars"), count("$$$").alias("dollars"))


@query("SELECT event_id, event_id % 5 = 0 AS whole FROM events")
def strict_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values of which one in five is an integer as JSON has it: 5, 5.5, "5", true and null."""
    k = F.get_json_object("props", "$.k")
    forms = [k, F.concat(k, F.lit(".5")), F.concat(F.lit('"'), k, F.lit('"')), F.lit("true"), F.lit("null")]
    value = F.parse_json(F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int")))
    return views.table(spark, sf_dir, "events").select("event_id", F.coalesce(scalars.is_integer(value), F.lit(False)).alias("whole"))
