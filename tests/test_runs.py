import json
from datetime import UTC, datetime, timedelta

import pytest

from voxtally import cli
from voxtally.plans.pipeline import Settings, run
from voxtally.sinks import files
from voxtally.sources import landing, manifests, rest
from voxtally.sources.dictionaries import entity_dictionary, topic_dictionary
from voxtally.warehouse.store import SparkWarehouse, SnapshotLoad, check_loads

VIDEO = "abcdefghijk"
ENTITIES = entity_dictionary({"schema_version": 1, "dictionary_version": "e1", "description": "d", "groups": [{"group_id": "g", "canonical_name": "BAND", "aliases": ["밴드"]}], "members": [{"member_id": "m", "group_id": "g", "canonical_name": "Mia", "aliases": ["美"]}]})
TOPICS = topic_dictionary({"schema_version": 1, "dictionary_version": "t1", "description": "d", "topics": [{"topic_id": "vocal", "display_name": "Vocal", "keywords": ["vocal"]}]})


def thread(own, text, updated="2026-08-19T09:00:00Z", likes=1, author="x"):
    snippet = {"videoId": VIDEO, "textOriginal": text, "likeCount": likes, "publishedAt": "2026-08-19T08:00:00Z", "updatedAt": updated}
    return {"id": own, "snippet": {"totalReplyCount": 0, "topLevelComment": {"id": own, "snippet": snippet | ({"authorDisplayName": author} if author else {})}}}


class Transport:
    """Answers from prepared pages, and notes what was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, params, timeout):
        self.asked.append((url.rsplit("/", 1)[1], params, timeout))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer if isinstance(answer, tuple) else (200, answer)


def failing(status, reason=None):
    return status, {"error": {"errors": [{"reason": reason}]}} if reason else None


def test_retries_and_errors():
    slept = []
    client = lambda *a: rest.Client("k", Transport(*a), slept.append)
    assert client(TimeoutError(), failing(503), {"items": []}).comments("v") == {"items": []} and slept == [1, 2]
    for answer, kind in ((failing(403, "quotaExceeded"), rest.QuotaExceeded), (failing(403, "commentsDisabled"), rest.CommentsDisabled), (failing(404, "videoNotFound"), rest.VideoNotFound), (failing(404, "commentNotFound"), rest.CommentNotFound), (failing(400), rest.HttpError)):
        transport = Transport(answer)
        with pytest.raises(kind) as e:
            rest.Client("k", transport, slept.append).comments("v")
        assert len(transport.asked) == 1 and e.value.status == answer[0] and e.value.resource_id == "v"
    for answer, kind in ((failing(429), rest.RateLimited), (failing(403, "rateLimitExceeded"), rest.RateLimited), (failing(500), rest.HttpError), (ConnectionError(), ConnectionError)):
        transport = Transport(answer, answer, answer)
        with pytest.raises(kind):
            rest.Client("k", transport, slept.append).comments("v")
        assert len(transport.asked) == 3
    with pytest.raises(ValueError, match="key"):
        rest.Client(None, Transport()).video("v")
    for body in (None, [], {"error": 1}, {"error": {"errors": []}}, {"error": {"errors": [{"reason": 5}]}}):
        assert rest.reason_of(body) is None


def test_paging():
    transport = Transport({"items": [1], "nextPageToken": "b"}, {"items": [2], "nextPageToken": "c"}, {"items": [3]})
    client = rest.Client("k", transport)
    assert [n for n, _ in rest.pages(client.comments, "v", 2, 10)] == [1, 2]
    assert transport.asked[1][1]["pageToken"] == "b" and transport.asked[0] == ("commentThreads", {"part": "snippet", "videoId": "v", "maxResults": 10, "textFormat": "plainText", "key": "k"}, 30)
    assert [n for n, _ in rest.pages(client.replies, "p", 9, 100)] == [1]


def fake_client(options):
    """For the data source: three pages for each id."""

    class Fake:
        def comments(self, own, max_results, page_token):
            n = int(page_token or 0)
            return {"items": [own, n]} | ({"nextPageToken": str(n + 1)} if n < 2 else {})

        def video(self, own):
            return {"video": own}

    return Fake()


def test_data_source(spark):
    spark.dataSource.register(rest.ApiPages)
    read = spark.read.format("api_pages").option("ids", "a, b").option("client", f"{__name__}:fake_client").option("max_pages", 5)
    rows = read.load()
    assert sorted((x.id, x.page_number, json.loads(x.body)["items"][1]) for x in rows.collect()) == [(i, n + 1, n) for i in "ab" for n in range(3)]
    assert {x.body for x in read.option("resource", "videos").load().collect()} == {'{"video": "a"}', '{"video": "b"}'}


def at(day):
    return datetime(2026, 8, day, 12, tzinfo=UTC)


def do_run(spark, base, day, *pages, entities=ENTITIES):
    client = rest.Client("k", Transport({"items": [{}]}, *pages), lambda s: None)
    return manifests.read(run(spark, client, Settings(VIDEO, 3, 10, str(base)), entities, TOPICS, lambda: at(day)))


def test_a_run_is_repeatable_and_publishes_at_once(spark, tmp_path):
    first = {"items": [thread("1", "BAND 美 vocal"), thread("2", "mia", author=None)], "nextPageToken": "n"}
    second = {"items": [thread("3", "bands", likes=-1), thread("4", "quiet"), thread("4", "quiet")]}
    one = do_run(spark, tmp_path, 20, first, second)
    assert one["counts"] == {
        "raw_comment_pages": 2, "records_parsed": 5, "valid_records": 2, "rejected_records": 3, "existing_silver_records": 0, "merged_silver_records": 2, "silver_records_written": 2,
        "entity_mention_records": 3, "group_mention_records": 1, "member_mention_records": 2, "video_entity_sov_records": 2, "daily_entity_sov_records": 2, "topic_records": 1,
        "video_topic_metrics_records": 1, "daily_topic_metrics_records": 1,
    }
    rejected = spark.read.json(one["artifacts"]["rejected_comments"])
    assert sorted(x.validation_errors[0] for x in rejected.collect()) == ["comment_id must be unique within the batch"] * 2 + ["like_count must be non-negative"]
    again = do_run(spark, tmp_path, 21, {"items": [thread("1", "BAND 美 vocal"), thread("2", "mia", author=None)]})
    assert again["counts"]["silver_records_written"] == 0 and again["artifacts"]["silver_comments"] is None and again["counts"]["merged_silver_records"] == 2
    changed = do_run(spark, tmp_path, 22, {"items": [thread("1", "nobody", updated="2026-08-20T09:00:00Z"), thread("5", "밴드")]})
    assert changed["counts"]["silver_records_written"] == 2 and changed["counts"]["merged_silver_records"] == 3 and changed["counts"]["existing_silver_records"] == 2
    gold = {x.entity_id: x for x in spark.read.json(changed["artifacts"]["gold_video_entity_sov"]).collect()}
    assert (gold["g"].mention_comment_count, gold["m"].mention_comment_count, gold["g"].comment_count) == (1, 1, 3)
    assert landing.read_silver(spark, f"{tmp_path}/silver/comments", VIDEO).count() == 4

    store = SparkWarehouse(spark, f"gold_{tmp_path.name.replace('-', '_')}")
    result = cli.load_newest(spark, VIDEO, str(tmp_path), store.schema.strip("`"))
    assert result["loaded_rows"] == {"video_entity_sov": 2, "daily_entity_sov": 2, "video_topic_metrics": 1, "daily_topic_metrics": 1}
    view = lambda: {(x.entity_id, x.mention_comment_count) for x in spark.table(store.name("video_entity_sov")).collect()}
    assert view() == {("g", 1), ("m", 1)}
    # a published run is immutable: its files are not read again
    loads = manifests.snapshot_loads(changed)
    assert store.load_snapshots([SnapshotLoad(**{**x.__dict__, "source_uri": "/nowhere"}) for x in loads]) == result["loaded_rows"]
    # one bad table keeps the whole run invisible
    later = [SnapshotLoad(**{**x.__dict__, "run_id": "later", "run_started_at": x.run_started_at + timedelta(days=9)}) for x in loads]
    bad = [SnapshotLoad(**{**x.__dict__, "dictionary_version": "other"}) if x.table_name == "daily_topic_metrics" else x for x in later]
    with pytest.raises(ValueError, match="another video or dictionary version"):
        store.load_snapshots(bad)
    assert view() == {("g", 1), ("m", 1)} and store.published_counts("later", VIDEO) is None
    # no rows replace rows
    quiet = tmp_path / "empty.json"
    quiet.write_text("")
    empty = [SnapshotLoad(**{**x.__dict__, "source_uri": str(quiet)}) for x in later]
    assert set(store.load_snapshots(empty).values()) == {0} and view() == set()
    for broken in (later[:3], [*later[:3], bad[0]], [later[0], *loads[1:]]):
        with pytest.raises(ValueError):
            check_loads(broken)
    spark.sql(f"DROP SCHEMA {store.schema} CASCADE")

    from voxtally.warehouse.duckdb_store import DuckDbWarehouse

    duck = DuckDbWarehouse(tmp_path / "gold.duckdb")
    shares = lambda: duck_rows(tmp_path / "gold.duckdb", "SELECT entity_id, mention_comment_count FROM gold_video_entity_sov ORDER BY ALL")
    for _ in range(2):
        assert duck.load_snapshots(loads) == result["loaded_rows"] and shares() == [("g", 1), ("m", 1)]
    with pytest.raises(ValueError, match="another video or dictionary version"):
        duck.load_snapshots(bad)
    assert shares() == [("g", 1), ("m", 1)]
    assert set(duck.load_snapshots(empty).values()) == {0} and shares() == []
    with pytest.raises(FileNotFoundError):
        duck.load_snapshots([SnapshotLoad(**{**x.__dict__, "source_uri": "/nowhere"}) for x in loads])


def duck_rows(database, sql):
    import duckdb

    with duckdb.connect(str(database), read_only=True) as connection:
        return connection.execute(sql).fetchall()


def test_snapshots_with_wrong_fields_are_refused(spark, tmp_path):
    row = {"video_id": VIDEO, "topic_id": "vocal", "display_name": "Vocal", "dictionary_version": "t1", "comment_count": 1, "topic_comment_count": 1, "comment_share_of_voice": 1.0, "topic_comment_count_total": 1, "topic_share_of_voice": 1.0, "snapshot_at": "2026-01-01T00:00:00+00:00"}
    from voxtally.warehouse.store import read_snapshot

    def load(change):
        place = tmp_path / "s.json"
        place.write_text(json.dumps(row | change) + "\n")
        return read_snapshot(spark, SnapshotLoad("video_topic_metrics", str(place), "r", at(1), VIDEO, "t1"))

    assert load({}).count() == 1
    for change, message in (({"more": 1}, "unknown fields: more"), ({"display_name": None}, "null in display_name"), ({"topic_share_of_voice": 0.5}, "does not match"), ({"video_id": "other"}, "another video")):
        with pytest.raises(ValueError, match=message):
            load(change)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        load({"comment_count": "many"}).collect()


def test_failures_leave_a_manifest(spark, tmp_path):
    def failed(*answers):
        with pytest.raises(Exception) as e:
            client = rest.Client("k", Transport(*answers), lambda s: None)
            run(spark, client, Settings(VIDEO, 3, 10, str(tmp_path)), ENTITIES, TOPICS, lambda: at(20))
        return e.value, manifests.latest(VIDEO, tmp_path / "runs")

    error, manifest = failed(failing(404, "videoNotFound"))
    assert isinstance(error, rest.VideoNotFound) and manifest["failure"] == {"stage": "video_metadata_ingestion", "error_type": "VideoNotFound"}
    _, manifest = failed({"items": []}, failing(403, "commentsDisabled"))
    assert manifest["failure"]["stage"] == "comment_ingestion" and manifest["counts"] == {"raw_comment_pages": 0}
    naive = thread("1", "x")
    naive["snippet"]["topLevelComment"]["snippet"]["updatedAt"] = "2026-08-19T09:00:00"
    _, manifest = failed({"items": []}, {"items": [naive]})
    assert manifest["failure"]["stage"] == "transformation" and manifest["status"] == "failed"
    with pytest.raises(ValueError, match="No successful run"):
        cli.load_newest(spark, VIDEO, str(tmp_path))


def manifest(day, status="succeeded"):
    names = [a for a, _ in manifests.GOLD_ARTIFACTS.values()]
    base = {"schema_version": 1, "run_id": f"r{day}", "status": status, "video_id": VIDEO, "started_at": at(day), "completed_at": at(day) + timedelta(seconds=2), "execution_time_seconds": 2.0, "parameters": {}, "dictionary_versions": {"entity": "e", "topic": "t"}, "counts": {}, "artifacts": dict.fromkeys(names, "/p")}
    return base | ({"failure": {"stage": "s", "error_type": "E"}} if status == "failed" else {})


def test_manifests(tmp_path, capsys):
    for day, status in ((1, "succeeded"), (2, "succeeded"), (3, "failed")):
        manifests.write(manifest(day, status), tmp_path / "runs")
    assert manifests.latest(VIDEO, tmp_path / "runs")["run_id"] == "r3" and manifests.latest(VIDEO, tmp_path / "runs", True)["run_id"] == "r2"
    assert [m["run_id"] for m in manifests.history(VIDEO, 2, tmp_path / "runs")] == ["r3", "r2"]
    assert manifests.latest("zzzzzzzzzzz", tmp_path / "runs") is None
    for limit in (0, 101, True, "5"):
        with pytest.raises(ValueError):
            manifests.history(VIDEO, limit, tmp_path / "runs")
    with pytest.raises(ValueError):
        manifests.files("short", tmp_path)
    assert len(manifests.snapshot_loads(manifest(1))) == 4
    for change in ({"status": "done"}, {"schema_version": 2}, {"run_id": " "}, {"completed_at": at(1) - timedelta(days=1)}, {"started_at": datetime(2026, 1, 1)}, {"execution_time_seconds": True}, {"counts": []}, {"more": 1}):
        with pytest.raises(ValueError):
            manifests.check(manifest(1) | change)
    for change in ({"dictionary_versions": {"entity": "e"}}, {"artifacts": {}}, {"dictionary_versions": {"entity": "e", "topic": " "}}):
        with pytest.raises(ValueError):
            manifests.snapshot_loads(manifest(1) | change)
    with pytest.raises(ValueError, match="succeeded"):
        manifests.snapshot_loads(manifest(1, "failed"))
    assert "failure" in manifests.summary(manifest(3, "failed")) and "schema_version" not in manifests.summary(manifest(1))
    assert cli.main(["--base", str(tmp_path), "summary", f"https://youtu.be/{VIDEO}", "--latest-successful"]) == 0
    assert json.loads(capsys.readouterr().out)["run_id"] == "r2"
    for bad in (["summary", "nope"], ["summary", VIDEO, "--history", "0"], ["summary", VIDEO, "--history", "2", "--latest-successful"], ["run", VIDEO, "--max-pages", "101", "--entities", "e", "--topics", "t"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_sinks(spark, tmp_path):
    page = files.write_page({"items": []}, VIDEO, 3, at(1), tmp_path)
    assert page.name == "20260801T120000000000Z_page_0003.json" and page.parent.name == "2026-08-01"
    assert "parent_ca978112ca1bbdca_page_0001" in files.write_replies({}, VIDEO, "a", 1, at(1), tmp_path).name
    assert not list(tmp_path.rglob("*.tmp"))
    df = spark.createDataFrame([(None, "é", at(1))], "a string, b string, t timestamp")
    place, n = files.append_rows(df, str(tmp_path / "log"), at(1), "x")
    assert n == df.count() and files.append_rows(df.limit(0), str(tmp_path / "log"), at(1), "x") == (place, 0)  # what was there stays
    text = spark.read.text(place).first()[0]
    assert json.loads(text) == {"a": None, "b": "é", "t": "2026-08-01T12:00:00.000000+00:00"} and "é" in text
    assert files.append_rows(df.limit(0), str(tmp_path / "log"), at(2), "x") == (None, 0)
    for rows in (df, df.limit(0)):
        place, _ = files.replace_snapshot(rows, str(tmp_path / "snap"), "v", VIDEO, "current")
        assert spark.read.text(place).count() == rows.count()
    silver = landing.read_silver(spark, str(tmp_path / "nothing"))
    assert silver.isEmpty() and "source_file" in silver.columns


def test_silver_timestamps_need_an_offset(spark, tmp_path):
    (tmp_path / VIDEO / "2026-01-01").mkdir(parents=True)
    (tmp_path / VIDEO / "2026-01-01" / "1_comments.json").write_text(json.dumps({"comment_id": "1", "published_at": "2026-01-01T00:00:00"}) + "\n")
    with pytest.raises(Exception, match="must include timezone"):
        landing.read_silver(spark, str(tmp_path)).select("published_at").collect()


def test_stream_folds_as_a_batch_does(spark, tmp_path):
    from voxtally.schemas import COMMENT
    from voxtally.streaming.incremental import daily_counts, fold_stream

    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def batch(rows, n):
        data = [(i, "v", None, text, 1, 0, at(1), at(u), at(20 + n)) for i, text, u in rows]
        spark.createDataFrame(data, COMMENT).coalesce(1).write.mode("append").parquet(source)
        fold_stream(spark.readStream.schema(COMMENT).parquet(source), log, str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination()

    batch([("1", "a", 2), ("2", "a", 2)], 1)
    batch([("1", "a", 2), ("2", "b", 3), ("3", "x", 30), ("4", "d", 2), ("4", "d", 2)], 2)
    got = {(x.comment_id, x.comment_text, x.batch) for x in spark.read.parquet(log).select("comment_id", "comment_text", "batch").collect()}
    assert got == {("1", "a", 0), ("2", "a", 0), ("2", "b", 1)}
    assert {x.comment_id for x in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"3", "4"}
    counts = daily_counts(spark.readStream.schema(COMMENT).parquet(source)).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert [(str(x.day), x.comment_count) for x in spark.table("days").collect()] == [("2026-08-01", 7)]
