"""Facts, versions and distinct sets that are kept up to date, against recomputation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxtally.operators import distinct, matching, metrics, versions
from voxtally.plans import maintained
from voxtally.sources.dictionaries import entity_dictionary
from voxtally.streaming import keyed
from voxtally.warehouse.facts import FactStore

ENTITIES = entity_dictionary({"schema_version": 1, "dictionary_version": "e1", "description": "d", "groups": [{"group_id": "g", "canonical_name": "one", "aliases": []}, {"group_id": "h", "canonical_name": "two", "aliases": []}], "members": [{"member_id": "m", "group_id": "g", "canonical_name": "three", "aliases": ["drei"]}]})
SCHEMA = "comment_id string, video_id string, comment_text string, published_at timestamp, updated_at timestamp, ingested_at timestamp"


def batches_of(r, n=4, keys=25):
    """Batches with edits, moves to other days and videos, copies, late versions, and several versions of a comment in a batch."""
    base = datetime(2026, 1, 1)
    out = []
    for batch in range(n):
        rows = []
        for _ in range(keys):
            for _ in range(r.choice((1, 1, 2))):
                text = " ".join(r.choices(["one", "two", "three", "drei", "none"], k=r.randint(0, 3)))
                rows.append((f"c{r.randrange(keys)}", f"v{r.randrange(2)}", text, base + timedelta(days=r.randint(0, 2)), base + timedelta(days=r.randint(3, 5)), base + timedelta(days=10 + batch + r.choice((0, 0, -2)), seconds=len(rows))))
        out.append(rows)
    return out


def test_facts_equal_recomputation_after_each_batch(spark, tmp_path):
    r = random.Random(21)
    store = FactStore(spark, str(tmp_path / "facts"), ENTITIES)
    arrived = None
    for number, rows in enumerate([*batches_of(r), []]):
        batch = spark.createDataFrame(rows, SCHEMA)
        store.apply(number, batch)
        if number == 1:  # a batch that runs again, and one that was never committed, change nothing
            store.apply(number, batch)
            store._write(spark.createDataFrame([("v0", datetime(2026, 1, 1).date(), datetime(2026, 1, 1), 99)], "video_id string, comment_date date, ingested_at timestamp, n long"), "comments", 77)
        mark = F.format_string("%02d", F.lit(number))
        batch = batch.withColumn(versions.ORDINAL, F.concat(mark, F.date_format("ingested_at", "yyyyMMddHHmmss")))
        arrived = batch if arrived is None else arrived.unionByName(batch)
        standing = versions.latest_versions(arrived, "comment_id", F.col(versions.ORDINAL)).drop(versions.ORDINAL)
        text = matching.with_normal_text(standing)
        for daily in (False, True):
            want = metrics.shares(text, matching.hit_rows(text, ENTITIES, resolve=False), ENTITIES, daily)
            got = store.shares(batch.schema["ingested_at"], daily)
            assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert sorted(map(tuple, store.standing(standing.schema).select(standing.columns).collect())) == sorted(map(tuple, standing.collect()))


def test_texts_stay_out_of_the_fold(spark, tmp_path):
    """Versions are folded by digests, in the order that contents have where both times agree; terms that share an id count once."""
    shared = entity_dictionary({"schema_version": 1, "dictionary_version": "e2", "description": "d", "groups": [{"group_id": "x", "canonical_name": "one", "aliases": []}], "members": [{"member_id": "x", "group_id": "x", "canonical_name": "two", "aliases": []}]})
    store, r, at = FactStore(spark, str(tmp_path / "facts"), shared), random.Random(4), datetime(2026, 1, 1)
    rows = [(f"c{i % 30}", "v", " ".join(r.choices(["one", "two", "none", "Zwei"], k=3)), at, at, at + timedelta(days=i % 2)) for i in range(120)]
    batch = spark.createDataFrame([*rows, *rows[:9]], SCHEMA)
    store.apply(0, batch)
    standing = versions.latest_versions(batch)
    assert sorted(map(tuple, store.standing(batch.schema).select(batch.columns).collect())) == sorted(map(tuple, standing.collect()))
    text = matching.with_normal_text(standing)
    want = metrics.shares(text, matching.hit_rows(text, shared, resolve=False), shared)
    got = store.shares(batch.schema["ingested_at"]).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "comment_text" not in spark.read.parquet(f"{store.base}/versions").columns
    assert "comment_text" in spark.read.parquet(f"{store.base}/arrived").columns and spark.read.parquet(f"{store.base}/arrived").count() == 129


@pytest.mark.parametrize("chars", [None, 10**6, 12])
def test_daily_facts_of_an_automaton_in_passes(spark, tmp_path, monkeypatch, chars):
    """Terms stay in their row by expressions, by an automaton, and by one in several passes; a text is held once, and moves to another day."""
    if chars:
        monkeypatch.setattr(matching, "INLINE_SPELLINGS", 0)
        monkeypatch.setattr(matching, "AUTOMATON_CHARS", chars)
    store, r, at = FactStore(spark, str(tmp_path / "facts"), ENTITIES), random.Random(6), datetime(2026, 1, 1)
    said = [r.choice(["one", "two drei", "three one two", "", None]) for _ in range(40)]
    said = [t and f"{t} {r.randbytes(4000).hex()}" for t in said]
    first = spark.createDataFrame([(f"c{i}", "v", t, at, at, at) for i, t in enumerate(said)], SCHEMA)
    moved = spark.createDataFrame([(f"c{i}", "v", t, at + timedelta(days=1), at + timedelta(days=1), at + timedelta(days=2)) for i, t in enumerate(said[:20])], SCHEMA)
    store.apply(0, first)
    store.apply(1, moved)
    text = matching.with_normal_text(versions.latest_versions(first.unionByName(moved)))
    want = metrics.shares(text, matching.hit_rows(text, ENTITIES, resolve=False), ENTITIES, daily=True)
    assert sorted(map(tuple, store.shares(first.schema["ingested_at"], daily=True).select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    bytes_of = {log: sum(f.stat().st_size for f in (tmp_path / "facts" / log).rglob("*.parquet")) for log in ("arrived", "versions")}
    assert max(f.stat().st_size for f in (tmp_path / "facts" / "versions").rglob("*.parquet")) < 8000 < bytes_of["arrived"]  # no file of the fold has a text


def test_daily_topics_leave_no_text_on_disk(spark, tmp_path, monkeypatch):
    """The facts of the query are made of every text, but its store takes a few bytes for a comment, whatever its text's length."""
    r = random.Random(11)
    rows = [(i, f"from {r.randbytes(4000).hex()} with", "en", f"s{i % 2}", 8010) for i in range(84)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(maintained, "fresh_dir", lambda _, what: str(tmp_path / what))
    got = maintained.maintained_daily_topics(spark, str(tmp_path))
    named = {x["topic_id"]: x["n"] for x in got.where("video_id LIKE '3:%'").groupBy("topic_id").agg(F.sum("topic_comment_count").alias("n")).collect()}
    assert named == {"being": 0, "place": 84, "with": 84}
    log = spark.read.parquet(str(tmp_path / "facts" / "arrived"))
    assert "comment_text" not in log.columns and log.count() == 84 + 56 + 28 + 12
    arrived = sum(f.stat().st_size for f in (tmp_path / "facts" / "arrived").rglob("*.parquet"))
    assert arrived < 84 * 4000 / 4


def test_a_store_without_texts_has_the_same_facts(spark, tmp_path):
    """Rows that agree in both times still stand in the order of their contents, which are then read again from the batch."""
    r, at = random.Random(12), datetime(2026, 1, 1)
    one, other = FactStore(spark, str(tmp_path / "with"), ENTITIES), FactStore(spark, str(tmp_path / "without"), ENTITIES, texts=False)
    rows = [(f"c{i % 30}", "v", " ".join(r.choices(["one", "two", "none", "drei"], k=3)), at + timedelta(days=i % 3 // 2), at, at + timedelta(days=i % 2)) for i in range(120)]
    arrived = None
    for number, batch in enumerate([[*rows, *rows[:9]], *batches_of(r, 2)]):
        batch = spark.createDataFrame(batch, SCHEMA)
        for store in (one, other, other) if number == 1 else (one, other):  # a batch that runs again
            store.apply(number, batch)
        batch = batch.withColumn(versions.ORDINAL, F.concat(F.lit(str(number)), F.date_format("ingested_at", "yyyyMMddHHmmss")))
        arrived = batch if arrived is None else arrived.unionByName(batch)
        text = matching.with_normal_text(versions.latest_versions(arrived, "comment_id", F.col(versions.ORDINAL)).drop(versions.ORDINAL))
        want = metrics.shares(text, matching.hit_rows(text, ENTITIES, resolve=False), ENTITIES, daily=True)
        for store in (one, other):
            got = store.shares(batch.schema["ingested_at"], daily=True).select(want.columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    kept = other.standing(batch.schema)
    assert "comment_text" not in kept.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, one.standing(batch.schema).select(kept.columns).collect()), key=str)


def test_a_batch_reads_the_parts_of_its_comments(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"), ENTITIES)
    batch = spark.createDataFrame(batches_of(random.Random(3))[0], SCHEMA)
    store.apply(0, batch)
    part = store.standing(batch.schema).first()["part"]
    plan = store.standing(batch.schema, 1, [part])._jdf.queryExecution().executedPlan().toString()
    assert any("part#" in scan.split("PushedFilters")[0] and f"= {part}" in scan for scan in plan.split("PartitionFilters")[1:])


def test_keyed_state_folds_as_a_batch_does(spark, tmp_path):
    r = random.Random(5)
    parts = batches_of(r, 3)
    parts += [parts[1], [("c1", "v0", "late but newer", *[datetime(2026, 1, 9)] * 2, datetime(2026, 1, 2)), ("c2", "v0", "late and older", *[datetime(2025, 1, 9)] * 2, datetime(2027, 1, 2))]]
    arrived, changes = None, str(tmp_path / "changes")
    for number, rows in enumerate(parts):
        batch = spark.createDataFrame(rows, SCHEMA).withColumn("n_likes", F.lit(None).cast("double"))
        batch.write.parquet(f"{tmp_path}/landed/{number}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/landed/*")
        query = keyed.fold_keyed(stream, changes, str(tmp_path / "checkpoint"), settle=timedelta(seconds=1))
        query.awaitTermination()
        ordered = batch.withColumn(versions.ORDINAL, F.concat(F.lit(str(number)), F.date_format("ingested_at", "yyyyMMddHHmmss"), F.lit(" ")))
        arrived = ordered if arrived is None else arrived.unionByName(ordered)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    want = versions.latest_versions(arrived, "comment_id", F.col(versions.ORDINAL)).drop(versions.ORDINAL)
    got = keyed.standing(spark, changes, want.schema)
    key = lambda x: x["comment_id"]
    rows = sorted(got.collect(), key=key)
    assert [(x.comment_id, x.updated_at, x.ingested_at) for x in rows] == [(x.comment_id, x.updated_at, x.ingested_at) for x in sorted(want.collect(), key=key)]
    assert {x.comment_id: x.comment_text for x in rows}["c1"] == "late but newer"
    settled = {x.comment_id: x.settled for x in rows}
    assert not settled["c1"] and any(settled.values())  # timers fire when the next batch comes


def test_groups_of_comments_fold_as_a_batch_does(spark, tmp_path, monkeypatch):
    """Few groups of many comments: a batch that has most of them reads the group's state, a small one looks its own up. A missing update is before all others."""
    monkeypatch.setattr(keyed, "BUCKETS", 2)
    r, base, arrived = random.Random(8), datetime(2026, 1, 1), None
    chosen = [range(150), range(140, 200), [3, 7], [7, 7, 199, 201], [8]]
    for number, ids in enumerate(chosen):
        rows = [(f"c{i}", "v", r.choice("ab"), base, None if (i % 10 == 9 or number == 4) else base + timedelta(days=r.randint(0, 1)), base + timedelta(days=number, seconds=n)) for n, i in enumerate(ids)]
        batch = spark.createDataFrame(rows, SCHEMA)
        batch.write.parquet(f"{tmp_path}/landed/{number}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/landed/*")
        query = keyed.fold_keyed(stream, str(tmp_path / "changes"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        timers = query.lastProgress.stateOperators[0].customMetrics["numRegisteredTimers"]
        assert timers <= 2  # one for each group, however many comments changed
        arrived = batch if arrived is None else arrived.unionByName(batch)
    want = versions.latest_versions(arrived, "comment_id", F.col("ingested_at"))
    got = keyed.standing(spark, str(tmp_path / "changes"), want.schema).drop("settled")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 201


def test_daily_facts_merge_into_any_period(spark):
    r = random.Random(9)
    base = datetime(2026, 1, 1)
    rows = [(f"v{r.randrange(3)}", r.choice([None, *(f"a{i}" for i in range(200))]), r.randint(0, 9), r.randint(0, 2), base + timedelta(hours=r.randrange(2000)), base + timedelta(days=r.randint(90, 99))) for _ in range(3000)]
    comments = spark.createDataFrame(rows, "video_id string, author_name string, like_count long, total_reply_count long, published_at timestamp, ingested_at timestamp")
    early = comments.where("published_at < '2026-02-01'")
    first = distinct.author_numbers(early)
    numbers = distinct.author_numbers(comments, first)
    codes = {x.author_name: x.number for x in numbers.collect()}
    assert len(codes) == 200 == len(set(codes.values())) and max(codes.values()) < 200 * 10
    assert {x.author_name: x.number for x in first.collect()}.items() <= codes.items()
    daily = distinct.daily_facts(early, first).unionByName(distinct.daily_facts(comments.exceptAll(early), numbers))
    weekly = distinct.merged(daily, "video_id", F.date_trunc("week", "comment_date").alias("week"))  # merges further
    want = metrics.video_kpis(comments)
    for facts in (daily, weekly):
        got = distinct.kpis(facts, "video_id")
        names = [c for c in want.columns if c in got.columns]
        assert len(names) == 8 and sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert distinct.kpis(daily.limit(0), "video_id").count() == 0
    with pytest.raises(Exception, match="An author has no number"):
        distinct.daily_facts(comments, first).collect()
