import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxtally import schemas
from voxtally.operators import comments, matching, metrics, quality, versions
from voxtally.sources.dictionaries import entity_dictionary, topic_dictionary

ENTITIES = {
    "schema_version": 1, "dictionary_version": "v1", "description": "d",
    "groups": [{"group_id": "band", "canonical_name": "BAND", "aliases": ["밴드"]}],
    "members": [{"member_id": "h", "group_id": "band", "canonical_name": "RIN", "aliases": ["林", "小林", "大小林"]}, {"member_id": "l", "group_id": "band", "canonical_name": "LILY", "aliases": []}],
}
TOPICS = {"schema_version": 1, "dictionary_version": "t1", "description": "d", "topics": [{"topic_id": "vocal", "display_name": "Vocal", "keywords": ["vocal", "唱功"]}, {"topic_id": "dance", "display_name": "Dance", "keywords": ["dance"]}]}


def utc(text):
    return F.lit(text).cast("timestamp")


def plain_matches(text, term):
    """Longest first, then earliest; occurrences of one spelling are found from the left."""
    spans = []
    for place, p in enumerate(term.patterns):
        pattern = rf"(?<![A-Za-z0-9_]){re.escape(p)}(?![A-Za-z0-9_])" if p.isascii() else re.escape(p)
        spans += [(-(m.end() - m.start()), m.start(), m.end(), place) for m in re.finditer(pattern, text)]
    kept = []
    for s in sorted(spans):
        if all(s[1] >= k[2] or k[1] >= s[2] for k in kept):
            kept.append(s)
    return [term.spellings[i] for i in sorted({k[3] for k in kept})]


@pytest.mark.parametrize("most", [matching.INLINE_SPELLINGS, 0])
@pytest.mark.parametrize("names", [["ABA", "BAB"], ["é", "éa", "aé", "a"], ["ab", "b ab", "cc"], ["漢字", "字", "漢"]])
def test_spans_against_a_plain_version(spark, names, most, monkeypatch):
    monkeypatch.setattr(matching, "INLINE_SPELLINGS", most)
    r = random.Random(7)
    d = entity_dictionary(ENTITIES | {"groups": [{"group_id": "g", "canonical_name": names[0], "aliases": names[1:]}], "members": []})
    alphabet = sorted({c for n in names for c in n.lower()}) + [" "]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(400)] + ["ababab" * 30]
    rows = spark.createDataFrame([(str(i), "v", t) for i, t in enumerate(texts)], "comment_id string, video_id string, normal_text string")
    rows = rows.withColumns({"published_at": utc("2026-01-01"), "ingested_at": utc("2026-01-02")})
    got = {x.comment_id: x.matched_aliases for x in matching.entity_mentions(rows, d).collect()}
    want = {str(i): m for i, t in enumerate(texts) if (m := plain_matches(t, d.terms[0]))}
    assert got == want


def test_dictionary_of_thousands_of_terms(spark):
    topics = [{"topic_id": f"t{i}", "display_name": f"T{i}", "keywords": [f"word{i}", f"the word{i}", f"語{i}。"]} for i in range(2000)]
    d = topic_dictionary(TOPICS | {"topics": topics})
    texts = ["the word7, word70 and word1999", "語12。word1x", "", None, "word3 " * 2000 + "the word3"]
    rows = spark.createDataFrame([(str(i), "v", t) for i, t in enumerate(texts)], "comment_id string, video_id string, normal_text string")
    rows = rows.withColumns({"published_at": utc("2026-01-01"), "ingested_at": utc("2026-01-02")})
    found = matching.topic_records(rows, d)
    got = {(x.comment_id, x.topic_id): x.matched_keywords for x in found.collect()}
    want = {(str(i), t.id): m for i, text in enumerate(texts) for t in d.terms if (m := plain_matches(text or "", t))}
    assert got == want and len(got) == 5
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()  # read once, when the plan is made
    shares = metrics.topic_metrics(rows, found, d).where("topic_comment_count > 0")
    assert {r.topic_id for r in shares.collect()} == {t for _, t in got}


def test_mentions_and_shares(spark):
    d, t = entity_dictionary(ENTITIES), topic_dictionary(TOPICS)
    texts = ["ＢＡＮＤ 大小林 vocals", "小林和林 唱功", "bands rin123 Lily Vocal dance", "nothing"]
    rows = spark.createDataFrame([(str(i), "v", x) for i, x in enumerate(texts)] + [("9", "w", "quiet")], "comment_id string, video_id string, comment_text string")
    at = F.when(F.col("comment_id") == "3", utc("2026-01-02 07:30:00+08:00")).otherwise(utc("2026-01-02 10:00:00"))
    rows = matching.with_normal_text(rows.withColumns({"published_at": at, "ingested_at": utc("2026-01-03")})).persist()
    hits = matching.entity_mentions(rows, d)
    assert {(x.comment_id, x.entity_id, *x.matched_aliases) for x in hits.collect()} == {("0", "band", "BAND"), ("0", "h", "大小林"), ("1", "h", "林", "小林"), ("2", "l", "LILY")}
    twice = hits.unionByName(hits)
    sov = {(x.video_id, x.entity_id): x for x in metrics.entity_sov(rows, twice, d).collect()}
    assert len(sov) == 6 and sov["v", "h"].mention_comment_count == 2 and sov["v", "h"].comment_share_of_voice == 0.5
    assert sov["v", "h"].entity_share_of_voice == 2 / 3 and sov["v", "band"].entity_share_of_voice == 1.0 and sov["w", "l"].entity_share_of_voice == 0.0
    with pytest.raises(Exception, match="one latest row per video_id/comment_id"):
        metrics.entity_sov(rows.unionByName(rows), hits, d).collect()
    with pytest.raises(Exception, match="one latest row per video_id/comment_id"):
        metrics.topic_metrics(rows.unionByName(rows), matching.topic_records(rows, t), t, daily=True).collect()
    daily = metrics.entity_sov(rows, hits, d, daily=True)
    assert {(str(x.comment_date), x.comment_count) for x in daily.where("video_id = 'v'").collect()} == {("2026-01-01", 1), ("2026-01-02", 3)}
    topics = matching.topic_records(rows, t)
    assert {(x.comment_id, x.topic_id) for x in topics.collect()} == {("1", "vocal"), ("2", "vocal"), ("2", "dance")}
    for table, df in (("video_entity_sov", metrics.entity_sov(rows, hits, d)), ("daily_entity_sov", daily), ("video_topic_metrics", metrics.topic_metrics(rows, topics, t)), ("daily_topic_metrics", metrics.topic_metrics(rows, topics, t, daily=True))):
        quality.require_gold(df, table, None, "v1" if "entity" in table else "t1")
        quality.require_gold(df.limit(0), table)
    with pytest.raises(ValueError, match="video_id does not match"):
        quality.require_gold(daily, "daily_entity_sov", "other")
    assert metrics.hit_problems(hits, rows, d, "entity_id", "mention_count").count() == 0
    bad = hits.withColumn("group_id", F.lit("x")).withColumn("mention_count", F.lit(2))
    assert {x.problem for x in metrics.hit_problems(bad, rows, d, "entity_id", "mention_count").collect()} == {"group_id", "mention_count"}
    with pytest.raises(ValueError, match="missing snapshot_at"):
        quality.require_gold(daily.drop("snapshot_at"), "daily_entity_sov")
    assert metrics.in_order(sov_frame := metrics.entity_sov(rows, hits, d), d, "entity_id").columns == sov_frame.columns


def plain_fold(rows):
    state = None
    for content, updated, ingested in rows:
        new = (content, updated, ingested)
        if state is None or updated > state[1] or (updated == state[1] and ingested > state[2] and content != state[0]):
            state = new
    return state


def test_fold_against_a_plain_version(spark):
    r = random.Random(3)
    base = datetime(2026, 1, 1)
    rows, want = [], {}
    for key in range(120):
        log = [(r.choice("ab"), base + timedelta(days=r.randint(0, 2)), base + timedelta(days=r.randint(3, 6))) for _ in range(r.randint(1, 7))]
        rows += [(str(key), i, c, u, g) for i, (c, u, g) in enumerate(log)]
        want[str(key)] = plain_fold(log)
    df = spark.createDataFrame(rows, "comment_id string, n int, text string, updated_at timestamp, ingested_at timestamp")
    arrival = df.select("comment_id", "text", "updated_at", "ingested_at", F.col("n").alias("arrival"))
    folded = versions.latest_versions(arrival.drop("arrival").withColumn(versions.ORDINAL, F.lit(0)).limit(0)).count()
    assert folded == 0
    keyed = df.withColumn(versions.ORDINAL, F.col("n")).drop("n")
    got = {x.comment_id: (x.text, x.updated_at, x.ingested_at) for x in versions.latest_versions(keyed, "comment_id", F.col(versions.ORDINAL)).collect()}
    assert got == want


def test_fold_of_a_long_log_holds_changes_only(spark):
    """A comment that is ingested again and again without an edit leaves one version for each change to the fold."""
    day = lambda n: datetime(2026, 1, 1) + timedelta(days=n)
    log = [("k", "ab"[n // 500 % 2], day(0), day(n)) for n in range(3000)]
    df = spark.createDataFrame(log, "comment_id string, text string, updated_at timestamp, ingested_at timestamp")
    got = versions.latest_versions(df)
    assert [(x.text, x.ingested_at) for x in got.collect()] == [("b", day(2500))]


def test_fold_of_a_million_alternating_versions(spark):
    """One key that goes to and fro a million times, in order and out of order, beside small ones; no row holds a key's versions together."""
    n = F.col("id")
    when = F.timestamp_seconds(n.cast("double") * 60)
    rows = spark.range(1_000_000).select(F.lit("hot").alias("comment_id"), F.when(n % 2 == 0, "a").otherwise("b").alias("text"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"), when.alias("ingested_at"), n.alias("arrival"))
    few = rows.limit(6).withColumn("comment_id", F.concat(F.lit("k"), (F.col("arrival") % 3).cast("string")))
    for late in (0, 100_000):  # so many of the first versions arrive after all others, and lose
        arrival = F.when(F.col("arrival") < late, F.col("arrival") + 2_000_000).otherwise(F.col("arrival"))
        versions_of = rows.unionByName(few).withColumn(versions.ORDINAL, arrival).drop("arrival")
        folded = versions.latest_versions(versions_of, "comment_id", F.col(versions.ORDINAL))
        got = {x.comment_id: (x.text, x.ingested_at.timestamp()) for x in folded.collect()}
        assert got["hot"] == ("b", 999_999 * 60) and set(got) == {"hot", "k0", "k1", "k2"}
        assert "collect_list" not in folded._jdf.queryExecution().optimizedPlan().toString()


def test_merge_of_several_versions_of_a_key(spark):
    """A batch may hold a key more than once: its versions arrive in the order of ingestion."""
    r = random.Random(6)
    base = datetime(2026, 1, 1)
    rows, want = [], {}
    for key in range(80):
        log = sorted({base + timedelta(hours=h) for h in r.sample(range(200), r.randint(1, 9))})
        log = [(r.choice("ab"), base - timedelta(days=r.randint(0, 1)), g) for g in log]
        rows += [(str(key), *x) for x in log]
        want[str(key)] = plain_fold(log)
    df = spark.createDataFrame(rows, "comment_id string, text string, updated_at timestamp, ingested_at timestamp")
    late = F.col("ingested_at") >= F.lit(base + timedelta(hours=100))
    merged, delta = versions.merge_batch(df.where(~late), df.where(late))
    assert {x.comment_id: (x.text, x.updated_at, x.ingested_at) for x in merged.collect()} == want
    assert {x.comment_id for x in delta.collect()} == {k for k, v in want.items() if v[2] >= base + timedelta(hours=100)}


def test_merge_tells_what_is_new(spark):
    schema = "comment_id string, text string, updated_at timestamp, ingested_at timestamp"
    at = lambda d: datetime(2026, 1, d)
    old = spark.createDataFrame([("same", "a", at(1), at(2)), ("later", "a", at(1), at(2)), ("changed", "a", at(1), at(2)), ("older", "a", at(3), at(4))], schema)
    new = spark.createDataFrame([("same", "a", at(1), at(5)), ("later", "a", at(2), at(5)), ("changed", "b", at(1), at(5)), ("older", "b", at(1), at(5)), ("first", "x", at(1), at(5))], schema)
    merged, delta = versions.merge_batch(old, new)
    assert {x.comment_id for x in delta.collect()} == {"later", "changed", "first"}
    assert {(x.comment_id, x.text, x.ingested_at.day) for x in merged.collect()} == {("same", "a", 2), ("later", "a", 5), ("changed", "b", 5), ("older", "a", 4), ("first", "x", 5)}
    assert versions.merge_batch(old.limit(0), new)[1].count() == 5


def test_rules(spark):
    base = {"comment_id": "'x'", "video_id": "'v'", "author_name": "null", "comment_text": "'t'", "like_count": "parse_json('1')", "total_reply_count": "parse_json('0')", "published_at": "timestamp'2026-01-01'", "updated_at": "timestamp'2026-01-01'", "ingested_at": "timestamp'2026-01-02'"}
    cases = [
        ({}, []), ({"comment_id": "null"}, ["comment_id is required"]), ({"like_count": "parse_json('-1')"}, ["like_count must be non-negative"]),
        ({"like_count": "parse_json('1.5')"}, ["like_count must be an integer"]), ({"like_count": "parse_json('true')"}, ["like_count must be an integer"]),
        ({"total_reply_count": "parse_json('\"5\"')"}, ["total_reply_count must be an integer"]), ({"like_count": "parse_json('null')"}, ["like_count is required"]),
        ({"updated_at": "timestamp'2025-01-01'"}, ["published_at must not be after updated_at"]),
        ({"updated_at": "timestamp'2026-02-01'", "like_count": "parse_json('-1')"}, ["like_count must be non-negative", "updated_at must not be after ingested_at"]),
    ]
    for change, want in cases:
        row = spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in (base | change).items()))
        assert row.select(comments.validation_errors(row).alias("e")).first().e == want, change
    naive = spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in (base | {"published_at": "timestamp_ntz'2026-01-01'", "updated_at": "'2026-01-01'"}).items()))
    assert naive.select(comments.validation_errors(naive).alias("e")).first().e == ["published_at must include timezone information", "updated_at must be a datetime"]
    row = spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in base.items()))
    valid, rejected = comments.split_valid(row.unionByName(row).unionByName(row.withColumn("comment_id", F.lit("y"))))
    assert [x.comment_id for x in valid.collect()] == ["y"] and valid.schema["like_count"].dataType.simpleString() == "bigint"
    assert [x.validation_errors for x in rejected.collect()] == [["comment_id must be unique within the batch"]] * 2


def test_kpis(spark):
    rows = spark.createDataFrame(
        [("v", "a", 3, 0, datetime(2026, 1, 1)), ("v", None, 1, 2, datetime(2026, 1, 2)), ("v", "a", 2, 1, datetime(2026, 1, 2))],
        "video_id string, author_name string, like_count bigint, total_reply_count bigint, published_at timestamp",
    ).withColumn("ingested_at", utc("2026-02-01"))
    video = metrics.video_kpis(rows)
    x = video.first()
    assert (x.comment_count, x.comment_like_count_total, x.comment_like_count_avg, x.comments_with_replies_count, x.comments_with_replies_ratio, x.distinct_author_name_count) == (3, 6, 2.0, 2, 2 / 3, 1)
    assert set(video.columns) == set(schemas.VIDEO_KPIS.names) and set(metrics.daily_kpis(rows).columns) == set(schemas.DAILY_KPIS.names)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda d: d | {"schema_version": 2}, "Unsupported alias dictionary schema_version: 2"),
        (lambda d: d | {"groups": []}, "groups must be a non-empty list"),
        (lambda d: d | {"groups": d["groups"] * 2}, "Duplicate group_id: band"),
        (lambda d: d | {"members": [{"member_id": "m", "group_id": "no", "canonical_name": "M", "aliases": []}]}, "references unknown group_id: no"),
        (lambda d: d | {"members": [{"member_id": "m", "group_id": "band", "canonical_name": "ｂａｎｄ", "aliases": []}]}, "conflicts with group"),
        (lambda d: d | {"members": [{"member_id": "m", "group_id": "band", "canonical_name": "M", "aliases": [" m "]}]}, "contains duplicate alias: m"),
        (lambda d: d | {"description": " "}, "description must be a non-empty string"),
    ],
)
def test_entity_dictionary_rules(change, message):
    with pytest.raises(ValueError, match=re.escape(message)):
        entity_dictionary(change(ENTITIES))


def test_topic_dictionary_rules():
    for change, message in (({"topics": []}, "topics must be a non-empty list"), ({"topics": TOPICS["topics"] * 2}, "Duplicate topic_id"), ({"topics": [{"topic_id": "a", "display_name": "A", "keywords": []}]}, "non-empty list"), ({"topics": [*TOPICS["topics"], {"topic_id": "a", "display_name": "A", "keywords": ["ＤＡＮＣＥ"]}]}, "conflicts with topic[dance]")):
        with pytest.raises(ValueError, match=re.escape(message)):
            topic_dictionary(TOPICS | change)
