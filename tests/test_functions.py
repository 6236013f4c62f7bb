import random
import re

import pytest
from pyspark.sql import functions as F

from voxtally.functions import scalars
from voxtally.functions.text import any_pattern, may_overlap, normal_form, normalized, term_pattern


def test_normal_form_column_is_the_function(spark):
    r = random.Random(1)
    texts = ["ＶＯＸＥＳ  ﬁ ß　x", "İ ς Σ", "", None, "\x1c a\x1f", "K"] + ["".join(r.choices("aB \t\n\x1c\x0bé ＡßΣ1", k=r.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalized(F.col("t")).alias("n")).collect()
    assert {x.i: x.n for x in rows} == {i: None if t is None else normal_form(t) for i, t in enumerate(texts)}


def test_term_patterns(spark):
    terms = ["pip", "보리", "a.b", "c\\E+", "voxes x"]
    texts = ["pip", "PIP123", "pips", "_pip", "pip!", "x pip", "보리이", "a.b", "axb", "c\\E+", "voxes x", "évoxes x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in terms:
        plain = re.compile(rf"(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])" if term.isascii() else re.escape(term))
        got = {x.t: x.m for x in df.select("t", F.col("t").rlike(term_pattern(term)).alias("m")).collect()}
        assert got == {t: bool(plain.search(t)) for t in texts}
    assert df.where(F.col("t").rlike(any_pattern(terms))).count() == 8
    assert may_overlap(["aba", "bab"]) and may_overlap(["ab", "xabx"]) and not may_overlap(["ab", "cd"])


URLS = ["dQw4w9WgXcQ", " dQw4w9WgXcQ ", "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "http://YouTube.com/watch/?v=dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?si=1", "https://m.youtube.com/shorts/dQw4w9WgXcQ/", "https://music.youtube.com/embed/dQw4w9WgXcQ", "https://youtube.com/live/dQw4w9WgXcQ#t", "https://www.youtube.com/watch?v=dQw4w9WgX%63Q"]
NONE = ["", "short", "dQw4w9WgXcQQ", "ftp://youtu.be/dQw4w9WgXcQ", "https://evil.example/watch?v=dQw4w9WgXcQ", "https://www.youtube.com/watch?x=dQw4w9WgXcQ", "https://www.youtube.com/channel/dQw4w9WgXcQ", "https://youtu.be/"]


def test_video_ids(spark):
    rows = spark.createDataFrame([(t,) for t in URLS + NONE], "t string").select("t", scalars.video_id_of(F.col("t")).alias("v")).collect()
    assert {x.t: x.v for x in rows} == {t: "dQw4w9WgXcQ" for t in URLS} | {t: None for t in NONE}
    assert {scalars.video_id(t) for t in URLS} == {"dQw4w9WgXcQ"}
    for t in NONE:
        with pytest.raises(ValueError):
            scalars.video_id(t)


def test_instants_shares_and_counts(spark):
    texts = {"2026-08-19T08:00:00Z": True, "2026-08-19T16:00:00+08:00": True, "2026-08-19T08:00:00.123456+0000": True, "2026-08-19T08:00:00": False, "2026-08-19": False, "2026-13-19T08:00:00Z": False, "x": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.parse_instant(F.col("t")).alias("p")).collect()
    assert {x.t: x.p is not None for x in rows} == texts
    one = spark.range(1).select(
        scalars.ratio(F.lit(1), F.lit(0)).alias("zero"), scalars.ratio(F.lit(1), F.lit(4)).alias("quarter"), scalars.is_close(F.lit(1 / 3), F.lit(1 / 3 + 1e-13)).alias("close"),
        scalars.short_hash(F.lit("a")).alias("hash"), scalars.is_filled(F.lit(" \x1c")).alias("blank"), scalars.is_filled(F.lit(" x")).alias("filled"),
        scalars.is_integer(F.parse_json(F.lit("5"))).alias("i"), scalars.is_integer(F.parse_json(F.lit("5.0"))).alias("d"), scalars.is_integer(F.parse_json(F.lit('"5"'))).alias("s"), scalars.is_integer(F.parse_json(F.lit("true"))).alias("b"),
        scalars.iso_text(F.lit("2026-01-02 03:04:05.000006+00:00").cast("timestamp")).alias("iso"),
    ).first()
    assert one.asDict() == {"zero": 0.0, "quarter": 0.25, "close": True, "hash": "ca978112ca1bbdca", "blank": False, "filled": True, "i": True, "d": False, "s": False, "b": False, "iso": "2026-01-02T03:04:05.000006+00:00"}
    assert scalars.identifier("a_1") == "`a_1`"
    for bad in ("1a", "a-b", "a`b", ""):
        with pytest.raises(ValueError):
            scalars.identifier(bad)


def test_utc_whatever_the_session_shows(spark):
    """Instants, and timestamps without zone, which are in UTC, give the same days and texts in every session zone."""
    df = spark.createDataFrame([(i,) for i in (1704141000000000, 1710055800000001, -1)], "micros bigint")
    seen = set()
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Seoul", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = F.timestamp_micros("micros")
            for column in (at, scalars.in_utc(at)):
                rows = df.select(scalars.utc_date(column).cast("string").alias("day"), scalars.iso_text(column).alias("iso"), scalars.compact_instant(column).alias("compact")).collect()
                seen.add(tuple(tuple(r) for r in rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    # 2024-03-10 07:30 UTC is next to a gap in New York
    assert seen == {(("2024-01-01", "2024-01-01T20:30:00.000000+00:00", "20240101T203000000000Z"), ("2024-03-10", "2024-03-10T07:30:00.000001+00:00", "20240310T073000000001Z"), ("1969-12-31", "1969-12-31T23:59:59.999999+00:00", "19691231T235959999999Z"))}


def test_instants_with_a_space(spark):
    texts = ["2024-01-01 20:30:00+00:00", "2024-01-01T20:30:00Z", "2024-01-02 05:30:00+09:00", "2024-01-01 20:30:00", "20:30:00Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(scalars.parse_instant(F.col("t"))).alias("s")).collect()
    assert [r.s for r in rows] == [1704141000] * 3 + [None] * 2


def test_counts_as_json_and_quoting(spark):
    import json

    counts = {"b": 1, "a": 2, 'q"\\': 3}
    df = spark.createDataFrame([(counts,), ({},), (None,)], "m map<string,bigint>").select(scalars.encode_counts(F.col("m")).alias("j"))
    assert [r.j for r in df.collect()] == [json.dumps(counts, sort_keys=True), "{}", None]
    assert df.select(scalars.decode_counts(F.col("j")).alias("m")).first().m == counts
    for text in ("it's", "a\\b", "'", "\\'", "\n"):
        assert spark.sql(f"SELECT {scalars.literal(text)} AS t").first().t == text
    for bad in (None, " ", 5):
        with pytest.raises(ValueError):
            scalars.filled(bad, "x")
