"""The committing sink: what fails is never seen, what runs again replaces itself."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType, TimestampType

from voxtally.sinks import committed

SCHEMA = StructType().add("id", LongType()).add("said", StringType()).add("at", TimestampType()).add("tags", ArrayType(StringType()))


def rows(spark, low, high):
    return spark.range(low, high).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("said"), F.timestamp_micros(F.col("id") + 1).alias("at"), F.array(F.lit("a"), F.lit(None)).alias("tags"))


def seen(spark, path):
    return sorted((x.id, x.said, x.at.microsecond, x.tags) for x in committed.read_runs(spark, path, SCHEMA).collect())


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "log")
    assert seen(spark, path) == [] and committed.commits(path) == []
    assert committed.append_run(rows(spark, 0, 50), path, "1") == 50
    first = seen(spark, path)
    assert first == [(i, f"t{i}", i + 1, ["a", None]) for i in range(50)]
    broken = rows(spark, 50, 90).withColumn("said", F.when(F.col("id") == 88, F.raise_error(F.lit("no"))).otherwise(F.col("said")))
    with pytest.raises(Exception, match="no"):
        committed.append_run(broken, path, "2")
    assert seen(spark, path) == first and [m["run"] for m in committed.commits(path)] == ["1"]
    assert committed.append_run(rows(spark, 50, 90), path, "2") == 40 and len(seen(spark, path)) == 90
    files = {f for m in committed.commits(path) for f, _ in m["files"]}
    for _ in range(2):  # again, with the same rows and with others
        assert committed.append_run(rows(spark, 50, 90), path, "2") == 40 and len(seen(spark, path)) == 90
    assert not {f for m in committed.commits(path) for f, _ in m["files"] if f.startswith("2/")} & files
    assert committed.append_run(rows(spark, 0, 0), path, "1") == 0 and [x[0] for x in seen(spark, path)] == list(range(50, 90))
    (tmp_path / "log" / "3").mkdir()
    (tmp_path / "log" / "3" / "part-lost.parquet").write_text("of an executor that was lost")
    assert len(seen(spark, path)) == 40 and committed.remove_unlisted(path) >= 1 == len({m["run"] for m in committed.commits(path)} - {"1"}) and len(seen(spark, path)) == 40
    order = {x.id // 50: x.source_file.split("/")[-2] for x in committed.read_runs(spark, "file://" + path, SCHEMA).collect()}
    assert order == {1: "2"}
    with pytest.raises(Exception, match="run must name the write"):
        committed.append_run(rows(spark, 0, 1), path, "a/b")
