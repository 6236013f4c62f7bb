"""The version fold on keyed state: each comment's standing version lies in the state store, and a batch costs only its own comments."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from voxtally.sources.landing import parquet_log

#: The state store; no batches without rows, which timers on the clock would ask for without end; and a batch leaves its changes, not the whole store.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Microseconds are kept in the text of contents.
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
_STATE = "updated bigint, ingested bigint, content string, n bigint"
_CHANGE = f"comment_id string, {_STATE}, settled boolean"
#: Comments are dealt into as many groups by hash, so that a call of Python serves many comments; the state has an entry for each comment
#: within its group. Fixed for the life of a checkpoint.
BUCKETS = 4096
#: A group's entries are read one after the other, which costs about an eighth of looking one up, where at most as many stand for one that a batch has.
SCAN = 8
#: Stands for a missing time, which is before all others.
_NEVER = -(2**63)


class StandingVersions(StatefulProcessor):
    """Holds the standing version of each comment of a group, emits each one that comes to stand with its number, and once more when it has stood for a while."""

    def __init__(self, settle: timedelta):
        self.settle = int(settle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getMapState("standing", "comment_id string", _STATE)
        self.size = handle.getValueState("size", "comments bigint")
        self.due = handle.getMapState("due", "at bigint", "comment_ids array<string>, numbers array<bigint>")  # what came to stand, by the time of its timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        newest: dict[str, int] = {}
        arrived: dict[str, list[tuple]] = {}
        for frame in rows:  # of the batch only versions of a comment's latest update can matter
            for name, updated, ingested, content in zip(*(frame[c].tolist() for c in ("comment_id", "updated", "ingested", "content")), strict=True):
                latest = newest.get(name)
                if latest is None or updated > latest:
                    newest[name], arrived[name] = updated, [(ingested, content)]
                elif updated == latest:
                    arrived[name].append((ingested, content))
        size = self.size.get()[0] if self.size.exists() else 0
        before = self._before(newest, size)
        changed: list[tuple] = []
        for name, versions in arrived.items():
            updated, then = newest[name], before.get(name)
            now = then
            if now is None or updated >= now[0]:
                for ingested, content in sorted(versions):
                    if now is None or updated > now[0] or (ingested > now[1] and content != now[2]):
                        now = (updated, ingested, content, now[3] + 1 if now else 1)
            if now is not then:
                self.standing.updateValue((name,), now)
                changed.append((name, *now))
        if changed:
            added = sum(name not in before for name, *_ in changed)
            if added:
                self.size.update((size + added,))
            self._register(timerValues.getCurrentProcessingTimeInMs() + self.settle, changed)
            yield _frame(changed, settled=False)

    def _before(self, names: dict[str, int], size: int) -> dict[str, tuple]:
        """The versions that stand of the named comments."""
        if size <= SCAN * len(names):
            return {name: value for (name,), value in self.standing.iterator() if name in names} if size else {}
        found = ((name, self.standing.getValue((name,))) for name in names)
        return {name: tuple(value) for name, value in found if value is not None}

    def _register(self, at: int, changed: list[tuple]) -> None:
        names, numbers = [c[0] for c in changed], [c[-1] for c in changed]
        if self.due.containsKey((at,)):
            more = self.due.getValue((at,))
            names, numbers = [*more[0], *names], [*more[1], *numbers]
        self.due.updateValue((at,), (names, numbers))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        numbers = dict(zip(*self.due.getValue(at), strict=True))
        self.due.removeKey(at)
        before = self._before(numbers, self.size.get()[0])
        settled = [(name, *before[name]) for name, n in numbers.items() if before[name][3] == n]  # a later version has a timer of its own
        if settled:
            yield _frame(settled, settled=True)

    def close(self) -> None:
        pass


def _frame(versions: list[tuple], settled: bool) -> pd.DataFrame:
    return pd.DataFrame(versions, columns=["comment_id", "updated", "ingested", "content", "n"]).assign(settled=settled)


def _micros(name: str, schema: StructType) -> Column:
    zoned = schema[name].dataType.simpleString() == "timestamp"
    return F.unix_micros(F.col(name) if zoned else F.to_timestamp(F.concat(F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))))


def fold_keyed(stream: DataFrame, changes: str, checkpoint: str, settle: timedelta = timedelta(days=1)) -> StreamingQuery:
    """Writes each change of a comment's standing version to `changes`, a directory for each micro-batch, which a repeated one replaces.

    stream: comment_id, updated_at, ingested_at and any other columns. A batch's versions arrive in the order of ingestion, batches one after the
    other. Of versions of one batch that agree in both times the first by the
    text of its content stands. Nothing is too late: late and repeated versions win or lose as in a batch fold, so there is no watermark. The state holds one version for
    each comment in RocksDB, under its group, and timers: a version that has stood for `settle` is written once more as settled when a batch comes."""
    spark, schema = stream.sparkSession, stream.schema
    content = F.to_json(F.struct(*(c for c in stream.columns if c != "ingested_at")), _FORMATS)
    updated, ingested = (F.coalesce(_micros(name, schema), F.lit(_NEVER)).alias(name.removesuffix("_at")) for name in ("updated_at", "ingested_at"))
    bucket = F.pmod(F.xxhash64("comment_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    marked = stream.select(bucket, "comment_id", updated, ingested, content.alias("content"))
    folded = marked.groupBy("bucket").transformWithStateInPandas(StandingVersions(settle), _CHANGE, "Update", "ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    try:
        for name, value in _SETTINGS.items():  # a query takes the session's settings when it starts
            spark.conf.set(name, value)
        return folded.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def standing(spark: SparkSession, changes: str, schema: StructType) -> DataFrame:
    """The versions that stand after all changes, with the columns of the stream, and `settled`."""
    rows = parquet_log(spark, StructType.fromDDL(f"{_CHANGE}, batch int"), changes)
    last = rows.groupBy("comment_id").agg(F.max_by(F.struct("content", "ingested"), "n").alias("last"), F.max(F.struct("n", "settled"))["settled"].alias("settled"))
    fields = StructType([f for f in schema.fields if f.name != "ingested_at"])
    read = F.from_json("last.content", fields, {k: v for k, v in _FORMATS.items() if k != "ignoreNullFields"})
    instant = F.timestamp_micros(F.nullif("last.ingested", F.lit(_NEVER)))
    zoned = schema["ingested_at"].dataType.simpleString() == "timestamp"
    ingested = instant if zoned else F.to_timestamp_ntz(F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return last.select(read.alias("c"), ingested.alias("ingested_at"), "settled").select(*(F.col("ingested_at") if n == "ingested_at" else F.col(f"c.{n}").alias(n) for n in schema.names), "settled")
