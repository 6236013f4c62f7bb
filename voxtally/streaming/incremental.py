"""The version fold over a stream of comments, and daily counts with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from voxtally.functions.scalars import utc_date
from voxtally.operators.comments import split_valid, with_errors
from voxtally.operators.versions import merge_batch
from voxtally.schemas import COMMENT


def fold_stream(stream: DataFrame, log: str, checkpoint: str, rejected: str | None = None) -> StreamingQuery:
    """Appends to `log` what each micro-batch brings that is new. Every batch has a directory of its own that is replaced as a
    whole, so a batch that runs again after a failure leaves the log as if it had run once; it is folded against the batches
    before it only. Late versions lose to those updated later, so no watermark is needed.

    Within a batch the log is parted by a hash of the comment. Of the log only the parts of comments that the batch has are read, and of
    these the rows of such comments folded."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        judged = with_errors(batch).persist()
        try:
            valid, bad = split_valid(judged)
            valid = valid.select(*COMMENT.names)
            parts = [r["part"] for r in valid.select(_part().alias("part")).distinct().collect()]  # at most PARTS
            try:
                existing = spark.read.schema(f"{_ddl()}, batch BIGINT, part INT").parquet(log).where((F.col("batch") < number) & F.col("part").isin(parts))
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                existing = spark.createDataFrame([], f"{_ddl()}, batch BIGINT, part INT")
            existing = existing.join(valid.select("comment_id").distinct(), "comment_id", "left_semi")
            _, delta = merge_batch(existing, valid, existing_ordinal=F.lpad(F.col("batch").cast("string"), 12, "0"))
            delta.withColumn("part", _part()).write.mode("overwrite").partitionBy("part").parquet(f"{log}/batch={number}")
            if rejected is not None:
                bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            judged.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts of a batch in the log.
PARTS = 64


def _part() -> Column:
    return F.pmod(F.xxhash64("comment_id"), F.lit(PARTS)).cast("int")


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COMMENT.fields)


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """video_id, day, comment_count, like_total over UTC days; a day is final when the watermark has passed it."""
    days = stream.withWatermark("published_at", late).groupBy("video_id", F.window("published_at", "1 day").alias("w"))
    return days.agg(F.count("*").alias("comment_count"), F.sum("like_count").alias("like_total")).select("video_id", utc_date(F.col("w.start")).alias("day"), "comment_count", "like_total")
