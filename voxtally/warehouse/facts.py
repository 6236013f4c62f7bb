"""Facts that are kept up to date: each batch of comments takes the versions it replaces out of the counts and puts its own in.

A store is a folder with logs, one directory for each batch:

* `arrived`: a batch's rows as they came, with a digest of their content and the places of the terms that they name. Texts are read, tagged and
  written here once; no shuffle, sort or later step carries them. Counts need no text: a store that is made with `texts=False`, as its batches
  stay where they came from, has a row for each that arrived, but only with its keys and times.
* `versions`: the versions that a batch brought to stand, without their texts, parted by a hash of the comment. A comment's row of its
  last batch is the one that stands, so a batch reads one row for each comment that it has, and tags only what it brings.
* `comments`: by video, UTC day and time of ingestion, how many comments the batch adds, less those that it takes away.
* `hits`: by video, UTC day and term, how many comments that name it the batch adds, less those that it takes away.
* `commits`: a row for each batch, written last. What isn't committed is never read.

These counts can be added and taken away, so facts of any coarser grain are their sums; a group's latest ingestion is the latest that still has
comments. A batch that runs again replaces what it wrote, against the batches before it. Old versions that arrive late, and copies that come
again, change nothing. A dictionary's store holds its own tags; another dictionary needs another store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DateType, IntegerType, LongType, StringType, StructField, StructType

from voxtally.functions.scalars import iso_text, utc_date
from voxtally.operators import matching, metrics
from voxtally.operators.versions import ORDINAL, content, latest_versions
from voxtally.sources.dictionaries import Dictionary
from voxtally.sources.landing import parquet_log

#: Parts of a batch's versions.
PARTS = 64
#: What facts and the fold need of a version besides its digest and terms.
_KEPT = ("comment_id", "video_id", "published_at", "updated_at", "ingested_at")
_MARKS = [StructField("digest", BinaryType()), StructField("named", ArrayType(IntegerType())), StructField("part", IntegerType())]
#: Microseconds count, and so do nulls.
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _part() -> Column:
    return F.pmod(F.xxhash64("comment_id"), F.lit(PARTS)).cast("int")


def _digest(columns: list[str]) -> Column:
    """128 bits for a version's content: every field but the time of ingestion."""
    return F.substring(F.unhex(F.sha2(F.to_json(content(columns), _FORMATS), 256)), 1, 16)


def _narrow(schema: StructType) -> list[StructField]:
    return [*(schema[n] for n in _KEPT), *_MARKS]


class FactStore:
    def __init__(self, spark: SparkSession, base: str, dictionary: Dictionary, texts: bool = True):
        self.spark, self.base, self.dictionary, self.texts = spark, base.rstrip("/"), dictionary, texts

    def _write(self, rows: DataFrame, log: str, number: int, *parted: str) -> str:
        path = f"{self.base}/{log}/batch={number}"
        rows.write.mode("overwrite").parquet(path, partitionBy=list(parted) or None, compression="zstd")
        return path

    def _committed(self, log: str, columns: list[StructField], before: int | None) -> DataFrame:
        """A log's rows of the batches that are committed, and of these of the ones before a number."""
        batch = StructField("batch", IntegerType())
        done = parquet_log(self.spark, StructType([StructField("n", LongType()), batch]), f"{self.base}/commits").select("batch")
        rows = parquet_log(self.spark, StructType([*columns, batch]), f"{self.base}/{log}").join(F.broadcast(done), "batch", "left_semi")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _last(self, schema: StructType, before: int | None, parts: list[int] | None) -> DataFrame:
        """The versions that stand, without their texts, and the batch that brought each."""
        rows = self._committed("versions", _narrow(schema), before)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        row = F.max_by(F.struct(*_KEPT, *(f.name for f in _MARKS), "batch"), "batch").alias("row")
        return rows.groupBy("comment_id").agg(row).select("row.*")

    def standing(self, schema: StructType, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The versions that stand, with the places of the terms they name and the part that they lie in; of a store without texts, their keys and
        times. `schema`: that of the batches."""
        if not self.texts:
            return self._last(schema, before, parts).select(*_KEPT, "named", "part")
        last = self._last(schema, before, parts).select("batch", "digest", F.col("ingested_at").alias("__at"))
        rows = self._committed("arrived", [*schema.fields, *_MARKS], before)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        rows = rows.join(last, ["batch", "digest"]).where(F.col("ingested_at").eqNullSafe(F.col("__at")))
        return rows.dropDuplicates(["digest"]).select(*schema.names, "named", "part")  # a batch may have copies of a row

    def _named(self) -> Column:
        """The places of the terms that a text names; terms that share an id have the place of the first of them."""
        places, first = matching.hit_places(F.col(matching.NORMAL), self.dictionary), {}
        again = {i: first[t.id] for i, t in enumerate(self.dictionary.terms) if first.setdefault(t.id, i) != i}
        if not again:
            return places
        moved = F.create_map(*(F.lit(x) for pair in again.items() for x in pair))
        return F.array_distinct(F.transform(places, lambda p: F.coalesce(moved[p], p)))

    def _placed(self, arrived: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
        """A batch's rows without their texts, in the order in which they arrive: by ingestion, and where that and the update agree by content.
        Only for such rows is the content itself looked at again. `whole`: the rows with all of their columns and their digest."""
        at = F.struct("comment_id", "updated_at", "ingested_at").alias("__at")
        rows = arrived.select(*_KEPT, *(f.name for f in _MARKS), at)
        several = rows.groupBy("__at").agg(F.count("*").alias("n")).where("n > 1").select("__at")
        place = F.lit(0)
        if not several.isEmpty():
            order = Window.partitionBy("__at").orderBy(content(columns))
            places = whole.withColumn("__at", at).join(several, "__at", "left_semi").withColumn("__place", F.dense_rank().over(order)).select("__at", "digest", "__place").distinct()
            rows, place = rows.join(places, ["__at", "digest"], "left"), F.coalesce("__place", F.lit(0))
        ordinal = F.concat(F.lit("1"), iso_text(F.col("ingested_at")), F.lpad(place.cast("string"), 12, "0"))
        return rows.select(*_KEPT, *(f.name for f in _MARKS), ordinal.alias(ORDINAL))

    def apply(self, number: int, batch: DataFrame) -> None:
        """Brings the facts up to date with a batch of valid comments; a comment may come more than once in it. Batches are numbered in the order
        of arrival, and a number that is applied again replaces what it brought."""
        marks = [_digest(batch.columns).alias("digest"), self._named().alias("named"), _part().alias("part")]
        fields = batch.schema.fields if self.texts else [batch.schema[n] for n in _KEPT]
        path = self._write(matching.with_normal_text(batch).select(*(f.name for f in fields), *marks), "arrived", number)
        arrived = self.spark.read.schema(StructType([*fields, *_MARKS])).parquet(path)
        rows = self._placed(arrived, arrived if self.texts else batch.select("*", marks[0]), batch.columns)
        parts = [r["part"] for r in arrived.select("part").distinct().collect()]  # at most PARTS
        standing = self._last(batch.schema, number, parts).drop("batch").join(arrived.select("comment_id").distinct(), "comment_id", "left_semi").persist()
        try:
            both = standing.withColumn(ORDINAL, F.concat(F.lit("0"), iso_text(F.col("ingested_at")))).unionByName(rows)
            new = latest_versions(both, "comment_id", F.col(ORDINAL)).where(F.col(ORDINAL).startswith("1")).drop(ORDINAL)
            path = self._write(new.hint("rebalance", "part"), "versions", number, "part")
            new = self.spark.read.schema(StructType(_narrow(batch.schema))).parquet(path)
            old = standing.join(new.select("comment_id"), "comment_id", "left_semi")
            signed = new.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1))).withColumn("comment_date", utc_date(F.col("published_at")))
            total = F.sum("n").alias("n")
            self._write(signed.groupBy("video_id", "comment_date", "ingested_at").agg(total).where("n <> 0"), "comments", number)
            named = signed.withColumn("ord", F.explode("named")).groupBy("video_id", "comment_date", "ord").agg(total).where("n <> 0")
            ids = self.dictionary.to_join(self.spark).select("ord", "id")
            self._write(named.join(ids, "ord").select("video_id", "comment_date", "id", "n"), "hits", number)
            self._write(self.spark.range(1).select(F.col("id").alias("n")), "commits", number)
        finally:
            standing.unpersist()

    def shares(self, instant: StructField, daily: bool = False, before: int | None = None) -> DataFrame:
        """The rows that `metrics.shares` has over all comments that stand, from the counts alone. `instant`: the batches' field ingested_at."""
        grain = ["video_id", "comment_date"] if daily else ["video_id"]
        key = [StructField("video_id", StringType()), StructField("comment_date", DateType())]
        counted = self._committed("comments", [*key, instant, StructField("n", LongType())], before)
        counted = counted.groupBy("video_id", "comment_date", "ingested_at").agg(F.sum("n").alias("n")).where("n > 0")
        groups = counted.groupBy(*grain).agg(F.sum("n").alias("comment_count"), F.max("ingested_at").alias("snapshot_at"))
        named = self._committed("hits", [*key, StructField("id", StringType()), StructField("n", LongType())], before)
        named = named.groupBy(*grain, "id").agg(F.sum("n").alias("named")).where("named > 0")
        return metrics.dense_shares(groups, named, self.dictionary, grain)
