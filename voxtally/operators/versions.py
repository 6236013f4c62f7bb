"""Versions of a comment: the order-dependent fold to the latest one, and what a batch adds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.scalars import iso_text

ORDINAL = "__ordinal"


def content(columns: list[str]) -> Column:
    """Every field but the time of ingestion."""
    return F.struct(*(c for c in columns if c not in ("ingested_at", ORDINAL)))


def latest_versions(versions: DataFrame, keys: list[str] | str = "comment_id", ordinal: Column | None = None) -> DataFrame:
    """The version that stands after all have arrived in the order of `ordinal` (by default of ingestion).

    A version replaces the standing one if it was updated later, or at the same time, ingested later and has other content.
    So an identical copy that is ingested again never replaces the earlier row. Rows with one ordinal arrive in the order
    of update, ingestion and content.

    Only the versions of a key's greatest update time can matter: before them any version gives way, after them none
    is later. Nor does a version that repeats the content before it, if that was ingested later than all before: by then that content stands.
    Where all that is left of a key was ingested in the order of arrival, the last one stands. The other keys are folded row by row along their
    sorted versions. Neither holds a key's versions together, however many there are."""
    keys = [keys] if isinstance(keys, str) else keys
    columns = versions.columns
    arrival = ordinal if ordinal is not None else F.col("ingested_at")
    of_key = Window.partitionBy(*keys)
    ranked = versions.withColumn("__arrival", arrival).withColumn("__newest", F.max("updated_at").over(of_key))
    ranked = ranked.where(F.col("updated_at").eqNullSafe(F.col("__newest")))
    before = of_key.orderBy("__arrival", "ingested_at", "__content")
    ranked = ranked.withColumn("__content", content(columns))
    highest = F.max("ingested_at").over(before.rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("__latest", F.coalesce(F.col("ingested_at") > highest, F.lit(True)))
    repeats = F.lag("__latest").over(before) & F.lag("__content").over(before).eqNullSafe(F.col("__content"))
    ranked = ranked.withColumn("__repeats", F.coalesce(repeats, F.lit(False))).where(~F.col("__repeats"))
    ranked = ranked.withColumn("__in_order", F.min("__latest").over(of_key))
    last = F.max(F.struct("__arrival", "ingested_at", "__content", F.struct(*columns).alias("row"))).alias("last")
    in_order = ranked.where("__in_order").groupBy(*keys).agg(last).select("last.row.*")
    return in_order.unionByName(_folded(ranked.where("NOT __in_order"), keys, columns))


def _folded(ranked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The standing row of each key, row by row in the order of arrival. Python compares numbers that stand for a key's times of ingestion
    and contents, keeps one row, and hands rows on as Arrow has them."""
    of_key = Window.partitionBy(*keys)
    place = F.row_number().over(of_key.orderBy("__arrival", "ingested_at", "__content"))
    marks = {"__at": F.dense_rank().over(of_key.orderBy("ingested_at")), "__what": F.dense_rank().over(of_key.orderBy("__content")), "__place": place}
    rows = ranked.withColumns(marks).sortWithinPartitions(*keys, "__place").select(*columns, *marks)
    numbers = list(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, what = None, 0, 0  # held: the standing row, if it came with an earlier batch
        for batch in batches:
            own, standing, done = batch.select(columns), None, []
            for i, (new_at, new_what, place) in enumerate(zip(*(batch.column(n).to_pylist() for n in numbers), strict=True)):
                if place == 1:
                    if standing is not None:
                        done.append(standing)
                    elif held is not None:
                        yield held
                if place == 1 or (new_at > at and new_what != what):
                    held, standing, at, what = None, i, new_at, new_what
            if done:
                yield own.take(pa.array(done))
            if standing is not None:
                held = own.take(pa.array([standing]))
        if held is not None:
            yield held

    return rows.mapInArrow(run, ranked.select(*columns).schema)


def merge_batch(existing: DataFrame, incoming: DataFrame, keys: list[str] | str = "comment_id", existing_ordinal: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """All keys' latest versions, and those of them that the batch brought (new keys, and later or changed versions).

    A batch arrives after all that exists, its versions of one key in the order of ingestion; the existing log is in the order of
    `existing_ordinal` (by default of ingestion)."""
    arrival = existing_ordinal if existing_ordinal is not None else iso_text(F.col("ingested_at"))
    before = existing.withColumn(ORDINAL, F.concat(F.lit("0"), arrival.cast("string"))).select(*incoming.columns, ORDINAL)
    both = before.unionByName(incoming.withColumn(ORDINAL, F.concat(F.lit("1"), iso_text(F.col("ingested_at")))))
    merged = latest_versions(both, keys, F.col(ORDINAL))
    return merged.drop(ORDINAL), merged.where(F.col(ORDINAL).startswith("1")).drop(ORDINAL)
