"""What the operators share: sessions, shared folders, Arrow batches, held-out rows."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.session import fresh_dir, remove_dir, shared_dir  # noqa: F401  operators have them from here

#: Rows that an Arrow batch returned by a Python operator holds at most, and bytes after which it is sent.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and cut from its lineage, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of `df` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def held_out(doc_id: Column | str) -> Column:
    """True for rows that no model may learn from: crc32 of doc_id as text, modulo 4, is 2. A null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """All rows up to `bound`, and of more rows those with the smallest hashes of `key`.

    The sample is the same on every run. Only hashes are ranked, so no task or driver holds texts.
    Rows whose key ties with the last one all come in."""
    rank = F.xxhash64(F.lit(17), key)
    last = df.select(rank.alias("rank")).orderBy("rank").limit(bound).agg(F.max("rank")).first()[0]
    return df.where(rank <= F.lit(last))


#: Rows and bytes that Spark sends to Python at a time, where the session has Spark's own default: texts are long, and a batch lies
#: in memory several times over.
SENT = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """`df` mapped batch by batch. Where the session has Spark's default sizes, it gets the smaller ones and keeps them, as Spark reads
    them only when the result is computed."""
    conf = df.sparkSession.conf
    for name, (default, smaller) in SENT.items():
        if conf.get(name) == default:
            conf.set(name, smaller)
    return df.mapInArrow(run, schema)


_KEPT: dict[Hashable, object] = {}


def kept_in_worker(key: Hashable, make: Callable[[], object]) -> object:
    """What `make` returns, once for a Python worker, which keeps it from task to task. A worker keeps one thing only: an
    operator's tables go when another operator's come."""
    if key not in _KEPT:
        forget_kept()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """What the worker kept goes, and its memory back to the machine, as other operators' workers and the JVM share it."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
            c.malloc_trim(0)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[tuple], tuple | None]], keeps: bool = False) -> DataFrame:
    """One row of `schema` for each row of `df` (none where None is returned), made in Python over Arrow batches.

    `make` runs once in each task and returns the function that is applied to the rows' values; it `keeps` something in the
    worker, or what another operator kept goes."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget_kept()
        apply = make()
        yield from to_batches((apply(row) for row in values(batches)), out)

    return map_arrow(df, run, schema)


def values(batches: Iterable[pa.RecordBatch], at_once: int = 200) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples; only `at_once` rows are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


#: Rows of a few numbers that are broadcast, about 50 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def hinted(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """`df` with a hint to broadcast it if it has at most `most` rows. Without `rows` they are counted."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batches(rows: Iterable[tuple | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        if row is None:
            continue
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: Upper-case letters A-Z and their lower-case forms (fixed values).
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(ASCII_UPPER, ASCII_LOWER)

#: Words are runs of characters other than ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_WORD_RE = re.compile(SPACE_WORD)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)
