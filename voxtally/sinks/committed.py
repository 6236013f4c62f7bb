"""A sink whose rows are seen only when the driver has committed the whole write.

Tasks write parquet files of names of their own under `<path>/<run>`, where no reader looks. The driver's commit writes the run's manifest, which
lists the files of the tasks that it took, and moves it to its name in one step; readers read what manifests list. A write that fails
leaves nothing that is seen, and a run that is written again replaces its own rows, at once. Tasks that ran twice, and executors that
were lost, leave at most files that no manifest lists; `remove_unlisted` removes them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COMMITS = "_commits"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (a URI, or a local path) and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str, run: str):
        self.schema, self.path, self.run = schema, path.rstrip("/"), run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.path)
        file, rows, out = f"{self.run}/part-{uuid.uuid4().hex}.parquet", 0, None
        store.create_dir(f"{base}/{self.run}", recursive=True)
        try:
            for batch in iterator:
                if out is None and batch.num_rows:
                    out = pq.ParquetWriter(f"{base}/{file}", batch.schema, filesystem=store)
                if batch.num_rows:
                    out.write_batch(batch)
                    rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{base}/{file}")
            raise
        if out is not None:
            out.close()
        return Written(file if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        before = _manifest(store, base, self.run)
        files = [(m.file, m.rows) for m in messages if m is not None and m.file]
        store.create_dir(f"{base}/{COMMITS}", recursive=True)
        staged = f"{base}/{COMMITS}/.{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as out:
            out.write(json.dumps({"run": self.run, "schema": self.schema.json(), "files": files}).encode())
        store.move(staged, f"{base}/{COMMITS}/{self.run}.json")
        for file, _ in before["files"] if before else ():
            store.delete_file(f"{base}/{file}")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{base}/{m.file}")


class CommittedRows(DataSource):
    """df.write.format("committed_rows").option("path", ...).option("run", ...).mode("append").save(): options are the folder and the run's
    name, which orders the runs."""

    @classmethod
    def name(cls) -> str:
        return "committed_rows"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:  # noqa: ARG002
        run = self.options.get("run", "")
        if not run or run.startswith((".", "_")) or "/" in run:
            raise ValueError("run must name the write, without slashes and not hidden")
        return _Writer(schema, self.options["path"], run)


def _manifest(store: fs.FileSystem, base: str, run: str) -> dict | None:
    name = f"{base}/{COMMITS}/{run}.json"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(name) as source:
        return json.loads(source.read())


def commits(path: str) -> list[dict]:
    """The manifests (run, schema, files with their rows) of a folder, in the order of the runs' names."""
    store, base = _store(path.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(f"{base}/{COMMITS}", allow_not_found=True))
    runs = sorted(f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    return [m for run in runs if (m := _manifest(store, base, run)) is not None]


def append_run(rows: DataFrame, path: str, run: str) -> int:
    """Adds rows as a run, or replaces those of the run of that name; the number of rows, as the tasks counted them."""
    spark = rows.sparkSession
    spark.dataSource.register(CommittedRows)
    rows.write.format("committed_rows").option("path", path).option("run", run).mode("append").save()
    return next(sum(n for _, n in m["files"]) for m in commits(path) if m["run"] == run)


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed runs, with `source_file`, whose order is that of the runs. Spark's own reader gets the listed files."""
    files = [f"{path.rstrip('/')}/{file}" for m in commits(path) for file, _ in m["files"]]
    if not files:
        return spark.createDataFrame([], schema).withColumn("source_file", F.lit(""))
    return spark.read.schema(schema).parquet(*files).select(*schema.names, F.col("_metadata.file_path").alias("source_file"))


def remove_unlisted(path: str) -> int:
    """Removes files that no manifest lists, and returns their number. Only for folders that nothing writes to meanwhile."""
    store, base = _store(path.rstrip("/"))
    listed = {f"{base}/{file}" for m in commits(path) for file, _ in m["files"]}
    stray = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.extension == "parquet" and f.path not in listed]
    for file in stray:
        store.delete_file(file)
    return len(stray)
