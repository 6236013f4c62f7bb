"""Reading landed files: raw pages, the Silver log of comment versions, and any table that SQL names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from voxtally.functions.scalars import parse_instant
from voxtally.schemas import COMMENT, INSTANTS, RAW_PAGE

#: Files, or directories of one run, of a log under video and day.
SILVER_FILES = "*_comments.json"


def read_pages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw pages, one JSON document in a file. A file that isn't JSON fails the read."""
    return spark.read.schema(RAW_PAGE).option("multiLine", True).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COMMENT)


def read_silver(spark: SparkSession, base: str, video_id: str | None = None) -> DataFrame:
    """The log of comment versions with `source_file`, whose order is that of arrival. Only the video's own folder is
    read if one is named; a log that isn't there yet is empty. Timestamps without an offset fail the read."""
    ddl = ", ".join(f"{f.name} {'STRING' if f.name in INSTANTS else f.dataType.simpleString()}" for f in COMMENT.fields)
    try:
        rows = spark.read.schema(ddl).option("mode", "FAILFAST").json(f"{base}/{video_id or '*'}/*/{SILVER_FILES}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty(spark).withColumn("source_file", F.lit(""))
    rows = rows.select(*COMMENT.names, F.col("_metadata.file_path").alias("source_file"))
    for name in INSTANTS:
        parsed = parse_instant(F.col(name))
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull() & parsed.isNull(), F.raise_error(F.lit(f"{name} must include timezone information")).cast("timestamp")).otherwise(parsed))
    return rows


def parquet_log(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """A log of parquet directories; one that isn't there yet is empty."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
