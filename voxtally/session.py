"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: UTC days and instants; errors instead of silent nulls in arithmetic; adaptive plans split skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Only where the session names no shared folder and all of Spark is on this machine, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def get_session(app: str = "voxtally", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir; ValueError if a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _placed(spark: SparkSession, path: str) -> tuple:
    """The store of a path, and the path as Hadoop has it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    store, place = _placed(spark, path)
    return store.exists(place)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store it is."""
    store, place = _placed(spark, path)
    store.delete(place, True)
