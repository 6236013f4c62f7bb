"""Every registered query of the engine's own operators against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import pytest

from voxtally.plans import registry

SF = Path("/root/testdata/sf0.001")
TABLES = ("documents", "events", "conversations", "pages", "nation", "benchmark", "part")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    spark.catalog.clearCache()
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        answer = connection.execute(registry.ORACLES[name])
        names = [c[0] for c in answer.description]
        want = [dict(zip(names, row, strict=True)) for row in answer.fetchall()]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[c]) for c in columns) for row in want), key=str)


def test_scans_read_only_what_a_query_needs(spark):
    """The facts' comment side reads keys alone, and filters on the grain reach the scan."""
    plan = registry.QUERIES["video_entity_sov"](spark, str(SF)).where("video_id = 'src1'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("text" in s.split("ReadSchema")[1] for s in scans) == 1
    assert all("EqualTo(source,src1)" in s for s in scans)
    assert "Cartesian" not in text and "BroadcastNestedLoopJoin" in text  # the catalog alone is crossed
