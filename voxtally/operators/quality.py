"""Rules that Gold tables must keep, as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.functions.scalars import is_close, is_filled, is_share, ratio
from voxtally.schemas import GOLD

#: For each kind of Gold table: id column, text columns, count of hits, its total, and the two shares.
LAYOUT = {
    "entity": ("entity_id", ("video_id", "entity_type", "entity_id", "group_id", "canonical_name", "dictionary_version"), "mention_comment_count", "entity_type_mention_comment_count", "entity_share_of_voice"),
    "topic": ("topic_id", ("video_id", "topic_id", "display_name", "dictionary_version"), "topic_comment_count", "topic_comment_count_total", "topic_share_of_voice"),
}


def kind_of(table: str) -> str:
    return "entity" if "entity" in table else "topic"


def schema_problems(actual: StructType, expected: StructType) -> list[str]:
    """Missing and extra columns, and columns of another type."""
    have, want = {f.name: f.dataType for f in actual}, {f.name: f.dataType for f in expected}
    out = [f"missing {n}" for n in sorted(want.keys() - have.keys())] + [f"extra {n}" for n in sorted(have.keys() - want.keys())]
    return out + [f"{n} must be {want[n].simpleString()}" for n in sorted(want.keys() & have.keys()) if want[n] != have[n]]


def row_rules(table: str, video_id: str | None = None, version: str | None = None) -> dict[str, Column]:
    """Rules of single rows by name; true where a row breaks one."""
    _, texts, count, total, share = LAYOUT[kind_of(table)]
    rules: dict[str, Column] = {f"{n} must be a non-empty string": ~F.coalesce(is_filled(F.col(n)), F.lit(False)) for n in texts}
    if kind_of(table) == "entity":
        rules["entity_type must be group or member"] = ~F.col("entity_type").isin("group", "member")
    if video_id is not None:
        rules["metric video_id does not match output path"] = ~F.col("video_id").eqNullSafe(F.lit(video_id))
    if version is not None:
        rules["metric dictionary_version does not match output path"] = ~F.col("dictionary_version").eqNullSafe(F.lit(version))
    for n in ("comment_count", count, total):
        rules[f"{n} must be a non-negative integer"] = F.col(n).isNull() | (F.col(n) < 0)
    rules["non-empty Gold metrics require comments"] = F.col("comment_count") == 0
    rules[f"{count} exceeds comment_count"] = F.col(count) > F.col("comment_count")
    for n, whole in (("comment_share_of_voice", "comment_count"), (share, total)):
        rules[f"{n} must be between 0 and 1"] = F.col(n).isNull() | ~is_share(F.col(n))
        rules[f"{n} does not match its numerator and denominator"] = ~is_close(F.col(n), ratio(F.col(count), F.col(whole)))
    rules["snapshot_at must be timezone-aware"] = F.col("snapshot_at").isNull()
    if table.startswith("daily"):
        rules["comment_date must be a date"] = F.col("comment_date").isNull()
    return rules


def _grain(table: str) -> list[str]:
    return ["video_id", *(["comment_date"] if table.startswith("daily") else []), "dictionary_version"]


def group_problems(df: DataFrame, table: str) -> DataFrame:
    """For each group whose total isn't the sum of its counts, or whose shares don't sum to 1 (0 for an empty one): its keys,
    the number of totals, the declared and the counted one, and the sum of shares."""
    _, _, count, total, share = LAYOUT[kind_of(table)]
    keys = [*_grain(table), *(["entity_type"] if kind_of(table) == "entity" else [])]
    sums = df.groupBy(*keys).agg(F.count_distinct(total).alias("totals"), F.max(total).alias("declared"), F.sum(count).alias("counted"), F.sum(share).alias("share_sum"))
    whole = F.when(F.col("declared") > 0, 1.0).otherwise(0.0)
    return sums.where((F.col("totals") != 1) | (F.col("declared") != F.col("counted")) | ~is_close(F.col("share_sum"), whole))


def snapshot_problems(df: DataFrame, table: str) -> DataFrame:
    """Groups over all kinds of terms in which comment_count or snapshot_at differ."""
    spread = df.groupBy(*_grain(table)).agg(F.count_distinct("comment_count").alias("comment_counts"), F.count_distinct("snapshot_at").alias("snapshots"))
    return spread.where("comment_counts <> 1 OR snapshots <> 1")


def repeated_keys(df: DataFrame, table: str) -> DataFrame:
    keys = [*_grain(table), *(["entity_type"] if kind_of(table) == "entity" else []), LAYOUT[kind_of(table)][0]]
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def violations(df: DataFrame, table: str, video_id: str | None = None, version: str | None = None) -> DataFrame:
    """rule, row_count: every rule that the table breaks. The table is read once: rows are summed by key, keys by group and kind of
    term, those by group, and these over the table, each with the problems found so far."""
    rules = row_rules(table, video_id, version)
    id_col, _, count, total, share = LAYOUT[kind_of(table)]
    grain, kind = _grain(table), ["entity_type"] if kind_of(table) == "entity" else []
    names = {name: f"__rule_{i}" for i, name in enumerate(rules)}
    names |= {"group totals": "__totals", "snapshot consistency": "__snapshots", "duplicate logical key": "__keys"}
    summed = lambda done: [F.sum(names[n]).alias(names[n]) for n in done]
    ends = lambda columns: [f(n).alias(f"{e}_{n}") for n in columns for e, f in (("low", F.min), ("high", F.max))]
    ends_of = lambda columns: [f(f"{e}_{n}").alias(f"{e}_{n}") for n in columns for e, f in (("low", F.min), ("high", F.max))]
    one = lambda n: F.coalesce(F.col(f"low_{n}") == F.col(f"high_{n}"), F.lit(False))
    flag = lambda test: F.when(F.coalesce(test, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long")
    same = ["comment_count", "snapshot_at"]

    rows = df.select(*grain, *kind, id_col, *dict.fromkeys([count, total, share, *same]), *(flag(test).alias(names[n]) for n, test in rules.items()))
    keys = rows.groupBy(*grain, *kind, id_col).agg(*summed(rules), *ends([*same, total]), F.sum(count).alias("counted"), F.sum(share).alias("share_sum"), flag(F.count("*") > 1).alias("__keys"))
    groups = keys.groupBy(*grain, *kind).agg(*summed([*rules, "duplicate logical key"]), *ends_of([*same, total]), F.sum("counted").alias("counted"), F.sum("share_sum").alias("share_sum"))
    whole = F.when(F.col(f"high_{total}") > 0, 1.0).otherwise(0.0)
    wrong = ~one(total) | (F.col(f"high_{total}") != F.col("counted")) | ~is_close(F.col("share_sum"), whole)
    groups = groups.withColumn("__totals", flag(wrong))
    tops = groups.groupBy(*grain).agg(*summed([*rules, "duplicate logical key", "group totals"]), *ends_of(same))
    tops = tops.withColumn("__snapshots", flag(~(one("comment_count") & one("snapshot_at"))))
    found = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(c).alias("row_count")) for n, c in names.items()))).alias("x")
    return tops.agg(*summed(names)).select(found).select("x.*").where("row_count > 0")


def require_gold(df: DataFrame, table: str, video_id: str | None = None, version: str | None = None) -> None:
    """ValueError naming what a Gold table breaks. An empty table is valid."""
    problems = schema_problems(df.schema, GOLD[table])
    if problems:
        raise ValueError(f"{table} schema mismatch: {', '.join(problems)}")
    found = sorted((r["rule"], r["row_count"]) for r in violations(df, table, video_id, version).collect())
    if found:
        raise ValueError(f"{table}: " + "; ".join(f"{rule} ({n} rows)" for rule, n in found))
