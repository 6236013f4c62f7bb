"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words (runs of characters other than ASCII white space). Sources by code point, null last, weigh 3, 1, 2,
repeating, and share `SHARE` times all words by weight. No target is above `REPEATS` times its source's words; what is
over is shared again by weight among the others until none is above.

Blocks: the documents of a source are dealt by a hash of id and text into blocks of about equal size, a power of two that grows
with the source. A seeded permutation orders the blocks (block b of n is number a b + c mod n, a odd, a and c by source). A source's
quota is a number of blocks drawn in this order, once or twice around.

Edge: of the `EDGE_BLOCKS` around the quota's end documents are taken whole. While a source has more than `EDGE_DOCS` documents there, they
are dealt again into smaller blocks, of which those before the end are taken, those behind it are not, and those around it are left over. What is
left at last, a few hundred documents however large the source is, is taken in hash order and at the end by what still fits, so that a source's
words miss its target by a few at most unless it has few documents.

Shards: a binary tree over the output shards splits the vector of block quotas. At each node the left half's number of
blocks from each source is drawn, one source after the other, from the hypergeometric law of drawing the left half's share
of all blocks below this node without replacement. Sources are split in `GROUPS` groups: first the vector of the groups' quotas on the driver,
then, within the numbers that a group got, its sources, each group in a task; both steps together follow the same law. All
leaves of a source take consecutive ranges of its permuted blocks, which are disjoint. Within a shard rows are ordered by a hash.

Every draw is seeded, so reruns agree. The plan is a table with a row for each source; a document finds its block, its shards and its
place at the edge by arithmetic from its hash and that row, so no table of blocks or documents is joined, but for the few documents that are left at an
edge. The driver holds `GROUPS` numbers for each shard, never sources, blocks or documents. The plan is broadcast up to `BROADCAST_SOURCES` rows,
beyond that joined by a shuffle.

Null or empty texts have size 0; the mix takes nothing of them. A null source is a source of its own. Rows with equal id and
text are drawn alike. Other columns, whatever their names, are kept by `mix` and ignored by `mixing_report`. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import SPACE_WORD, checkpointed, hinted

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
SHARDS, SEED = 16, 20
#: Words for which a source gets another block (in powers of two), and its most blocks; larger sources have larger blocks.
BLOCK_WORDS, BLOCKS_PER_SOURCE = 20_000, 4096
#: Blocks around a quota's end, the documents of a source that may be left over there, and how many a smaller block should have. There are
#: at least `EDGE_LEAST` smaller blocks, so that each level leaves about a quarter or less.
EDGE_BLOCKS, EDGE_DOCS, EDGE_DEALT, EDGE_LEAST = 8, 1000, 16, 32
GROUPS, BROADCAST_SOURCES = 1024, 200_000


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Adds at (rank by code point, null last), weight and target to source, source_size. Sorted in ranges, whose sizes give the ranks; the
    level of words for a unit of weight is found in a few sums over the table."""
    ranges = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__number", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("__range", F.shiftright("__number", 33).cast("int")).withColumn("__place", F.col("__number").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["__range"], r["n"]) for r in ranges.groupBy("__range").agg(F.count("*").alias("n")).collect())  # a row for each task
    bases = np.cumsum([0, *(n for _, n in counts)])[:-1].tolist()
    first = sources.sparkSession.createDataFrame([(r, int(base)) for (r, _), base in zip(counts, bases, strict=True)], "__range int, __base long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranges.join(F.broadcast(first), "__range").withColumn("at", F.col("__base") + F.col("__place")).withColumn("weight", weight)
    ranked = ranked.drop("__range", "__place", "__number", "__base")
    most = F.col("source_size") * float(repeats)
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:  # each round closes sources, which raises the level for the others
        over = F.lit(level) * F.col("weight") > most
        sums = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("closed"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not sums["open"] or sums["n"] == before:
            break
        level, before = (total - repeats * sums["closed"]) / sums["open"], sums["n"]
    return ranked.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def split_quotas(quotas: list[int], shards: int, seed: object = SEED, sums: np.ndarray | None = None) -> np.ndarray:
    """quotas[source] blocks to blocks[shard, source]: each source's blocks add up to its quota, and the shards' totals
    to `sums`; without them, they differ by no more than the rounding of each halving."""
    out = np.zeros((shards, len(quotas)), "i8")
    seeds = list(seed) if isinstance(seed, list | tuple) else [seed]

    def down(first: int, last: int, counts: np.ndarray) -> None:
        if last - first == 1:
            out[first] = counts
            return
        middle = (first + last) // 2
        random = np.random.default_rng([*seeds, first, last])
        total = int(counts.sum())
        draw, rest = total * (middle - first) // (last - first) if sums is None else int(sums[first:middle].sum()), total
        left = np.zeros_like(counts)
        for i, count in enumerate(counts.tolist()):
            rest -= count
            left[i] = _hypergeometric(random, count, rest, draw)
            draw -= int(left[i])
        down(first, middle, left)
        down(middle, last, counts - left)

    down(0, shards, np.asarray(quotas, "i8"))
    return out


def _hypergeometric(random: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """numpy's draws are bounded to 10^9 of each kind; larger counts are drawn in units of what still fits."""
    unit = -(-max(good, bad, 1) // 999_999_999)
    if unit == 1:
        return int(random.hypergeometric(good, bad, draw))
    value = unit * int(random.hypergeometric(good // unit, bad // unit, min(draw // unit, good // unit + bad // unit)))
    return min(max(value, draw - bad, 0), good, draw)


def _tie(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


#: What is added to the rows; set apart from the rows' own columns, whatever these are called.
SIZED = "source", "size", "key"


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """Source, number of words, and a hash of id and text."""
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SPACE_WORD)).cast("long")
    return F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(SEED), F.col(id_col), _tie(text_col)).alias("key")


def _number(key: Column, at: Column, blocks: Column) -> Column:
    """The number of a document's block in its source's order; `blocks` is a power of two."""
    block = F.xxhash64(F.lit(SEED + 1), key)
    odd = F.xxhash64(F.lit(SEED + 2), at).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(0xFFFF))
    return (block.bitwiseAND(blocks - 1) * odd + F.xxhash64(F.lit(SEED + 3), at).bitwiseAND(F.lit(0xFFFF))).bitwiseAND(blocks - 1)


def _dealt(key: Column, level: Column, blocks: Column) -> Column:
    """The number of a document's smaller block on a level of the edge."""
    return F.xxhash64(F.lit(SEED + 4), key, level).bitwiseAND(blocks - 1)


def _power(n: Column, most: int) -> Column:
    """The greatest power of two up to n, from 1 to `most`."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.least(n, F.lit(most)), F.lit(1)).cast("double")))).cast("long")


def _around(sums: DataFrame, words: Column, blocks: Column) -> DataFrame:
    """Of numbered blocks (at, number, words) in their order: reached (numbers that fit into `words`), first and last of the blocks
    around that place, and before, the words of those before first. At most `BLOCKS_PER_SOURCE` rows of a source come together."""
    order = Window.partitionBy("at").orderBy("number")
    upto = sums.withColumn("upto", F.sum("words").over(order))
    fits = F.col("upto") <= words
    reached = upto.groupBy("at").agg(F.coalesce(F.min(F.when(~fits, F.col("number"))), F.max(blocks)).alias("reached"), F.max(blocks).alias("of"))
    reached = reached.withColumn("last", F.least("of", F.col("reached") + EDGE_BLOCKS // 2)).withColumn("first", F.greatest(F.lit(0), F.col("last") - EDGE_BLOCKS))
    before = upto.join(reached, "at").groupBy("at", "reached", "first", "last")
    return before.agg(F.coalesce(F.sum(F.when(F.col("number") < F.col("first"), F.col("words"))), F.lit(0).cast("long")).alias("before"))


def plan_sources(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A row for each source: source, at, source_size, target, blocks, quota (blocks to draw), ends (the quota's sums over the
    shards), edge (levels of blocks, first, last around the end); and the documents (at, key) that are taken of those left over at edges."""
    sources = with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    sources = checkpointed(sources.withColumn("blocks", _power(F.col("source_size") / BLOCK_WORDS, BLOCKS_PER_SOURCE)))
    n_sources = sources.count()  # all that follows broadcasts tables by source only up to a number of sources
    placed = sized.where("size > 0").join(hinted(sources.withColumnRenamed("source", "p_source"), n_sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("p_source")))
    placed = placed.select("at", "key", "size", "blocks", _number(F.col("key"), F.col("at"), F.col("blocks")).alias("number"))
    sums = placed.groupBy("at", "number", "blocks").agg(F.sum("size").alias("words"))
    want = sources.select("at", F.round("target").cast("long").alias("want"), "source_size")
    sums = sums.join(hinted(want, n_sources, BROADCAST_SOURCES), "at").withColumn("rounds", F.floor(F.col("want") / F.col("source_size")))
    ends = _around(checkpointed(sums), F.col("want") - F.col("rounds") * F.col("source_size"), F.col("blocks"))
    rows = sources.join(ends, "at", "left").withColumn("want", F.round("target").cast("long"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(F.lit(0))
    over = F.col("want") - rounds * F.col("source_size")
    rows = rows.withColumn("open", (F.col("source_size") > 0) & (over > 0)).withColumn("left", over - F.col("before"))
    quota = F.when(F.col("source_size") > 0, rounds * F.col("blocks") + F.when(F.col("open"), F.col("last")).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")
    rows = checkpointed(rows.select("source", "at", "source_size", "target", "blocks", quota.alias("quota"), "open", "first", "last", "left"))
    levels, fits = _edges(placed, rows.where("open"), n_sources)
    split = _split(rows, n_sources, shards, seed)
    plan = rows.join(split, "at", "left").join(levels, "at", "left")
    plan = plan.select("source", "at", "source_size", "target", "blocks", "quota", "ends", F.when(F.col("open"), F.col("first")).alias("first"), "last", "edge")
    return hinted(plan, n_sources, BROADCAST_SOURCES), fits


def _edges(placed: DataFrame, rows: DataFrame, n_sources: int) -> tuple[DataFrame, DataFrame]:
    """at, edge (levels), and the documents taken at last."""
    bounds = rows.select(F.col("at"), F.col("first"), F.col("last"), "left")
    open_ = checkpointed(placed.join(hinted(bounds, n_sources, BROADCAST_SOURCES), "at").where("number >= first AND number < last").groupBy("at", "key").agg(F.sum("size").alias("size"), F.first("left").alias("left")))
    levels = rows.select("at", F.array().cast("array<struct<blocks:bigint,first:bigint,last:bigint>>").alias("edge"))
    done = []
    level = 0
    while True:
        large = open_.groupBy("at").agg(F.count("*").alias("docs")).where(F.col("docs") > EDGE_DOCS)
        large = large.select("at", F.greatest(F.lit(EDGE_LEAST).cast("long"), _power(F.col("docs") / EDGE_DEALT, BLOCKS_PER_SOURCE)).alias("blocks"))
        n_large = large.count()
        if not n_large:
            done.append(open_)
            break
        large = checkpointed(large)
        done.append(open_.join(hinted(large, n_large, BROADCAST_SOURCES), "at", "left_anti"))
        dealt = open_.join(hinted(large, n_large, BROADCAST_SOURCES), "at").withColumn("number", _dealt(F.col("key"), F.lit(level), F.col("blocks")))
        sums = checkpointed(dealt.groupBy("at", "number", "blocks", "left").agg(F.sum("size").alias("words")))
        ends = _around(sums, F.col("left"), F.col("blocks")).drop("reached")
        ends = checkpointed(ends.join(large, "at"))
        more = ends.select("at", F.struct("blocks", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).alias("more"))
        levels = levels.join(more, "at", "left").select("at", F.when(F.col("more").isNull(), F.col("edge")).otherwise(F.concat("edge", F.array("more"))).alias("edge"))
        open_ = dealt.drop("blocks").join(hinted(ends.select("at", "first", "last", "before"), n_large, BROADCAST_SOURCES), "at").where("number >= first AND number < last")
        open_ = checkpointed(open_.select("at", "key", "size", (F.col("left") - F.col("before")).alias("left")))
        level += 1
    left = done[0]
    for more in done[1:]:
        left = left.unionByName(more)
    fits = left.groupBy("at").applyInPandas(_fitting, "at long, key long")
    return levels, checkpointed(fits)


def _split(rows: DataFrame, n_sources: int, shards: int, seed: int) -> DataFrame:
    """at, ends: for each source the running sums over the shards of the blocks that they draw."""
    groups = min(GROUPS, max(1, n_sources))
    grouped = rows.select("at", "quota", F.floor(F.col("at") * groups / max(1, n_sources)).cast("int").alias("group"))
    totals = np.zeros(groups, "i8")
    for r in grouped.groupBy("group").agg(F.sum("quota").alias("n")).collect():  # at most GROUPS rows
        totals[r["group"]] = r["n"]
    sums = split_quotas(totals.tolist(), shards, seed)

    def of_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        group = int(frame["group"].iloc[0])
        split = split_quotas(frame["quota"].tolist(), shards, [seed, group], sums[:, group])
        return pd.DataFrame({"at": frame["at"], "ends": split.cumsum(0).T.tolist()})

    return grouped.groupBy("group").applyInPandas(of_group, "at long, ends array<long>")


def _fill(sizes: np.ndarray, words: int) -> np.ndarray:
    """True for what is taken of `sizes`: in order until one doesn't fit into `words`, then the largest others that fit."""
    n = int(np.searchsorted(np.cumsum(sizes), words, side="right"))
    taken = np.arange(len(sizes)) < n
    left = words - int(sizes[:n].sum())
    for i in (n + np.argsort(-sizes[n:], kind="stable")).tolist():
        if sizes[i] <= left:
            taken[i] = True
            left -= int(sizes[i])
    return taken


def _fitting(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the documents left over at the end of a source's quota, those that are taken: filled up from the first in hash order,
    or emptied from the last, whichever comes nearer to what is left of the target."""
    frame = frame.sort_values("key", ignore_index=True)
    sizes, words = frame["size"].to_numpy(), int(frame["left"].iloc[0])
    full = _fill(sizes, words)
    emptied = ~_fill(sizes[::-1], int(sizes.sum()) - words)[::-1]
    best = min((full, emptied), key=lambda taken: abs(int(sizes[taken].sum()) - words))
    return frame.loc[best, ["at", "key"]]


def _with_shards(rows: DataFrame, sized: DataFrame, **how) -> DataFrame:
    """`rows` has struct columns or others beside source, size and key, `sized` these alone. Adds source_size, target and shards. All that is
    joined is small, so the rows stay where they are."""
    plan, fits = plan_sources(sized, **how)
    plan = plan.withColumnRenamed("source", "p_source")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("number", _number(F.col("key"), F.col("at"), F.col("blocks")))
    # the copies of block k are draws k, k + blocks, ... below the quota; a draw belongs to the shard whose end is the first above it
    draws = F.when((F.col("number") < F.col("quota")) & (F.col("size") > 0), F.sequence(F.col("number"), F.col("quota") - 1, F.col("blocks"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("drawn", F.transform(draws, lambda d: F.size(F.filter("ends", lambda e: e <= d))))
    # at the edge: taken, not taken, or left over, by the first level that decides
    zero = F.lit(None).cast("int")

    def decide(so_far: Column, x: Column) -> Column:
        number = _dealt(F.col("key"), x["level"], x["blocks"])
        return F.when(so_far.isNotNull(), so_far).when(number < x["first"], F.lit(1)).when(number >= x["last"], F.lit(0))

    levels = F.transform("edge", lambda x, i: F.struct(i.alias("level"), x["blocks"].alias("blocks"), x["first"].alias("first"), x["last"].alias("last")))
    rows = rows.withColumn("edge", F.when((F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")), F.coalesce(F.aggregate(levels, zero, decide), F.lit(2))))
    rows = rows.join(hinted(fits.select(F.col("at").alias("f_at"), F.col("key").alias("f_key"))), (F.col("at") == F.col("f_at")) & (F.col("key") == F.col("f_key")) & (F.col("edge") == 2), "left")
    fewer = F.slice("drawn", 1, F.greatest(F.size("drawn") - 1, F.lit(0)))
    return rows.withColumn("shards", F.when((F.col("edge") == 0) | (F.col("edge") == 2) & F.col("f_key").isNull(), fewer).otherwise(F.col("drawn")))


def _order(key: Column, copy: Column, shard: Column) -> Column:
    """The hash by which a shard's rows are shuffled."""
    return F.xxhash64(F.lit(SEED + 5), key, copy, shard)


def mixing_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), shards, orders: for each document row what the mix takes of it, into which shards,
    and the hashes that place it in their order."""
    sized = checkpointed(docs.select(F.col(id_col).alias("doc_id"), *_sized(docs, id_col, text_col, source_col)))
    rows = _with_shards(sized, sized.select(*SIZED), **how)
    orders = F.transform("shards", lambda s, i: _order(F.col("key"), i, s))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), F.array_join("shards", ",").alias("shards"), F.array_join(orders, ",").alias("orders"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_shard: bool = False, **how) -> DataFrame:
    """The rows that the mix takes, all columns, each as often as it is taken. `with_shard` adds shard and shard_order,
    the hash by which a shard's rows are shuffled."""
    sized = checkpointed(docs.select(*_sized(docs, id_col, text_col, source_col)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_sized(docs, id_col, text_col, source_col))
    taken = _with_shards(rows, sized, **how).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
    more = ["shard", _order(F.col("key"), F.col("copy"), F.col("shard")).alias("shard_order")] if with_shard else []
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns), *more)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """The mix as Parquet, a folder for each shard, whose rows are in the shard's own shuffled order. The tree gives all shards
    the same number of blocks to within one for each of its levels, so no shard is much larger than another."""
    rows = mix(docs, with_shard=True, shards=shards, **how)
    # ranges of the order within a shard, so that a large shard is several sorted files
    rows.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order").write.mode("overwrite").partitionBy("shard").parquet(path)
