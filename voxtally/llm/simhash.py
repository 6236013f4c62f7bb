"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

Fingerprints: ASCII letters are lower-cased, words are runs of characters other than ASCII white space, shingles are 4
neighbouring words joined by one space, repeats included (fewer words: the whole sequence). A bit of the 64-bit
fingerprint is 1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42). No words: fingerprint 0.

Links: fingerprints with at most `RADIUS` = 4 differing bits. Two points at distance 4 have a point in common that lies
within 2 of both, so each emits every variant within half the radius and equal variants meet. All 2,081 variants of the
64-bit word for every fingerprint would be over 30 times the input's bytes. So:

1. Of the two 32-bit halves of a pair one differs in at most 2 bits. Each half's ball has radius 2, half of that is 1:
   every distinct fingerprint emits the 33 variants of each half, 66 rows. Rows are shuffled on the variant. Where at most
   `SMALL` fingerprints meet, each pair is verified on all 64 bits, and only links leave the bucket, each from one of
   the buckets in which it shows.
2. Where more meet, every fingerprint of such a bucket emits its 2,081 variants of the whole word. Fingerprints that
   meet there lie within 2 + 2 bits of each other, so each is linked to the smallest one: as many links as members.

Every pair within the radius meets in step 1, and if only in large buckets, both go through step 2: no link between
different groups is lost and no bucket emits all its pairs. Equal fingerprints are one point throughout.

Null text counts as empty. A null id takes part; a group's id is its smallest id that isn't null. Repeated rows stay rows
of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import LOWER_TABLE, SPACE_WORD_RE, checkpointed, hinted, map_rows, unused
from voxtally.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a bucket that are compared pair by pair.
SMALL = 256
#: Buckets with three or more fingerprints that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_BUCKETS = 500_000


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    words = SPACE_WORD_RE.findall((text or "").translate(LOWER_TABLE))
    if not words:
        return 0
    if len(words) > SHINGLE:
        shingles = map(" ".join, zip(words, words[1:], words[2:], words[3:], strict=False))
    else:
        shingles = [" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s.encode(), SEED) for s in shingles]), "u1").reshape(-1, 8)
    set_in = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65_536):
        set_in += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(0, dtype="i8")
    return int(np.packbits(set_in * 2 > len(hashes)).view(">i8")[0])


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (hash of the text), fp: the fingerprint of every whole text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), _tie(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "doc_id long, tie long, fp long", lambda: lambda row: (row[0], row[1], fingerprint(row[2])))


def _ball(value: Column, bits: int, flips: int) -> Column:
    """All values that differ from `value` in at most 1 or 2 of the lowest `bits` bits."""
    one = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(bits)]
    masks = F.array(F.lit(0).cast("long"), *one)
    if flips == 2:
        masks = F.concat(masks, F.array(*(F.lit((1 << i | 1 << j) - (1 << 64 if 1 << i | 1 << j >= 1 << 63 else 0)) for j in range(bits) for i in range(j))))
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _half_variants(fp: Column) -> Column:
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    marked = F.transform(_ball(high, 32, 1), lambda v: v.bitwiseOR(F.lit(1 << 32)))
    return F.concat(_ball(low, 32, 1), marked)


def _meets_here(a: Column, b: Column, key: Column) -> Column:
    """True in one or two of the buckets in which two fingerprints meet. With equal halves that is the bucket of the half
    itself; at one bit apart that of the smaller; at two bits apart the smaller of the two points between them."""
    high = key >= 1 << 32
    half = lambda x: F.when(high, F.shiftrightunsigned(x, 32)).otherwise(x.bitwiseAND(F.lit(0xFFFFFFFF)))
    own = key.bitwiseAND(F.lit(0xFFFFFFFF))
    x, y = half(a), half(b)
    other = x.bitwiseXOR(y).bitwiseXOR(own)
    return F.when(x == y, own == x).when(F.bit_count(x.bitwiseXOR(y)) == 1, own == F.least(x, y)).otherwise(own < other)


def links(points: DataFrame) -> DataFrame:
    """a, b (a < b): links between distinct fingerprints (column fp) that keep every group within the radius together."""
    near = lambda a, b, key: (F.bit_count(a.bitwiseXOR(b)) <= RADIUS) & _meets_here(a, b, key)
    variants = points.select("fp", F.explode(_half_variants(F.col("fp"))).alias("key"))
    met = checkpointed(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = met.where("n = 2").where(near(F.col("a"), F.col("b"), F.col("key"))).select("a", "b")
    more = met.where("n > 2").select("key", "n")
    members = checkpointed(variants.join(hinted(more, most=BROADCAST_BUCKETS), "key"))
    some = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    some = some.select("key", "fps", F.posexplode("fps").alias("at", "a"))
    some = some.select("a", F.explode(F.filter(F.slice("fps", F.col("at") + 2, F.size("fps")), lambda b: near(F.col("a"), b, F.col("key")))).alias("b"))
    many = members.where(F.col("n") > SMALL).select("fp").distinct()
    return twos.unionByName(some).distinct().unionByName(_star_links(checkpointed(many)))


def _star_links(points: DataFrame) -> DataFrame:
    variants = points.select("fp", F.explode(_ball(F.col("fp"), 64, 2)).alias("key"))
    met = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    twos = met.where("n = 2").select("a", "b")
    more = variants.join(met.where("n > 2").select("key", "a"), "key").where("fp <> a").select("a", F.col("fp").alias("b"))
    return twos.unionByName(more).distinct()


def _rooted(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, tie (hash of the text), fp; and for each fingerprint its group's root."""
    prints = checkpointed(fingerprints(df, id_col, text_col))
    points = checkpointed(prints.groupBy("fp").agg(F.min(_rank()).alias("first")))
    roots = connected_components(links(points.select("fp")))
    linked = checkpointed(points.join(roots.withColumnRenamed("node", "fp"), "fp"))  # fingerprints that have a link
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    moved = linked.join(best, "root").select("fp", "best")
    named = points.join(moved, "fp", "left").select("fp", F.coalesce("best", "first").alias("best"))
    return prints, checkpointed(named)  # so that the documents of a hot fingerprint can be split in the join with it


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach from the row's fingerprint)."""
    prints, named = _rooted(df, id_col, text_col)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, with one document of each group: that with the smallest id, null last, then by a hash
    of the text. Of rows that agree in both, one stays."""
    prints, named = _rooted(df, id_col, text_col)
    ranked = checkpointed(prints.join(named, "fp").select("doc_id", "tie", (_rank() == F.col("best")).alias("stays")))
    tie = _tie(F.col(text_col))

    def key(name: str) -> Column:
        own, own_tie = unused(df, f"{name}_id", f"{name}_tie")
        return F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (tie == F.col(own_tie))

    def keys(rows: DataFrame, name: str) -> DataFrame:
        own, own_tie = unused(df, f"{name}_id", f"{name}_tie")
        return rows.select(F.col("doc_id").alias(own), F.col("tie").alias(own_tie))

    gone = checkpointed(keys(ranked.where("NOT stays").distinct(), "gone"))
    rest = df.join(hinted(gone), key("gone"), "left_anti")
    twice = checkpointed(ranked.where("stays").groupBy("doc_id", "tie").count().where("count > 1"))
    if twice.isEmpty():
        return rest
    again = hinted(keys(twice, "twice"))
    (own_tie,) = unused(df, "tie")
    one = rest.join(again, key("twice"), "left_semi").withColumn(own_tie, tie).dropDuplicates([id_col, own_tie]).drop(own_tie)
    return rest.join(again, key("twice"), "left_anti").unionByName(one)
