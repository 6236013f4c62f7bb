"""Groups of documents whose shingle sets are alike: an exact Jaccard join by T-occurrence search.

Sets: ASCII letters are lower-cased, words are runs of characters other than ASCII white space; a document's set holds its distinct
shingles of 4 neighbouring words (fewer words: the whole sequence as one). Two documents link when 100 x shared >= 85 x union.
Shingles are 64-bit hashes: two documents are told apart wrongly only if shingles of these two collide (below 1 in 10 billion for a
pair of 20,000 shingles each).

1. Documents with equal sets are one point (128-bit digest), however many they are.
2. Linked sets of which the larger has up to `top` shingles differ in at most H = 6 top / 37 of them. Each set is cut into over H
   parts by ranges of the hash; a difference touches one part, so linked sets share a whole part that isn't empty, and its key.
   Sizes lie in bands whose ends differ by 85 in 100; a set has keys for its own band and, as the smaller one, for the next. A set of
   which at most H parts hold anything also has keys for its empty parts, so that two such sets meet too. Points that share keys are
   connected to clusters: links never leave a cluster. Of each key only the smallest point is linked to the others.
3. A cluster of over `BLOCK` shingles is clustered again by the shingles themselves, rarest in such clusters first: linked sets share
   one of the first n - ceil(0.85 n) + 1. So passages that many documents share hold nothing together.
4. Each cluster is a unit: an inverted index from shingle to points, in which points are searched by DivideSkip. For a set of n
   shingles a partner must stand in T = ceil(0.85 n) lists. The L longest lists, L = T / (mu log2 longest + 1), are put aside; the short
   ones are merged, and what stands in T - L of them is probed for in the long ones by binary search. The count is then the exact
   overlap. A point that is connected to what ends as the unit's largest group needn't be searched with: a link from it to
   another group is found by that group's searches.
5. A cluster that is still larger is cut into blocks by hash: its first point is searched for in all blocks, and then the points that
   aren't linked to it, block by block, in all blocks. A group of copies of any size costs one search, and what is not near its first point
   costs one for each such point and block.

Null and empty texts have the empty set, which links with nothing. A null id takes part; a component's id is its smallest id
that isn't null. Repeated rows stay rows. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, checkpointed, forget_kept, hinted, kept_in_worker, map_arrow, to_batches
from voxtally.llm.components import connected_components

SHINGLE, SHARED, UNION = 4, 100, 85  # linked: SHARED x shared >= UNION x union
#: Shingles of a unit's index, and of its searches.
BLOCK = 2_000_000
#: Keys that several points share that are broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: DivideSkip's factor for the number of lists put aside.
MU = 0.01
#: Words whose hashes a worker remembers; places probed at a time.
WORDS, PROBED = 300_000, 2_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_HALF, _SHIFT = np.uint64(32), np.uint64(29)


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for; it starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _ODD[3]
    x = (x ^ (x >> _HALF)) * _ODD[3]
    return x ^ (x >> _HALF)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], "u8")
    each = np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
    out = each[: 1 - SHINGLE]
    for i in range(1, SHINGLE):
        out = (out ^ (out >> _SHIFT)) * _ODD[i - 1] + each[i : len(each) - SHINGLE + 1 + i]
    return np.unique(_mixed(out))


def _bands() -> np.ndarray:
    """The largest size of each band."""
    tops, low = [], 1
    while low < 1 << 40:
        tops.append(low * SHARED // UNION)
        low = tops[-1] + 1
    return np.array(tops)


_TOPS = _bands()


def part_keys(sets: np.ndarray) -> np.ndarray:
    """Keys of a set's parts, for its own band of sizes and the next; linked sets of different shingles share one."""
    band = int(np.searchsorted(_TOPS, len(sets)))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_mixed(sets ^ _ODD[0]))])
    keys = [np.zeros(0, "u8")]
    for at in (band, band + 1):
        most = 6 * int(_TOPS[at]) // 37  # shingles in which linked sets differ, at 85 in 100
        if not most:
            continue
        parts = most + 2 + (most // 64 if most < 8 else 1 + most // 64)
        part = ((sets >> _HALF) * np.uint64(parts)) >> _HALF
        ends = np.searchsorted(part, np.arange(parts + 1, dtype="u8"))
        own = _mixed(sums[ends[1:]] - sums[ends[:-1]] + _mixed(np.arange(parts, dtype="u8") + np.uint64((at + 1) << 32)))
        held = ends[1:] > ends[:-1]
        keys.append(own if held.sum() <= most else own[held])
    return np.concatenate(keys)


def _hashes() -> WordHashes:
    return kept_in_worker("word hashes", WordHashes)


def points(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie (hash of the text), n (shingles), point (digest of the set; null: empty), node (its first 64 bits), keys."""
    import xxhash

    schema = "doc_id long, tie long, n long, point binary, node long, keys array<long>"
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            rows, size = [], 0
            for doc_id, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(text, hashes)
                point = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                keys = part_keys(own).view("i8") if len(own) else []
                rows.append((doc_id, tie, len(own), point, int.from_bytes(point[:8], "big", signed=True) if point else None, keys))
                size += len(keys)
                if size > 500_000:
                    yield from to_batches(rows, out)
                    rows, size = [], 0
            yield from to_batches(rows, out)

    rows = df.select(F.col(id_col).cast("long"), _tie(F.col(text_col)), F.col(text_col).cast("string"))
    return map_arrow(rows, run, schema)


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _clusters(rows: DataFrame, key: list[str], node: str) -> DataFrame:
    """node, root: rows (key, node) connected where they share a key; only nodes that share one."""
    met = checkpointed(rows.groupBy(*key).agg(F.min(node).alias("a"), F.max(node).alias("last")).where("a <> last").select(*key, "a"))
    return connected_components(rows.join(hinted(met, most=BROADCAST_KEYS), key).select("a", F.col(node).alias("b")).where("a <> b").distinct())


def _members(df: DataFrame, rows: DataFrame, clusters: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cluster, point, n, shingles: a row for each point of a cluster, its shingles from one of its documents."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    wanted = rows.where("n > 0").join(hinted(clusters), "node").groupBy("point", "root").agg(first)
    wanted = checkpointed(wanted.select("root", "point", F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie")))
    texts = df.select(F.col(id_col).cast("long").alias("id"), _tie(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("said"))
    texts = texts.join(hinted(wanted), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))).select("root", "point", "said")
    schema = "cluster long, point binary, n long, shingles array<long>"
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            rows, size = [], 0
            for cluster, point, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(said, hashes)
                rows.append((cluster, point, len(own), own.view("i8")))
                size += len(own)
                if size > 500_000:
                    yield from to_batches(rows, out)
                    rows, size = [], 0
            yield from to_batches(rows, out)

    members = checkpointed(map_arrow(texts, run, schema))
    return members if members.count() == wanted.count() else checkpointed(members.dropDuplicates(["point"]))  # rows may agree in id and text


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.sum("n").alias("size"), F.min("point").alias("first"))


def _of_large(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members of clusters that make one unit, and those of larger ones (None: there are none) with the cluster's size and first point."""
    large = checkpointed(_sizes(members).where(F.col("size") > BLOCK))
    if large.isEmpty():
        return members, None
    return members.join(hinted(large.select("cluster")), "cluster", "left_anti"), checkpointed(members.join(hinted(large), "cluster"))


def _by_rare_shingles(members: DataFrame) -> DataFrame:
    """Clusters anew: members that share one of their rarest shingles, counted over all of these members. Those that share none are left out."""
    node = F.xxhash64("point")
    each = members.select(node.alias("node"), "n", F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(counts, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    own = F.col("n") - F.size("shared")  # rarer than all of these
    length = F.greatest(F.col("n") - F.ceil(F.col("n") * UNION / SHARED) + 1 - own, F.lit(0))
    rare = shared.select("node", F.explode(F.slice("shared", F.lit(1), length.cast("int"))).alias("x"))
    anew = _clusters(checkpointed(rare.select(F.col("x.shingle").alias("shingle"), "node")), ["shingle"], "node")
    return checkpointed(members.drop("cluster").join(hinted(anew.withColumnRenamed("root", "cluster")), node == F.col("node")).drop("node"))


def links(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """a, b: whole groups as stars, of clusters that make one unit; and links that connect what links connect, of larger ones (None: there
    are none). Units that a hash puts together by chance cost time only."""
    ones, large = _of_large(members)
    stars = searched(_as_units(ones))
    if large is None:
        return stars, None
    ones, large = _of_large(_by_rare_shingles(large.select("cluster", "point", "n", "shingles")))
    stars = stars.unionByName(searched(_as_units(ones)))
    if large is None:
        return stars, None
    blocks = F.ceil(F.col("size") / BLOCK)
    large = large.withColumn("block", F.pmod(F.xxhash64("point"), blocks))
    each = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")
    unit = F.xxhash64("cluster", "block").alias("unit")
    first = large.where("point = first").select(each, "cluster", "point", "shingles")
    near = checkpointed(searched(_rows(large, unit, holds=True).unionByName(_rows(first, unit, holds=False))))
    rest = checkpointed(large.where("point <> first").join(near.select(F.col("b").alias("point")), "point", "left_anti"))
    asked = rest.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("turns"))
    unit = F.xxhash64("cluster", "block", "turn").alias("unit")
    held = large.join(hinted(asked), "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    asks = rest.drop("block").join(hinted(asked), "cluster").withColumn("turn", F.pmod(F.xxhash64("point", F.lit(1)), F.col("turns"))).withColumn("block", each)
    return stars, near.unionByName(searched(_rows(held, unit, holds=True).unionByName(_rows(asks, unit, holds=False))))


def _as_units(members: DataFrame) -> DataFrame:
    return members.select(F.col("cluster").alias("unit"), F.lit(True).alias("asks"), F.lit(True).alias("holds"), "point", "shingles")


def _rows(points: DataFrame, unit: Column, holds: bool) -> DataFrame:
    return points.select(unit, F.lit(not holds).alias("asks"), F.lit(holds).alias("holds"), "point", "shingles")


def searched(units: DataFrame) -> DataFrame:
    """a, b: where all points of a unit ask and hold, its groups as stars around their smallest points; else links from what asks to what is
    held that connect all points that links connect. Rows: unit, asks, holds, point, shingles."""
    schema = "a binary, b binary"
    out = arrow_schema(units.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        return to_batches((link for rows in _units(batches) for link in _found(Unit(rows))), out)

    return map_arrow(units.repartition("unit").sortWithinPartitions("unit"), run, schema)


def _found(unit: "Unit") -> Iterable[tuple[bytes, bytes]]:
    found = list(unit.links())
    if not unit.all_ask:
        return found
    lows: dict[bytes, bytes] = {}
    for point in unit.root:
        top = unit.find(point)
        lows[top] = min(point, lows.get(top, point))
    return [(low, point) for point in unit.root if (low := lows[unit.find(point)]) != point]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, last = [], None
    for batch in batches:
        units, asks, holds, own = (c.to_pylist() for c in batch.columns[:4])
        for i, unit in enumerate(units):
            if held and unit != last:
                yield held
                held = []
            last = unit
            held.append((asks[i], holds[i], own[i], batch.column(4)[i].values.to_numpy().view("u8").copy()))
    if held:
        yield held


class Unit:
    """An inverted index over some points, and searches in it. Rows: asks, holds, point, ascending hashes."""

    def __init__(self, rows: list[tuple]):
        self.asks = [(point, own) for asks, _, point, own in rows if asks]
        self.points = [point for _, holds, point, _ in rows if holds]
        held = [own for _, holds, _, own in rows if holds]
        self.sizes = np.array([len(x) for x in held], "i8")
        hashes = np.concatenate([np.zeros(0, "u8"), *held])
        order = np.argsort(hashes, kind="stable")
        self.places = np.repeat(np.arange(len(held)), self.sizes)[order]
        hashes = hashes[order]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, "i8")
        self.hashes, self.starts, self.ends = hashes[starts], starts, np.append(starts[1:], len(hashes))
        self.lookup = np.repeat(np.arange(len(starts)), self.ends - self.starts) * max(len(held), 1) + self.places  # ascending
        self.all_ask = len(self.asks) == len(rows)
        self.root = {point: point for _, _, point, _ in rows}
        self.group = dict.fromkeys(self.root, 1)

    def find(self, point: bytes) -> bytes:
        while (up := self.root[point]) != point:
            self.root[point] = point = self.root[up]
        return point

    def links(self) -> Iterator[tuple[bytes, bytes]]:
        largest, left = None, self.asks
        while left:
            put_off = []
            for point, own in left:
                if self.all_ask and largest is not None and self.find(point) == self.find(largest):
                    put_off.append((point, own))
                    continue
                for place in self.search(own):
                    other = self.points[place]
                    a, b = self.find(point), self.find(other)
                    if a != b:
                        self.root[a] = b
                        self.group[b] += self.group[a]
                        yield point, other
                if largest is None or self.group[self.find(point)] > self.group[self.find(largest)]:
                    largest = point
            left = [(point, own) for point, own in put_off if self.find(point) != self.find(largest)]  # another group has become the largest

    def search(self, own: np.ndarray) -> list[int]:
        """Places of all held points that link with a set."""
        n = len(own)
        least = -(-n * UNION // SHARED)
        at = np.searchsorted(self.hashes, own)
        at = at[self.hashes[np.minimum(at, len(self.hashes) - 1)] == own] if len(self.hashes) else at[:0]
        if len(at) < least:
            return []
        lengths = self.ends[at] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        aside = min(least - 1, int(least / (MU * math.log2(int(lengths[-1])) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merged = np.sort(np.concatenate([self.places[a:b] for a, b in zip(self.starts[short], self.ends[short], strict=True)]), kind="stable")
        places, counts = np.unique(merged, return_counts=True)
        sizes = self.sizes[places]
        kept = (counts >= least - aside) & (SHARED * sizes >= UNION * n) & (SHARED * n >= UNION * sizes)
        places, counts, sizes = places[kept], counts[kept], sizes[kept]
        step = max(1, PROBED // max(1, len(long)))
        for i in range(0, len(places) if len(long) else 0, step):
            sought = long[:, None] * len(self.points) + places[None, i : i + step]
            found = self.lookup[np.minimum(np.searchsorted(self.lookup, sought), len(self.lookup) - 1)] == sought
            counts[i : i + step] += found.sum(0)
        return places[SHARED * counts >= UNION * (n + sizes - counts)].tolist()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach; of an empty set its own)."""
    rows = checkpointed(points(df, id_col, text_col))
    clusters = checkpointed(_clusters(rows.select("node", F.explode("keys").alias("key")), ["key"], "node"))
    stars, more = links(_members(df, rows, clusters, id_col, text_col))
    linked = stars.select(F.col("b").alias("point"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("point"), F.col("a").alias("root"))).distinct()
    if more is not None:
        linked = linked.unionByName(connected_components(more).withColumnRenamed("node", "point"))
    linked = checkpointed(linked)
    own = checkpointed(rows.where("n > 0").groupBy("point").agg(F.min("doc_id").alias("own")))
    linked = checkpointed(own.join(linked, "point"))
    best = linked.groupBy("root").agg(F.min("own").alias("best"))
    best = linked.join(best, "root").select("point", "best")
    named = checkpointed(own.join(best, "point", "left").select("point", F.coalesce("best", "own").alias("component_id")))
    out = rows.where("n > 0").join(named, "point").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc, count(*) AS n FROM shingles GROUP BY doc
), shared AS (
  SELECT a.doc AS a, b.doc AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc < b.doc GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc = a JOIN sizes y ON y.doc = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc AS a, doc AS b FROM words UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc = w.doc JOIN reached r ON r.a = w.doc JOIN words o ON o.doc = r.b GROUP BY w.doc, w.doc_id, n
"""
