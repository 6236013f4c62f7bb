"""Ranked lexical search: impact-ordered postings, read score at a time.

Terms: maximal runs of ASCII letters, digits and characters outside ASCII, only A-Z lower-cased. N counts the documents with a
term, L all their terms, n one document's, df the documents that hold a term, tf its occurrences in one. A term weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))); all else is 64-bit integers, divisions rounding down: with m = 25 + 75 n N / L, an
occurrence's impact is w times (1000000000 tf / (1000 tf + 8 m)). A document's score for an item sums the impacts of the item's terms,
repeats included.

1. One pass over the texts counts N, L and df over all documents and writes the index: blocks of documents, each with its postings
   for the items' terms. No text and no posting is shuffled; a block is one row.
2. Where N, L and df are known, a task turns a block's postings into impacts and orders each term's list by them, largest first.
   For each item it takes the groups of equal impact in descending order over all lists and adds them up. The next impact of
   each list bounds what any document can still gain. Groups are taken until no document outside of the candidates (those whose sum
   and bound reach the k-th best) can be among the best `k`, and the candidates are few; their scores are then completed by binary
   search in the lists. A task carries each item's k-th best score from block to block, so later blocks end sooner. If the bounds
   never prove it, as with many equal copies, all groups are read: results are exact at any size.
3. Each task sends its `k` best for each item, in the final order; these are ranked together.

Items are taken to the workers in blocks of about `ITEM_TERMS` terms, hashed by row, with one index for each block of items. The driver
holds one such block and a number for each of its terms.

Null and empty texts have no terms: such documents aren't counted in N and such items find nothing. Equal scores are ranked by
ascending doc_id, null ids last. Repeated documents are ranked each; repeated items are searched each. Other columns are ignored.
Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, checkpointed, forget_kept, map_arrow, map_rows, to_batches, values

K = 10
#: Terms of the items that are searched at a time; documents and postings of a block.
ITEM_TERMS, BLOCK_DOCS, BLOCK_POSTINGS = 200_000, 8_192, 1_000_000
#: Candidates of a block and item that are completed one by one, and the step from one level of impacts to the next.
COMPLETED, STEP = 1_000, 0.7
#: UTF-8 bytes: those of terms in lower case, all others to a space.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = "docs array<long>, sizes array<long>, terms array<int>, places array<int>, tfs array<int>, held array<int>, dfs array<int>, n_docs long, n_terms long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM).split()


def search(df: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `k` best documents of each item, with a score above 0."""
    asked = map_rows(items.select(F.col(item_col), F.col(item_text_col).cast("string")), f"item_id {items.schema[item_col].dataType.simpleString()}, terms array<binary>, counts array<int>", lambda: _asked)
    asked = checkpointed(asked.select(F.monotonically_increasing_id().alias("item"), "*"))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 1) // ITEM_TERMS)
    texts = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    best = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms", "counts").collect()
        found = _searched(texts, [(x.item, x.terms, x.counts) for x in rows], k)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _asked(row: tuple) -> tuple:
    counts = Counter(terms(row[1]))
    return row[0], list(counts), list(counts.values())


def _searched(texts: DataFrame, items: list[tuple[int, list, list]], k: int) -> DataFrame:
    """item, doc_id, score: each task's `k` best documents of each item."""
    spark = texts.sparkSession
    number = {t: i for i, t in enumerate(dict.fromkeys(bytes(t) for _, ts, _ in items for t in ts))}
    indexed = checkpointed(index(texts, number))
    n, length = indexed.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = indexed.select(F.explode(F.arrays_zip("held", "dfs")).alias("x")).groupBy("x.held").agg(F.sum("x.dfs").alias("df"))
    weights = np.zeros(len(number), "i8")
    for x in held.toLocalIterator():
        weights[x.held] = math.floor(1000 * math.log((2 * n + 2) / (2 * x.df + 1)))
    wanted = spark.sparkContext.broadcast((weights, [(item, np.array([number[bytes(t)] for t in ts], "i8"), np.array(counts, "i8")) for item, ts, counts in items]))
    schema = "item long, doc_id long, score long"
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        weights, asked = wanted.value
        best: dict[int, list] = {}
        for docs, *block in _rows(batches):
            block = Block(docs.to_pylist(), *(x.to_numpy(zero_copy_only=False) for x in block), weights=weights, n=n, length=length)
            for item, numbers, counts in asked:
                kept = best.setdefault(item, [])
                found = block.best(numbers, counts, k, kept[-1][0] if len(kept) == k else 1)
                if found:
                    best[item] = heapq.nsmallest(k, [*kept, *found], key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        return to_batches(((item, doc_id, score) for item, kept in best.items() for score, doc_id in kept), out)

    return map_arrow(indexed.select("docs", "sizes", "terms", "places", "tfs"), run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].values for c in batch.columns]


def index(texts: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Blocks of documents (id, text): ids and numbers of terms of the documents that hold a wanted term; for each posting, by term, the
    term's number, the document's place in the block and tf; the terms held and in how many documents; and the counts of all documents."""
    out = arrow_schema(texts.sparkSession, _BLOCK)
    shared = texts.sparkSession.sparkContext.broadcast(number)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = shared.value
        docs, sizes, postings, counts = [], [], array("i"), [0, 0]
        for doc_id, text in values(batches):
            words = terms(text)
            if not words:
                continue
            counts[0] += 1
            counts[1] += len(words)
            before = len(postings)
            for term, tf in Counter(words).items():
                if (own := number.get(term)) is not None:
                    postings.extend((own, len(docs), tf))
            if len(postings) > before:
                docs.append(doc_id)
                sizes.append(len(words))
            if len(docs) >= BLOCK_DOCS or len(postings) >= 3 * BLOCK_POSTINGS:
                yield _block(docs, sizes, postings, counts)
                docs, sizes, postings, counts = [], [], array("i"), [0, 0]
        if counts[0]:
            yield _block(docs, sizes, postings, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for block in blocks(batches):
            yield from to_batches([block], out)

    return map_arrow(texts, run, _BLOCK)


def _block(docs: list, sizes: list, postings: array, counts: list) -> tuple:
    table = np.frombuffer(postings, "i4").reshape(-1, 3) if postings else np.zeros((0, 3), "i4")
    table = table[np.argsort(table[:, 0], kind="stable")]
    held, dfs = np.unique(table[:, 0], return_counts=True)
    return docs, sizes, table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), held, dfs.astype("i4"), *counts


class Block:
    """The postings of some documents, each term's list ordered by impact."""

    def __init__(self, docs: list, sizes: np.ndarray, numbers: np.ndarray, places: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n: int, length: int):
        self.docs = docs
        number, place, tf = (x.astype("i8") for x in (numbers, places, tfs))
        m = 25 + (75 * sizes.astype("i8") * n) // max(length, 1)
        impact = weights[number] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place])) if len(number) else tf
        self.lookup, self.found = number * len(docs) + place, impact  # ascending, for binary search
        order = np.lexsort((-impact, number))
        self.impact, self.falling, self.place = impact[order], -impact[order], place[order]
        self.starts = np.searchsorted(number, np.arange(len(weights) + 1))

    def best(self, numbers: np.ndarray, counts: np.ndarray, k: int, least: int) -> list[tuple[int, int | None]]:
        """(score, doc_id) of documents with a score of `least` or more, the `k` best of them and all that equal the last among these."""
        lists = [(self.impact[a:b], self.falling[a:b], self.place[a:b], c) for a, b, c in zip(self.starts[numbers], self.starts[numbers + 1], counts, strict=True) if a < b]
        nexts = [int(impact[0] * c) for impact, _, _, c in lists]
        at, sums = [0] * len(lists), np.zeros(len(self.docs), "i8")
        while (left := sum(nexts)) > 0:
            bound = max(least, int(np.partition(sums, -k)[-k]) if len(sums) >= k else 0)
            if left < bound:  # what has no sum yet can't reach the bound
                candidates = np.flatnonzero(sums + left >= bound)
                if len(candidates) <= COMPLETED:
                    return self._completed(candidates, numbers, counts, bound)
            level = max(nexts) * STEP
            for i, (impact, falling, place, c) in enumerate(lists):
                if nexts[i] and nexts[i] >= level:  # groups of equal impact down to the level
                    to = int(np.searchsorted(falling, -level / c, side="right"))
                    sums[place[at[i] : to]] += impact[at[i] : to] * c
                    at[i], nexts[i] = to, int(impact[to] * c) if to < len(impact) else 0
        bound = max(least, int(np.partition(sums, -k)[-k]) if len(sums) >= k else 0)
        return [(int(sums[p]), self.docs[p]) for p in np.flatnonzero(sums >= bound)]

    def _completed(self, candidates: np.ndarray, numbers: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, int | None]]:
        sought = numbers[:, None] * len(self.docs) + candidates[None, :]
        at = np.minimum(np.searchsorted(self.lookup, sought), len(self.lookup) - 1)
        scores = (np.where(self.lookup[at] == sought, self.found[at], 0) * counts[:, None]).sum(0)
        return [(int(s), self.docs[p]) for s, p in zip(scores, candidates, strict=True) if s >= least]


SQL = r"""
WITH said AS (
  SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)
), asked AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), lengths AS (SELECT doc, doc_id, count(*) AS n FROM said GROUP BY ALL
), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), tfs AS (SELECT doc, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total
), impacts AS (
  SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact
  FROM tfs JOIN lengths USING (doc) JOIN weights USING (term), total
), scores AS (
  SELECT item, item_id, doc, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""
