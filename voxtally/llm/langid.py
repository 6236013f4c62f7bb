"""Language by rank-order profiles and the out-of-place distance.

N-grams of one to three characters are taken from lower-cased letters; anything else is a word border, which an n-gram may
have at its ends only. A profile is the list of the `PROFILE` most frequent n-grams in order, ties by the characters. A
document's distance to a language is the sum over its profile of how far each n-gram is out of place, `PROFILE` where the
language's profile lacks it. The least distance wins, ties by the language's name; score is 1 less the distance's share of
the greatest possible.

Profiles are learned from rows that aren't held out, about `SAMPLE` of each language chosen by hash, all where there are fewer.

Null texts and texts without a letter are `und` with score 0, as is everything if there is nothing to learn from. Rows
without a language teach nothing. Repeated rows are treated alike. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, held_out, map_arrow, map_rows, to_batches, values

PROFILE, SAMPLE = 400, 4000
UNKNOWN = "und"
#: Bits of a code point, and what stands for a word border (no letter).
BITS, BORDER = 21, 1


@functools.cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as numbers (code points side by side) and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype("i8")
    if not len(points):
        return points, points
    letters = _letters()[points]
    points = np.concatenate([[BORDER], np.where(letters, points, BORDER), [BORDER]])
    points = points[np.concatenate([[True], (points[1:] != BORDER) | (points[:-1] != BORDER)])]  # runs of borders become one
    if len(points) < 3:
        return points[:0], points[:0]
    a, b, c = points[:-2], points[1:-1], points[2:]
    pairs = (points[:-1] << BITS) | points[1:]
    triples = ((a << 2 * BITS) | (b << BITS) | c)[b != BORDER]
    return np.unique(np.concatenate([points[points != BORDER], pairs, triples]), return_counts=True)


def profile(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order."""
    if len(counts) > 4 * size:
        keep = counts >= np.partition(counts, -size)[-size]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        self.tables = []
        for name in self.names:
            grams = np.array(ranked[name], "i8")
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def distances(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.names), "i8")
        for k, (grams, ranks) in enumerate(self.tables):
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            out[k] = np.where(grams[at] == own, np.abs(ranks[at] - np.arange(len(own))), PROFILE).sum()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(*ngrams(text or ""))
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        far = self.distances(own)
        best = int(far.argmin())
        return self.names[best], 1 - float(far[best]) / (PROFILE * len(own))


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, list[int]]:
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    part = F.pmod(F.xxhash64(F.lit(29), F.col("id")), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("n")
    chosen = rows.join(F.broadcast(sizes), "lang").where(part).select("lang", "text")
    schema = "lang string, gram long, n long"
    out = arrow_schema(docs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = defaultdict(list)

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([c for _, c in parts])).astype("i8")

        for lang, text in values(batches):
            found[lang].append(ngrams(text))
            if len(found[lang]) >= 256:
                found[lang] = [merged(found[lang])]
        yield from to_batches(((lang, int(g), int(n)) for lang, parts in found.items() for g, n in zip(*merged(parts), strict=True)), out)

    totals = map_arrow(chosen, count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = defaultdict(list)
    for r in ranked.orderBy("lang", "rank").collect():  # PROFILE rows for each language
        profiles[r["lang"]].append(r["gram"])
    return dict(profiles)


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: every whole text."""

    def make():
        known = Profiles(profiles)
        return lambda row: (row[0], row[1], *known.predict(row[2]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)
