"""Benchmark decontamination with DataFrame functions only.

ASCII letters are lower-cased; words are runs of ASCII letters, digits and characters outside ASCII. A window is `WINDOW`
neighbouring words of a benchmark item; an item of fewer words (but not none) is one window. A document word inside any
occurrence of a window is hit.

The hash set: hashes of the first `LEAD` words and of all words of every benchmark window set bits of one bitmap, which reaches
all tasks as a scalar subquery; it has about `BITS` bits for each window, up to `MOST_LONGS` longs. Every window of every training text
is looked up in it, first by its lead, so that few windows are hashed whole. Only windows that the bitmap may hold become rows, of
a place and the window's own words; these are joined to the benchmark windows by hash and verified word by word. A fuller bitmap
lets more rows through to the join and changes no result. A text of n words costs n look-ups, however long it is.

The benchmark windows are broadcast where they are at most `BROADCAST_WINDOWS`, which is checked; more are joined by a shuffle on the
window hash. Each document is one stream of rows: one that carries its number of words, and one for each window that may be known.
A window without a hit ends in the join, so only hits are shuffled to their document. Items are looked up for the distinct windows
of a document, not for each hit.

Null text has no words. Documents with equal id and equal text are reported once for each row. A null id is an id like
any other. Items with equal text are separate items; a null item id is left out of items_sha256 but counts as an item.
Other columns are ignored. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import ascii_lower, checkpointed, hinted, unused

WINDOW, LEAD = 10, 3
#: Bits of the bitmap for each window, and the most longs that it has (1 MB, which is copied for each document).
BITS, MOST_LONGS = 64, 1 << 17
#: About 100 bytes each.
BROADCAST_WINDOWS = 500_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text whose letters keep their case.
CASED_WORD, CASED_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. Cut at the gaps, which is the same as finding the words; the ends may be empty."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), lambda w: w != "")


def _lead(at: Column, size: int) -> Column:
    """Hash of the first words of the window of `size` words of `w` at a place (from 1)."""
    return F.xxhash64(F.lit(1), *(F.get("w", at + (i - 1)) for i in range(min(size, LEAD))))


def _bit(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63)).cast("int")


def _slot(key: Column, longs: int) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(longs - 1)).cast("int")


def _bitmap(known: DataFrame, sizes: list[int], longs: int) -> DataFrame:
    """One row: an array of `longs` longs with a bit for the lead and one for the whole of each window."""
    windows = known.select("key", "size", F.col("words").alias("w"))
    keys = windows.select("key")
    for size in sizes:
        keys = keys.unionByName(windows.where(F.col("size") == size).select(_lead(F.lit(1), size).alias("key")))
    bits = keys.groupBy(_slot(F.col("key"), longs).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key")))).alias("bits"))
    every = known.sparkSession.range(longs).select(F.col("id").cast("int").alias("slot")).join(bits, "slot", "left")
    row = F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["bits"]).alias("bitmap"))


def _candidates(size: int, longs: int) -> Column:
    """Structs (at, words) of the windows of `size` words of `w` that `bitmap` may hold."""
    held = lambda key: F.getbit(F.get("bitmap", _slot(key, longs)), _bit(key)) == 1
    starts = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - (size - 1))).otherwise(F.array().cast("array<int>"))
    led = F.filter(starts, lambda i: held(_lead(i, size)))
    whole = F.filter(led, lambda i: held(F.xxhash64(F.slice("w", i, size))))
    return F.transform(whole, lambda i: F.struct(i.alias("at"), F.slice("w", i, size).alias("words")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, size, words, id, tie: the windows of each item, once each, with the item's id as a string, or the hash of its text where that is null."""
    tokens = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.xxhash64(F.col(text_col)).alias("tie"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    at = F.sequence(F.lit(1), F.size("w") - length + 1)
    cut = tokens.select("item_id", "tie", F.explode(F.transform(at, lambda i: F.slice("w", i, length))).alias("words"))
    item = F.coalesce("item_id", F.lit("")).alias("id"), F.when(F.col("item_id").isNull(), F.col("tie")).alias("tie")
    return cut.select(F.xxhash64("words").alias("key"), F.size("words").alias("size"), "words", *item).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (hash of the text), copies, n_words, hits (sorted distinct positions of hit words, from 1), items."""
    parts = checkpointed(benchmark_windows(benchmark, window))
    known = checkpointed(parts.select("key", "size", "words").distinct().withColumn("win", F.monotonically_increasing_id()))
    n_windows = known.count()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most `window` values
    longs = min(MOST_LONGS, 1 << max(6, (n_windows * BITS // 64).bit_length()))
    bitmap = checkpointed(_bitmap(known, sizes, longs)).scalar()
    tokens = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), words(F.col(text_col)).alias("w"), bitmap.alias("bitmap"))
    head = F.array(F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("words")))
    rows = tokens.select("doc_id", "tie", F.size("w").alias("n"), F.explode(F.concat(head, *(_candidates(s, longs) for s in sizes))).alias("x"))
    # a head meets no window; its key only spreads heads over the tasks of a shuffle
    key = F.when(F.col("x.at") > 0, F.xxhash64("x.words")).otherwise(F.xxhash64("doc_id", "tie"))
    rows = rows.select("doc_id", "tie", "n", F.col("x.at").alias("at"), F.col("x.words").alias("words"), F.size("x.words").alias("size"), key.alias("key"))
    right = known.select(F.col("key").alias("k_key"), F.col("size").alias("k_size"), F.col("words").alias("k_words"), "win")
    met = rows.join(hinted(right, n_windows, BROADCAST_WINDOWS), (rows["key"] == right.k_key) & (rows["size"] == right.k_size) & (rows["words"] == right.k_words), "left")
    met = met.where((F.col("at") == 0) | F.col("win").isNotNull())
    span = F.when(F.col("at") > 0, F.struct("at", F.col("size").alias("size")))
    gathered = met.select("doc_id", "tie", "n", "at", span.alias("span"), "win").groupBy("doc_id", "tie").agg(
        F.count_if(F.col("at") == 0).alias("copies"), F.max("n").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("win").alias("wins")
    )
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    gathered = checkpointed(gathered.select("doc_id", "tie", "copies", "n_words", F.array_sort(F.array_distinct(places)).alias("hits"), "wins"))
    owners = known.join(parts, ["key", "size", "words"]).select("win", F.struct("id", F.col("tie")).alias("item"))
    own = gathered.select(F.col("doc_id").alias("i_id"), F.col("tie").alias("i_tie"), F.explode("wins").alias("win")).join(hinted(owners, most=BROADCAST_WINDOWS), "win")
    own = own.groupBy("i_id", "i_tie").agg(F.collect_set("item").alias("items"))
    hit = gathered.where(F.size("wins") > 0).join(own, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("tie") == F.col("i_tie")))
    columns = ["doc_id", "tie", "copies", "n_words", "hits", "items"]
    clean = gathered.where(F.size("wins") == 0).withColumn("items", F.array().cast(own.schema["items"].dataType))
    return clean.select(*columns).unionByName(hit.select(*columns))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, window, id_col, text_col)
    ids = F.array_join(F.array_sort(F.transform(F.filter("items", lambda i: i["tie"].isNull()), lambda i: i["id"])), ",")
    report = found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "copies")
    return report.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that no benchmark window occurs in."""
    found = find_contamination(docs, benchmark, window, id_col, text_col).where(F.size("hits") > 0)
    own, tie = unused(docs, "gone_id", "gone_tie")
    gone = checkpointed(found.select(F.col("doc_id").alias(own), F.col("tie").alias(tie)))
    return docs.join(hinted(gone), F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(tie)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with hit words (and the characters up to the next word) cut out of the text."""
    found = find_contamination(docs, benchmark, window, id_col, text_col).where(F.size("hits") > 0)
    own, tie, hits, parts = unused(docs, "gone_id", "gone_tie", "hits", "pieces")
    gone = found.select(F.col("doc_id").alias(own), F.col("tie").alias(tie), F.col("hits").alias(hits))
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(tie)), "left")
    lead, pieces = F.regexp_extract(text_col, f"^{CASED_GAP}", 0), F.regexp_extract_all(F.col(text_col), F.lit(f"{CASED_WORD}({CASED_GAP})?"), F.lit(0))
    every = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, F.col(hits)), lambda i: F.get(parts, i - 1))
    text = F.when(F.col(hits).isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col(text_col))
    return joined.withColumn(parts, pieces).withColumn(text_col, text).select(*docs.columns)


#: DuckDB SQL for contamination_report.
SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p0, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT doc_id, p0, dw.size AS size, item_id FROM dw JOIN bw USING (size, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
