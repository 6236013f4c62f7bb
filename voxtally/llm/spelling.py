"""Spelling variants of the corpus' own words, grouped by a symmetric-delete join.

Words: maximal runs of ASCII letters and of the letters U+00C0 to U+00FF, only A-Z lower-cased. Where `SLIP` divides a run's
checksum (crc32 of `<doc_id>:<run>` as UTF-8), the code point at the checksum modulo the run's length is deleted. What comes out
counts if it has at least `LETTERS` code points and comes at least `TIMES` times in the corpus.

Every word emits a key for itself and for each of its distinct single deletions; words that share a key meet in an equi-join and
are verified to differ by exactly one inserted, deleted or replaced code point. Words at that distance share exactly one key: the
shorter word itself, or what is left without the replaced code point. A key is a 61-bit hash, rolled over the word, so that a word
of n letters emits n + 1 rows of three numbers, however long it is; what meets by chance falls to the verification, which compares the words
themselves around the deleted places. At most
(n + 1) x 89 + 1 words of this alphabet can share a key of n letters, so no key is hot, however frequent its words are: all work
after the count is on distinct words.

A word's form is its most frequent near word (ties: the smallest in code-point order), if that comes at least `RATIO` times as
often as the word. Its root is where the chain of forms ends; chains are at most log2 of the largest count long, and each round of
joins doubles the reach.

Counting is one pass: a task sums its own words and sends them on whenever it holds `HELD` of them, so no text is shuffled.
Null and empty texts have no words. A null id is the empty text in the checksum. Repeated rows count each. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, checkpointed, forget_kept, map_arrow, to_batches, values

SLIP, LETTERS, TIMES, RATIO = 97, 5, 3, 2
#: Distinct words, and characters in them, that a task holds before it sends its counts on.
HELD, HELD_CHARS = 300_000, 16 << 20
#: Latin-1 bytes: letters of words in lower case, all others to a space. Characters outside Latin-1 are encoded as question marks.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: The rolling hash's modulus and base.
_MOD, _BASE = (1 << 61) - 1, 0x1F3A5B7C9D2E4F6
_INVERSE = pow(_BASE, -1, _MOD)


def runs(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The distinct words of one text after the checksum's deletions, with how often they come; a word may come more than once."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter((text or "").encode("latin-1", "replace").translate(_LETTER).split()).items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), start)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the corpus' words of enough letters that come often enough."""
    rows = df.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    schema = "word string, n long"
    out = arrow_schema(df.sparkSession, schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        held: Counter[str] = Counter()
        chars = 0
        for doc_id, text in values(batches):
            for word, n in runs(doc_id, text):
                if len(word) >= LETTERS:
                    if word not in held:
                        chars += len(word)
                    held[word] += n
            if len(held) >= HELD or chars >= HELD_CHARS:
                yield from held.items()
                held.clear()
                chars = 0
        yield from held.items()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        return to_batches(counted(batches), out)

    return map_arrow(rows, run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def deletion_keys(word: str) -> Iterator[tuple[int, int]]:
    """Hashes of the word (place -1) and of its distinct single deletions (the first place that gives it)."""
    after, power = [0], 1  # of what follows each place
    for c in reversed(word):
        after.append((ord(c) * power + after[-1]) % _MOD)
        power = power * _BASE % _MOD
    yield after[-1], -1
    before, last = 0, ""  # of what precedes, shifted by one place less than in the word
    power = power * _INVERSE % _MOD
    for i, c in enumerate(word):
        power = power * _INVERSE % _MOD
        if c != last:
            yield (before + after[len(word) - i - 1]) % _MOD, i
        before, last = (before + ord(c) * power) % _MOD, c


#: What meets under a key differs by one code point: one word is what the other's deletion leaves, or both agree but for one place,
#: which is the later one of their deletions' (the first places in runs of one letter, of which at most one precedes it).
_VERIFIED = """CASE WHEN at_a < 0 THEN word_a = left(word_b, at_b) || substring(word_b, at_b + 2) WHEN at_b < 0 THEN word_b = left(word_a, at_a) || substring(word_a, at_a + 2)
  ELSE left(word_a, greatest(at_a, at_b)) = left(word_b, greatest(at_a, at_b)) AND substring(word_a, greatest(at_a, at_b) + 2) = substring(word_b, greatest(at_a, at_b) + 2) END"""


def near_words(named: DataFrame) -> DataFrame:
    """a, b (ids; both directions): words of `named` (id, word, n) that differ by one code point."""
    schema = "key long, id long, at int"
    out = arrow_schema(named.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return to_batches(((key, own, at) for own, word in values(batches) for key, at in deletion_keys(word)), out)

    keys = map_arrow(named.select("id", "word"), run, schema)
    meet = keys.groupBy("key").agg(F.collect_list(F.struct("id", "at")).alias("met")).where(F.size("met") > 1).select(F.array_sort("met").alias("met"))
    meet = meet.select("met", F.posexplode("met").alias("place", "a")).select("a", F.explode(F.slice("met", F.col("place") + 2, F.size("met"))).alias("b"))
    meet = meet.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.at").alias("at_a"), F.col("b.at").alias("at_b"))
    of = lambda side: named.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"))
    near = checkpointed(meet.join(of("a"), "a").join(of("b"), "b").where(_VERIFIED).select("a", "b"))
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form (null: none), root, n, n_near (near words), form_n (null: none), for every word of the corpus."""
    named = checkpointed(words(df, id_col, text_col).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = near_words(named).join(named.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    best = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("id", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= RATIO * F.col("n")
    formed = named.join(best, "id", "left").select(
        "word", F.when(enough, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("near_n")).alias("form_n")
    )
    formed = checkpointed(formed)
    return formed.join(roots(formed.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms (word, form; without circles) ends. Each round doubles how far a word sees."""
    seen = checkpointed(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not seen.where("moved").isEmpty():
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        seen = checkpointed(seen.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return seen.select("word", "root")


#: Near words by place and rest instead of hashes; checksums from the polynomial, byte by byte.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END, c::BIGINT)) AS crc
), found AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL
), summed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_transform(range(length(hex(u)) // 2), lambda i: ('0x' || substr(hex(u), 2 * i + 1, 2))::BIGINT),
    lambda x, b: xor(x // 256, crc[xor(x % 256, b) + 1]), 4294967295::BIGINT)) AS h
  FROM (SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS u, crc FROM found, steps)
), words AS (
  SELECT w AS word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w FROM summed)
  WHERE length(w) >= 5 GROUP BY ALL HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, coalesce(form, word) AS at, form IS NULL AS ended FROM formed
  UNION ALL SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chain c JOIN formed f ON f.word = c.at WHERE NOT c.ended
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.ended
"""
