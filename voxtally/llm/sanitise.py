"""Personal data and the terms that give it away, with DataFrame functions only.

Base spans are found by pattern: email, ip, card and phone, leftmost and not overlapping within a kind; matches that fail
their test are dropped and not retried. Each base value is a protected entity.

Information-theoretic part. Protected entities are the base values, and the classes that they belong to: an address' domain, the first three
parts of an ip, a card's first six digits and a phone's first five. For an entity e and a term t (a word of three letters or more
outside of base spans), counted in distinct texts over the whole corpus: n(t, e) texts with both, wherever they stand, n(t) texts with
t, n(e) texts with e, N texts. The information that t gives about e is PMI = log2(n(t, e) N / (n(t) n(e))), and what there is to
disclose is IC(e) = log2(N / n(e)). Wherever it stands in a text with e, a term is a span of kind term if PMI >= `GENERALISE` IC(e), and of
kind secret if PMI >= `REMOVE` IC(e), on evidence: at least `SUPPORT` distinct texts have both, and so many are not chance. The tail bound
exp(-n D(k/n || q)) of the hypergeometric law, with n = n(e), q = n(t)/N or with t and e exchanged, the smaller of the two, times the
number of tests (every term of every text with every entity of enough texts) has to be at most `CHANCE`. So a word isn't marked because
it is rare, at any size of the corpus: what stands in one text alone tells nothing about it but through its class. Sanitising puts [KIND] for
base spans, [TERM] for terms and nothing for secrets. Copies of a text are no further evidence.

Places are found by running sums of lengths and texts are cut once, in time linear in the text. Null text counts as empty. Rows with equal id and text are treated alike, each stays. A null id is an id like any other. Other columns are
ignored (sanitise_text keeps them). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm import common
from voxtally.llm.common import checkpointed, hinted, unused

#: Base kinds in the order of the output, with their patterns. Look-behinds only save scanning: a run of the first
#: class always matches from its beginning, or from the end of the match before (\G). Possessive repeats never give back what no later part could use, and need
#: no stack however long a run is. A card needs 14 digits in a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"

GENERALISE, REMOVE, SUPPORT, CHANCE = 0.5, 0.9, 3, 0.01
#: Values that a running sum goes through at a time.
CHUNK = 128
#: Terms with their counts up to this number are broadcast.
BROADCAST_TERMS = 200_000

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(p, -4, 4).cast("int") <= 255))
    if kind == "card":
        return lambda v: F.length(_digits(v)).between(14, 19) & _luhn(v)
    if kind == "phone":
        return lambda v: F.length(_digits(v)).between(10, 15)
    return lambda v: F.lit(True)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Sums or maxima of an int array's values up to each. A fold copies what it has at each step, so it goes through `CHUNK` values at
    a time, and through the chunks' totals."""
    chunks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(1), F.size(values), F.lit(CHUNK)), lambda i: F.slice(values, i, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<int>>"))
    add = lambda got, x: F.concat(got, F.array(op(F.element_at(got, -1), x)))
    before = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op)), F.array(F.lit(0)), add)
    return F.flatten(F.transform(F.filter(F.arrays_zip(chunks.alias("c"), before.alias("b")), lambda x: x["c"].isNotNull()), lambda x: F.slice(F.aggregate(x["c"], F.array(x["b"]), add), 2, CHUNK)))


def _sums(values: Column) -> Column:
    return _running(values, lambda a, x: a + x)


def _before(ends: Column) -> Column:
    """For each of some spans in order of start how far those before it reach, and at last how far all do."""
    return F.concat(F.array(F.lit(0)), _running(ends, lambda a, x: F.greatest(a, x)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (hash of the text), text, base: structs (start, rank, kind, end, value) in order of start, then kind; bytes: structs
    (start, rank, from, end, to) of the same spans with their places in the UTF-8 text.

    What stands between matches comes from splitting by the same pattern, so places are running sums of lengths."""
    rows = _rows(docs, id_col, text_col)
    rows = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()))
    none, every, places = F.array().cast("array<int>"), [], []
    for kind, pattern in PATTERNS.items():
        parts = F.arrays_zip(F.col(f"m_{kind}").alias("v"), F.split("text", pattern, -1).alias("gap"))
        for name, size in (("e", F.length), ("b", F.octet_length)):
            sizes = F.transform(parts, lambda x: size(x["gap"]) + F.coalesce(size(x["v"]), F.lit(0)))
            every.append(F.when(F.size(f"m_{kind}") > 0, sizes).otherwise(none).alias(f"{name}_{kind}"))
    rows = rows.select("*", *every)
    rows = rows.select("doc_id", "tie", "text", *(f"m_{k}" for k in PATTERNS), *(_sums(F.col(f"{n}_{k}")).alias(f"{n}_{k}") for k in PATTERNS for n in "eb"))
    for rank, kind in enumerate(PATTERNS):
        found = F.filter(F.arrays_zip(F.col(f"m_{kind}").alias("v"), F.col(f"e_{kind}").alias("e"), F.col(f"b_{kind}").alias("b")), lambda x: x["v"].isNotNull() & _passes(kind)(x["v"]))
        places.append(F.transform(found, lambda x: F.struct((x["e"] - F.length(x["v"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("value"), (x["b"] - F.octet_length(x["v"])).alias("from"), x["b"].alias("to"))))
    rows = rows.select("doc_id", "tie", "text", F.array_sort(F.concat(*places)).alias("all"))
    base = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    place = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["from"].alias("from"), s["end"].alias("end"), s["to"].alias("to")))
    return rows.select("doc_id", "tie", "text", base.alias("base"), place.alias("bytes"))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _class(kind: Column, value: Column) -> Column:
    """What a value shares with others of its kind."""
    shared = F.when(kind == "email", F.lower(F.substring_index(value, "@", -1))).when(kind == "ip", F.substring_index(value, ".", 3))
    return F.concat(kind, F.lit("-class:"), shared.when(kind == "card", F.left(_digits(value), F.lit(6))).otherwise(F.left(_digits(value), F.lit(5))))


def _blanked(based: DataFrame) -> DataFrame:
    """The rows of base_spans with `rest`: the text with spaces for its base spans, so that places stay; null without any."""
    some = based.select("*", F.col("text").cast("binary").alias("raw"), F.transform("bytes", lambda s: s["to"]).alias("to"), F.transform("bytes", lambda s: s["end"]).alias("end"))
    some = some.select("*", _before(F.col("to")).alias("at"), _before(F.col("end")).alias("cut"))
    piece = lambda low, high: F.decode(F.substring("raw", low + 1, F.greatest(high - low, F.lit(0))), "UTF-8")
    each = F.filter(F.arrays_zip(F.col("bytes").alias("s"), F.col("at").alias("at"), F.col("cut").alias("cut")), lambda x: x["s"].isNotNull())
    pieces = F.transform(each, lambda x: F.concat(piece(x["at"], x["s"]["from"]), F.repeat(F.lit(" "), F.greatest(x["s"]["end"] - F.greatest(x["s"]["start"], x["cut"]), F.lit(0)))))
    rest = F.concat(F.array_join(pieces, ""), piece(F.element_at("at", -1), F.octet_length("raw")))
    return some.select("doc_id", "tie", "base", F.when(F.size("base") > 0, rest).alias("rest"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _protected(found: DataFrame) -> DataFrame:
    """tie, entities, terms: a row for each distinct text with base spans; terms stand outside of these."""
    entities = F.array_distinct(F.concat(F.transform("base", lambda s: _entity(s["kind"], s["value"])), F.transform("base", lambda s: _class(s["kind"], s["value"]))))
    return found.where(F.size("base") > 0).select("tie", entities.alias("entities"), _terms(F.col("rest")).alias("terms")).dropDuplicates(["tie"])


def _log_chance(k: Column, n: Column, q: Column) -> Column:
    """Logarithm of the bound of the chance that at least k of n texts have what a share q of all texts has, for k/n above q."""
    p = k / n
    rest = F.when(p < 1, (1 - p) * F.log(F.try_divide(1 - p, 1 - q))).otherwise(0.0)
    return -n * (p * F.log(p / q) + rest)


def _scored(pairs: DataFrame, counts: DataFrame, total: int, tests: int) -> DataFrame:
    """The rows of `pairs` (term, n_te, n_e) that reach the lower threshold and aren't chance in so many tests, with n_t, pmi and share (of the
    entity's information)."""
    scored = pairs.join(counts, "term", "left").withColumn("n_t", F.greatest(F.col("n_t"), F.col("n_te")))
    n = F.lit(float(max(1, total)))
    pmi, whole = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))), F.log2(n / F.col("n_e"))
    scored = scored.withColumn("pmi", pmi).withColumn("share", F.when(whole > 0, F.col("pmi") / whole).otherwise(0.0)).where(F.col("share") >= GENERALISE)
    chance = F.least(_log_chance(F.col("n_te"), F.col("n_e"), F.col("n_t") / n), _log_chance(F.col("n_te"), F.col("n_t"), F.col("n_e") / n))
    return scored.where((F.col("pmi") > 0) & (chance + math.log(max(1, tests)) <= math.log(CHANCE) + 1e-9))


def revealing_terms(docs: DataFrame, protected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """tie, term, share: the terms of each text of `protected` that reveal an entity of it, with the highest share.

    Only entities and pairs with enough texts go on, and only terms of such pairs are counted over the corpus."""
    rows = _rows(docs, id_col, text_col)
    each = protected.select("tie", F.explode("entities").alias("entity"))
    shared = hinted(checkpointed(each.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT)))
    met = protected.select("tie", "terms", F.explode("entities").alias("entity")).join(shared, "entity")
    tests = met.agg(F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()[0]
    met = met.select("tie", "entity", "n_e", F.explode("terms").alias("term"))
    pairs = checkpointed(met.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e")).where(F.col("n_te") >= SUPPORT))
    total = rows.agg(F.count_distinct("tie").alias("n")).first()["n"]
    counts = hinted(checkpointed(_text_counts(rows, pairs.select("term").distinct())), most=BROADCAST_TERMS)
    reveal = hinted(checkpointed(_scored(pairs, counts, total, tests).select("entity", "term", "share")))
    return met.join(reveal, ["entity", "term"]).groupBy("tie", "term").agg(F.max("share").alias("share"))


def _text_counts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, n_t: in how many distinct texts each wanted term stands. Copies of a text are weighed, k copies at 1/k each, so that
    counts are summed before they are shuffled."""
    copies = checkpointed(rows.groupBy("tie").agg(F.count("*").alias("k")).where("k > 1"))
    weighed = rows.join(hinted(copies), "tie", "left").select(F.explode(_terms(F.col("text"))).alias("term"), (1 / F.coalesce("k", F.lit(1))).alias("weight"))
    weighed = weighed.join(hinted(checkpointed(wanted), most=BROADCAST_TERMS), "term", "left_semi")
    return weighed.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n_t"))


def _places(texts: DataFrame) -> DataFrame:
    """tie, start, term of every term of `rest`, wherever it stands. Words are runs of letters, so the places where a letter follows none
    give their starts, in time linear in the text."""
    rows = texts.select("tie", F.regexp_extract_all("rest", F.lit(r"\p{L}+"), F.lit(0)).alias("v"), F.split(F.regexp_replace("rest", r"\p{L}", "a"), "").alias("c"))
    letter = lambda i: F.coalesce(F.get("c", i) == "a", F.lit(False))
    every = F.when(F.size("c") > 0, F.sequence(F.lit(0), F.size("c") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("tie", F.arrays_zip(F.filter(every, lambda i: letter(i) & ~letter(i - 1)).alias("start"), F.col("v").alias("v")).alias("x"))
    rows = rows.select("tie", F.explode(F.filter("x", lambda x: F.length(x["v"]) >= 3)).alias("x"))
    return rows.select("tie", F.col("x.start").alias("start"), F.lower("x.v").alias("term"), F.length("x.v").alias("size"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie, spans: for each row, all spans as structs (start, rank, kind, end, value) in order."""
    found = checkpointed(_blanked(base_spans(docs, id_col, text_col)))
    reveal = checkpointed(revealing_terms(docs, checkpointed(_protected(found)), id_col, text_col))
    marked = found.where(F.size("base") > 0).join(hinted(reveal.select("tie").distinct()), "tie", "left_semi").select("tie", "rest").dropDuplicates(["tie"])
    placed = _places(marked).join(reveal, ["tie", "term"])
    secret = F.col("share") >= REMOVE
    span = F.struct("start", (secret.cast("int") + len(PATTERNS)).alias("rank"), F.when(secret, "secret").otherwise("term").alias("kind"), (F.col("start") + F.col("size")).alias("end"), F.col("term").alias("value"))
    marks = checkpointed(placed.groupBy("tie").agg(F.collect_list(span).alias("marks")))
    joined = found.where(F.size("base") > 0).join(marks, "tie", "left")
    joined = joined.select("doc_id", "tie", F.when(F.col("marks").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "marks"))).alias("spans"))
    return found.where(F.size("base") == 0).select("doc_id", "tie", F.col("base").alias("spans")).unionByName(joined)


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(docs, id_col, text_col)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(PATTERNS))
    counts = [_count(F.col("spans"), k).alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sanitise_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with every span replaced. Where spans overlap, the first covers the place."""
    own, tie, spans_col = unused(docs, "span_id", "span_tie", "spans")
    found = find_spans(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias(own), F.col("tie").alias(tie), F.col("spans").alias(spans_col)).distinct()
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(tie)), "left")
    own_chars, own_ends, own_before = unused(joined, "chars", "ends", "before")
    joined = joined.withColumns({own_chars: F.when(F.col(spans_col).isNotNull(), F.split(F.col(text_col).cast("string"), "")), own_ends: F.transform(spans_col, lambda s: s["end"])})
    joined = joined.withColumn(own_before, _before(F.col(own_ends)))
    piece = lambda low, high: F.array_join(F.slice(own_chars, low + 1, F.greatest(high - low, F.lit(0))), "")
    each = F.filter(F.arrays_zip(F.col(spans_col).alias("s"), F.col(own_before).alias("at")), lambda x: x["s"].isNotNull())
    mark = lambda s: F.when(s["kind"] == "secret", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    pieces = F.transform(each, lambda x: F.when(x["s"]["start"] >= x["at"], F.concat(piece(x["at"], x["s"]["start"]), mark(x["s"]))).otherwise(""))
    done = F.concat(F.array_join(pieces, ""), piece(F.element_at(own_before, -1), F.size(own_chars)))
    return joined.withColumn(text_col, F.when(F.col(spans_col).isNotNull(), done).otherwise(F.col(text_col))).select(*docs.columns)
