"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and the context of each hit.

Learning: from a sample of labelled rows that aren't held out, at most `SAMPLE` of each class (all rows below that bound),
chosen by hash; of near copies among them one counts. Counted in documents, each word's likelihood ratio is its smoothed rate
in toxic rows over that in others, less `SURE` standard errors of its logarithm.
Words with a ratio of at least `TOXIC` and `SUPPORT` toxic rows are the lexicon, with the stems (beginnings of five to 64 letters,
when more follows) that words of such a ratio share. Other words that were seen at least `SUPPORT` times weigh nothing if even their ratio
with as many standard errors more is below `TOXIC`. Where the sample leaves that open, as it does with few sightings, a word weighs
what an unseen one would, and no more than its own sightings say, starting from a ratio of `MISSPELLED` too.

Matching: the trie of the lexicon's words is intersected with the Levenshtein automaton of a word: states are trie nodes with the
edits so far (insert, delete, substitute, or swap neighbours; one edit, words of four letters or more), determinised as they
are reached and kept, so that reading a word costs a look-up for each letter. A word that was not seen in learning and is
one edit from lexicon words weighs what such words weighed in the sample, starting from a ratio of `MISSPELLED`, and no
more than they.

Scoring: each distinct toxic word counts its log ratio times the highest context factor of its occurrences: `QUOTED` within
quotation marks or near a word of reporting, `AIMED` near an address, else 1. A logistic curve over their sum, fitted on the
same sample, gives the score.

Null or empty texts have no words and get the score of texts without a hit. Labels that are null are left out; of several
labels of a document the higher counts. Repeated rows are scored alike. Other columns are ignored. With no labels the
lexicon is empty. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import arrow_schema, bounded_sample, checkpointed, held_out, kept_in_worker, map_arrow, map_rows, to_batches, values

#: Labelled rows of each class that a lexicon is learned from. Nothing else bounds its words and stems: they come from these rows.
SAMPLE = 10_000
SUPPORT, TOXIC, SURE, MISSPELLED, STEM = 3, 6.0, 1.5, 60.0, 5
#: Letters of the longest stem; words of more letters have the stems of their first ones.
LONGEST = 64
THRESHOLD = 0.3
WINDOW, QUOTED, AIMED = 5, 0.35, 1.2
#: Words whose weight a worker remembers, and states of its automata; beyond that states are made anew.
REMEMBERED, STATES = 200_000, 30_000

#: Words that report speech, and words of address (fixed values).
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quotes reported reports word words term slur sagte schrieb nannte zitat dit écrit appelle mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein ihr tu te toi vous ton ta tú ti eres usted".split())

_WORD = re.compile(r"[^\W_]+(?:[*@$'’][^\W_]+)*")
_RUN = re.compile(r"(.)\1{2,}")


def normal(word: str) -> str:
    """A stretched letter (three or more) counts as one."""
    return _RUN.sub(r"\1", word)


def words(text: str | None) -> list[str]:
    return [normal(w) for w in _WORD.findall((text or "").lower())]


class FuzzyTrie:
    """The lexicon's words as a trie, read by automata that allow one edit."""

    def __init__(self, terms: list[str], shortest: int = 4):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = term
        self.shortest = shortest
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepted: list[tuple[tuple[str, int], ...]] = []
        self.start = self._number({(0, 0, "")})

    def _number(self, items: set[tuple[int, int, str]]) -> int:
        """The state of (node, edits, letter still owed by a swap), closed under leaving out a letter of the term."""
        closed = items | {(child, 1, "") for node, edits, owed in items if edits == 0 and not owed for child in self.children[node].values()}
        key = frozenset(closed)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            best: dict[str, int] = {}
            for node, edits, owed in key:
                if not owed and node in self.ends:
                    best[self.ends[node]] = min(edits, best.get(self.ends[node], 9))
            self.accepted.append(tuple(sorted(best.items())))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, owed in self.states[state]:
            if owed:
                if c == owed:
                    out.add((node, edits, ""))
                continue
            below = self.children[node]
            if c in below:
                out.add((below[c], edits, ""))
            if edits == 0:
                out.add((node, 1, ""))
                for letter, child in below.items():
                    if letter != c:
                        out.add((child, 1, ""))
                        if c in self.children[child]:
                            out.add((self.children[child][c], 1, letter))
        return self._number(out) if out else -1

    def near(self, word: str) -> tuple[tuple[str, int], ...]:
        """Lexicon words within one edit, with their distance."""
        if len(word) < self.shortest - 1:
            return ()
        if len(self.states) > STATES:
            self._forget()
        state = self.start
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._move(state, c)
            if nxt < 0:
                return ()
            state = nxt
        return self.accepted[state]


@dataclass
class Lexicon:
    #: Log ratios of words that were seen often enough and matter: lexicon words and seen words near them.
    weights: dict[str, float] = field(default_factory=dict)
    terms: list[str] = field(default_factory=list)
    stems: dict[str, float] = field(default_factory=dict)
    #: By lexicon word: log ratio of unseen words one edit from it.
    misspelled: dict[str, float] = field(default_factory=dict)
    #: By seen word near the lexicon that is neither surely toxic nor surely clean: the most it may weigh.
    limits: dict[str, float] = field(default_factory=dict)
    #: Log-odds of a document are bias + slope * (sum of its weights).
    bias: float = math.log(0.05 / 0.95)
    slope: float = 1.0


class Scorer:
    """Scores texts by a lexicon, with its automata and the words it has met; a worker keeps one."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie = lexicon, FuzzyTrie(lexicon.terms)
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Log ratio of a word; 0 for all that say nothing."""
        got = self._known.get(word)
        if got is None:
            got = self._weigh(word)
            if len(self._known) < REMEMBERED:
                self._known[word] = got
        return got

    def _weigh(self, word: str) -> float:
        known = self.lexicon
        if word in known.weights:
            return known.weights[word]
        found = [known.stems[word[:n]] for n in range(STEM, min(len(word), LONGEST + 1)) if word[:n] in known.stems]
        # the longest stem
        weight = found[-1] if found else max((known.misspelled[t] for t, _ in self.trie.near(word)), default=0.0)
        return min(weight, known.limits.get(word, weight))

    def evidence(self, text: str | None) -> tuple[float, int]:
        """The sum of a text's weights in their contexts, and the number of distinct toxic words."""
        lowered = (text or "").lower()
        weighed = {w: v for w in {*_WORD.findall(lowered)} if (v := self.weight(normal(w))) > 0}
        if not weighed:
            return 0.0, 0
        best: dict[str, float] = {}
        tokens = list(_WORD.finditer(lowered))
        quoted = _quoted(lowered)
        for i, m in enumerate(tokens):
            if m[0] in weighed:
                around = {t[0] for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
                inside = any(a < m.start() < b for a, b in quoted[max(0, bisect.bisect(quoted, (m.start(),)) - 1) :][:1])
                factor = QUOTED if inside or around & REPORTING else AIMED if around & ADDRESS else 1.0
                word = normal(m[0])
                best[word] = max(best.get(word, 0.0), factor * weighed[m[0]])
        return sum(sorted(best.values())), len(best)

    def score(self, text: str | None) -> tuple[float, int]:
        """Score from 0 to 1, and the number of distinct toxic words."""
        total, n = self.evidence(text)
        return 1 / (1 + math.exp(-min(30.0, self.lexicon.bias + self.lexicon.slope * total))), n


#: Opening marks with what closes them (fixed values).
CLOSERS = {'"': '"', "“": "”“", "„": "”“", "«": "»"}
_OPENING = re.compile(f"[{''.join(CLOSERS)}]")


def _quoted(text: str) -> list[tuple[int, int]]:
    """Stretches of one line between a pair of quotation marks, from the left. One sweep: places of marks and line ends are listed once."""
    opening = [m.start() for m in _OPENING.finditer(text)]
    if not opening:
        return []
    lines = [m.start() for m in re.finditer("\n", text)]
    closing = {c: [m.start() for m in re.finditer(f"[{c}]", text)] for c in {*CLOSERS.values()}}
    out, at = [], 0
    for start in opening:
        if start < at:
            continue
        ends = closing[CLOSERS[text[start]]]
        end, line = bisect.bisect(ends, start), bisect.bisect(lines, start)
        if end < len(ends) and not (line < len(lines) and lines[line] < ends[end]):
            at = ends[end] + 1
            out.append((start, at))
    return out


def _ratio(pos: float, neg: float, n_pos: int, n_neg: int, errors: float = -SURE) -> float:
    """Log ratio with so many of its standard errors, less `SURE` as in _strong."""
    return math.log(((pos + 0.5) / (n_pos + 1)) / ((neg + 0.5) / (n_neg + 1))) + errors * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def _strong(table: DataFrame, n_pos: int, n_neg: int, least: int) -> list:
    """The words of the sample that are surely toxic, all of them, those of most toxic rows first."""
    ratio = (F.col("pos") + 0.5) / (n_pos + 1) / ((F.col("neg") + 0.5) / (n_neg + 1))
    sure = F.log(ratio) - SURE * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    return table.where((F.col("pos") >= least) & (sure >= math.log(TOXIC))).orderBy(F.desc("pos"), "word").collect()


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Lexicon:
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(label_col).alias("mark"))
    totals = {bool(r["mark"]): r["count"] for r in marks.groupBy(F.col("mark") > 0).count().toDF("mark", "count").collect()}
    chosen = bounded_sample(marks.where("mark > 0"), F.col("l_id"), sample).unionByName(bounded_sample(marks.where("mark <= 0"), F.col("l_id"), sample))
    own = docs.where(~held_out(id_col)).select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text"))
    labelled = checkpointed(own.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("l_id", "mark", "text"))  # the sample is written once
    tokens = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\s]+")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 4)))
    sketches = labelled.withColumn("w", tokens).select("l_id", "mark", F.array_min(shingles).alias("sketch"))  # near copies mostly share their least shingle
    one = checkpointed(sketches.groupBy(F.col("mark") > 0, "sketch").agg(F.min("l_id").alias("l_id"), F.max(F.col("mark") > 0).alias("toxic")).select("l_id", "toxic"))
    rows = labelled.select("l_id", "text").join(F.broadcast(one), "l_id").select("text", "toxic")
    counted = "word string, pos long, neg long"
    out = arrow_schema(spark, counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for text, toxic in values(batches):
            (pos if toxic else neg).update({*words(text), ""})  # the empty word counts documents
        yield from to_batches(((w, pos[w], neg[w]) for w in pos.keys() | neg.keys()), out)

    table = map_arrow(rows, count, counted).groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist()
    try:
        sizes = table.where("word = ''").first()
        if sizes is None or not sizes["pos"]:
            return Lexicon()
        n_pos, n_neg = sizes["pos"], sizes["neg"]
        return _calibrate(_build(table.where("word <> ''"), n_pos, n_neg), rows, totals)
    finally:
        table.unpersist()


def _build(table: DataFrame, n_pos: int, n_neg: int) -> Lexicon:
    found = _strong(table, n_pos, n_neg, SUPPORT)
    longest = F.greatest(F.least(F.length("word") - 1, F.lit(LONGEST)), F.lit(STEM))
    stems = table.where("pos > 0 OR neg > 0").select(F.explode(F.transform(F.sequence(F.lit(STEM), longest), lambda n: F.when(F.length("word") > n, F.substring(F.col("word"), F.lit(1), n)))).alias("word"), "pos", "neg")
    stems = _strong(stems.where("word IS NOT NULL").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), n_pos, n_neg, 2 * SUPPORT)
    lexicon = Lexicon(
        weights={r["word"]: _ratio(r["pos"], r["neg"], n_pos, n_neg) for r in found},
        terms=[r["word"] for r in found if len(r["word"]) >= 4],
        stems={r["word"]: _ratio(r["pos"], r["neg"], n_pos, n_neg) for r in stems},
    )
    # seen words near the lexicon are judged by their own counts; rarer ones tell what unseen ones near each word weigh
    near = "word string, term string, pos long, neg long"
    out = arrow_schema(table.sparkSession, near)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(lexicon.terms)

        def rows():
            for word, pos, neg in values(batches):
                if word not in lexicon.weights:
                    hits = [t for t, _ in trie.near(word)]
                    if pos + neg >= SUPPORT and (hits or any(word[:n] in lexicon.stems for n in range(STEM, min(len(word), LONGEST + 1)))):
                        yield word, None, pos, neg
                    elif pos + neg < SUPPORT:
                        for t in hits:
                            yield None, t, pos, neg

        yield from to_batches(rows(), out)

    met = map_arrow(table.select("word", "pos", "neg"), close, near).groupBy("word", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    met = met.collect()  # words of the sample near the lexicon, and a row for a lexicon word
    seen = sorted((r for r in met if r["word"] is not None), key=lambda r: r["word"])
    less = n_neg / (MISSPELLED * n_pos)
    prior = lambda pos, neg: math.log(((pos + 1) / n_pos) / ((neg + less) / n_neg)) if n_neg else 0.0
    for r in seen:
        low, high = (_ratio(r["pos"], r["neg"], n_pos, n_neg, e) for e in (-SURE, SURE))
        if low >= math.log(TOXIC):
            lexicon.weights[r["word"]] = low
        elif high < math.log(TOXIC):
            lexicon.weights[r["word"]] = 0.0
        else:
            lexicon.limits[r["word"]] = max(0.0, min(high, prior(r["pos"], r["neg"])))
    rare = {r["term"]: (r["pos"], r["neg"]) for r in met if r["term"] is not None}
    for t in lexicon.terms:
        lexicon.misspelled[t] = min(max(0.0, prior(*rare.get(t, (0, 0)))), lexicon.weights[t])
    return lexicon


def _calibrate(lexicon: Lexicon, rows: DataFrame, totals: dict[bool, int]) -> Lexicon:
    """Bias and slope by logistic regression on the sample, weighted back to the classes' true shares."""

    def make():
        scorer = Scorer(lexicon)
        return lambda row: (round(scorer.evidence(row[0])[0], 1), row[1])

    found = map_rows(rows, "total double, toxic boolean", make)
    table = np.array([(r["total"], r["toxic"], r["count"]) for r in found.groupBy("total", "toxic").count().orderBy("total", "toxic").collect()], float)
    x, y, n = np.column_stack([np.ones(len(table)), table[:, 0]]), table[:, 1], table[:, 2]
    for mark in (0, 1):
        n[y == mark] *= totals.get(bool(mark), 1) / max(1.0, n[y == mark].sum())
    n /= n.sum() / table[:, 2].sum()
    beta, prior = np.array([-3.0, 1.0]), np.diag([1e-3, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior, x.T @ (n * (y - p)) - prior @ (beta - [-3.0, 1.0]))
        beta = beta + np.clip(step, -2, 2)
    lexicon.bias, lexicon.slope = float(beta[0]), max(0.0, float(beta[1]))
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms: every whole text."""
    shared, key = docs.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex  # bounded by the number of terms

    def make():
        own = kept_in_worker(key, lambda: Scorer(shared.value))

        def one(row):
            score, n = own.score(row[2])
            return row[0], row[1], score, int(score >= THRESHOLD), n

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int, n_terms int", make, keeps=True)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold. One pass; nothing is joined or shuffled."""
    shared, key = docs.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_in_worker(key, lambda: Scorer(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array([own.score(t)[0] < THRESHOLD for t in part.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
