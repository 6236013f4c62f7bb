import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from voxtally.llm import toxicity
from voxtally.llm.toxicity import FuzzyTrie, Lexicon, Scorer, _build, _quoted, drop_toxic, learn, normal, score_documents, words


def one_edit(a, b):
    """0 or 1 if so many inserts, deletes, substitutions or swaps of neighbours lead from a to b, else None."""
    if a == b:
        return 0
    letters = set(a + b)
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))}
    edits |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    edits |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}
    edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return 1 if b in edits else None


def test_automaton_finds_all_words_within_one_edit(monkeypatch):
    monkeypatch.setattr("voxtally.llm.toxicity.STATES", 60)
    r = random.Random(1)
    for _ in range(40):
        terms = sorted({"".join(r.choices("abc", k=r.randint(3, 7))) for _ in range(r.randint(1, 9))})
        trie = FuzzyTrie(terms, shortest=1)
        for _ in range(60):
            word = "".join(r.choices("abcd", k=r.randint(1, 8)))
            want = tuple((t, d) for t in terms if (d := one_edit(t, word)) is not None)
            assert trie.near(word) == want, (terms, word)


def test_words_and_quotes():
    assert words("Stuuupid, st*pid id1ot!!") == ["stupid", "st*pid", "id1ot"] and normal("aab") == "aab"
    text = 'he "is a" fool «or not» “x”'
    assert [text[a:b] for a, b in _quoted(text)] == ['"is a"', "«or not»", "“x”"]


def test_context():
    lexicon = Scorer(Lexicon(weights={"moron": 5.0}, terms=["moron"], misspelled={"moron": 4.0}, bias=-4.0, slope=1.0))
    score = lambda t: lexicon.score(t)[0]
    assert score(None) == score("") == score("nothing here") < 0.05
    assert score("you moron") > score("what a moron") > score("what a mroon") > score('a "moron" then') > score("none")
    assert score("he said moron once") == score('a "moron" then')
    assert score('"moron" is what he used, a b c d e f g moron') == score("moron")
    assert lexicon.score("moron " * 50_000)[1] == 1


def fixture(spark):
    r = random.Random(5)
    common = ["".join(r.choices("bcdfghlm", k=r.randint(3, 8))) for _ in range(300)]
    bad = ["wretch", "villain", "scoundrel", "knave"]
    docs, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        text = r.choices(common, k=40)
        if toxic:
            text[3:3] = r.sample(bad, 2)
        docs.append((i, " ".join(text), "x", i))
        labels.append((i, int(toxic)))
    docs += [(9001, "a b villian and wretchh", "x", 0), (9002, None, "x", 0), (9003, "", "x", 0), (None, "wretch knave", "x", 0), (9004, "twin knave wretch", "x", 0), (9004, "twin knave wretch", "x", 0)]
    labels += [(1, 0), (2, None), (None, 1)]
    more = spark.createDataFrame(docs, "doc_id long, text string, score string, predicted long").selectExpr("*", "score AS mark", "score AS l_id", "score AS toxic", "score AS word")
    return more, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_scores(spark):
    docs, labels = fixture(spark)
    lexicon = learn(docs, labels)
    assert {"wretch", "villain", "scoundrel", "knave"} <= set(lexicon.terms)
    rows = score_documents(docs, lexicon).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == 806
    for i in range(800):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == int(i % 5 == 0) == int(got[i].score >= 0.3)
    assert got[9001].predicted == 1 and got[9002].score == got[9003].score < 0.3 and got[None].predicted == 1
    kept = drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 642
    # held-out labels teach nothing
    from pyspark.sql import functions as F

    from voxtally.llm.common import held_out

    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert learn(docs, flipped).weights == lexicon.weights
    small = learn(docs, labels, sample=60)
    assert set(small.terms) <= set(lexicon.terms) | {""} or small.weights


PLAIN_WORD = re.compile(r"[^\W_]+(?:[*@$'’][^\W_]+)*")


def plain_words(text):
    return [re.sub(r"(.)\1\1+", r"\1", w) for w in PLAIN_WORD.findall((text or "").lower())]


def plain_weights(rows):
    """Weight of a word by sightings in (text, toxic) rows, with edits tried one by one instead of by automata."""
    n = Counter(toxic for _, toxic in rows)
    seen = {flag: Counter(w for text, toxic in rows if toxic == flag for w in set(plain_words(text))) for flag in (True, False)}

    def bound(pos, neg, errors):
        return math.log((pos + 0.5) / (n[True] + 1) * (n[False] + 1) / (neg + 0.5)) + errors * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))

    def prior(pos, neg):
        return math.log((pos + 1) / n[True] * n[False] / (neg + n[False] / (60 * n[True])))

    both = {w: (seen[True][w], seen[False][w]) for w in seen[True] | seen[False]}
    surely = lambda counts, least: {w: bound(p, q, -1.5) for w, (p, q) in counts.items() if p >= least and bound(p, q, -1.5) >= math.log(6)}
    lexicon = surely(both, 3)
    begun = Counter(), Counter()
    for w, counts in both.items():
        for k in range(5, len(w)):
            for c, x in zip(begun, counts, strict=True):
                c[w[:k]] += x
    stems = surely({w: (begun[0][w], begun[1][w]) for w in begun[0] | begun[1]}, 6)
    long = [w for w in lexicon if len(w) >= 4]
    near = lambda w: [t for t in long if abs(len(t) - len(w)) < 2 and len(w) > 2 and one_edit(t, w) is not None]
    rare = {t: [0, 0] for t in long}
    for w, (p, q) in both.items():
        if p + q < 3 and w not in lexicon:
            for t in near(w):
                rare[t][0] += p
                rare[t][1] += q

    def weight(w):
        if w in lexicon:
            return lexicon[w]
        found = [stems[w[:k]] for k in range(5, len(w)) if w[:k] in stems]
        unseen = found[-1] if found else max((min(max(0.0, prior(*rare[t])), lexicon[t]) for t in near(w)), default=0.0)
        p, q = both.get(w, (0, 0))
        if p + q < 3 or not unseen:
            return unseen
        low, high = bound(p, q, -1.5), bound(p, q, 1.5)
        return low if low >= math.log(6) else 0.0 if high < math.log(6) else min(unseen, max(0.0, min(high, prior(p, q))))

    return weight


def plain_total(text, weight):
    """Weights of a text's distinct words in their best context."""
    text = (text or "").lower()
    found = list(PLAIN_WORD.finditer(text))
    marks = [m.span() for p in (r'"[^"\n]*"', r"[“„][^”“\n]*[”“]", r"«[^»\n]*»") for m in re.finditer(p, text)]
    best = {}
    for i, m in enumerate(found):
        word = plain_words(m[0])[0]
        around = {x[0] for x in found[max(0, i - 5) : i + 6]}
        quoted = any(a < m.start() < b for a, b in marks) or around & {"said", "wrote", "called"}
        factor = 0.35 if quoted else 1.2 if around & {"you", "your"} else 1.0
        best[word] = max(best.get(word, 0.0), factor * weight(word))
    return sum(sorted(v for v in best.values() if v > 0))


def test_scores_equal_a_plain_version(spark):
    r = random.Random(8)
    common = ["".join(r.choices("bcdfghlmnprst", k=r.randint(3, 8))) for _ in range(150)]
    bad = ["wretch", "villain", "scoundrel", "knave", "oaf"]
    spoil = lambda w: w[:2] + w[3:] if r.random() < 0.5 else w[0] + w[2] + w[1] + w[3:]
    docs, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = r.choices(common, k=30)
        if toxic or r.random() < 0.03:
            words[4:4] = [w if r.random() < 0.8 else spoil(w) for w in r.sample(bad, r.randint(1, 2))] + r.choices([[], ["wretchedness"], ["scoundrelly"]])[0]
        if r.random() < 0.2:
            words[2:2] = [r.choice(["you", "said", '"', "your"])]
        if r.random() < 0.1:
            words[5:7] = ['"' + words[5], words[6] + '"']
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(600 + k, t) for k, t in enumerate(["", None, "villian!! wretchedly", 'he said "scoundrel" and you knaave', "Wreeetch", "oafs"])]
    learned = [(t, bool(i % 4 == 0)) for i, t in docs[:500] if zlib.crc32(str(i).encode()) % 4 != 2]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lexicon = learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = plain_weights(learned)
    scorer = Scorer(lexicon)
    for w in {w for _, t in docs for w in plain_words(t)} | {"knve", "villainous", "vilain"}:
        assert scorer.weight(w) == pytest.approx(weight(w)), w
    # the curve is the one at which the penalised likelihood of the sample is stationary
    x = [(round(plain_total(t, weight), 1), y) for t, y in learned]
    miss = [(t, y - 1 / (1 + math.exp(-min(30.0, lexicon.bias + lexicon.slope * t)))) for t, y in x]
    assert abs(sum(m for _, m in miss) - 1e-3 * (lexicon.bias + 3)) < 1e-4 and abs(sum(t * m for t, m in miss) - 1e-1 * (lexicon.slope - 1)) < 1e-3
    got = {row.doc_id: row for row in score_documents(d, lexicon).collect()}
    for i, t in docs:
        score = 1 / (1 + math.exp(-min(30.0, lexicon.bias + lexicon.slope * plain_total(t, weight))))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].predicted == int(score >= 0.3), t


def test_no_labels_and_no_rows(spark):
    docs, labels = fixture(spark)
    assert {x.predicted for x in score_documents(docs, learn(docs, labels.limit(0))).collect()} == {0}
    assert score_documents(docs.limit(0), learn(docs.limit(0), labels)).count() == 0


def test_rare_misspellings_in_a_balanced_sample(spark):
    counts = [("scoundrel", 900, 9), ("sckundrel", 5, 0), ("scoundrol", 0, 12), ("scaundrel", 2, 60)]
    lexicon = _build(spark.createDataFrame(counts, "word string, pos long, neg long"), 10_000, 10_000)
    weight = Scorer(lexicon).weight
    assert lexicon.terms == ["scoundrel"]
    assert weight("sckundrel") == weight("szoundrel") > 1  # few sightings, none of them clean, as if unseen
    assert weight("scoundrol") == weight("scaundrel") == 0


def test_quotes_equal_a_pattern_and_take_linear_time():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choices('"“„”«»\nab', k=r.randint(0, 25)))
        assert toxicity._quoted(text) == [m.span() for m in re.finditer(r"\"[^\"\n]*\"|[“„][^”“\n]*[”“]|«[^»\n]*»", text)]
    began = time.perf_counter()
    assert toxicity._quoted("« a „ b " * 100_000) == [] and toxicity._quoted('" a \n' * 100_000) == []
    assert time.perf_counter() - began < 3


def test_very_long_words(spark):
    """A word of 100,000 letters has stems of its first letters only; it is learned, and scored in linear time."""
    long = "".join(random.Random(5).choices("abcdefgh", k=100_000))
    texts = [(i, f"{long} bad{i}", 1) if i % 2 else (i, f"some plain words {i}", 0) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(i, n) for i, _, n in texts], "doc_id long, toxic int"))
    assert max(map(len, lexicon.stems)) == toxicity.LONGEST and toxicity.normal(long) in lexicon.weights
    scorer = toxicity.Scorer(lexicon)
    began = time.perf_counter()
    assert scorer.score(long[:70] + "zz")[0] > toxicity.THRESHOLD > scorer.score("some plain words")[0]
    assert time.perf_counter() - began < 5
