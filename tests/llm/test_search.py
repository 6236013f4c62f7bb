import math
import random
import re
from collections import Counter

import numpy as np

from voxtally.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counts = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, length = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    df = spark.createDataFrame([(*x, 0, "x") for x in docs], "doc_id long, text string, item_id long, score string")
    asked = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id long")
    return sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in search.search(df, asked, **more).collect()), key=str)


def corpus(r, n):
    words = ["".join(r.choices("abcdé9", k=r.randint(1, 4))) for _ in range(150)]
    chosen = lambda k: r.choice((" ", ", ", "_", "-")).join(w.upper() if r.random() < 0.1 else w for w in r.choices(words, [1 / (i + 1) for i in range(150)], k=k))
    docs = [(i, chosen(r.choice((1, 5, 30, 200)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (None, None), (5, ""), (5, ".,_"), (9, docs[9][1]), (9, docs[9][1])]
    items = [(i, chosen(r.randint(1, 30))) for i in range(15)] + [(3, docs[3][1]), (70, None), (71, "---"), (72, "zzzz"), (None, "a b c"), (8, "a a a")]
    return docs, items


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items = corpus(random.Random(12), 400)
    want = plain(docs, items)
    assert found(spark, docs, items) == want and len({x[0] for x in want}) > 15
    monkeypatch.setattr(search, "ITEM_TERMS", 60)  # several blocks of items
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, k=3) == plain(docs, items, 3)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


def test_blocks_end_early_with_exact_scores(monkeypatch):
    """Blocks of documents one after the other, with few completed candidates, against full sums."""
    docs, items = corpus(random.Random(5), 3000)
    number = {}
    for _, text in items:
        for t in search.terms(text):
            number.setdefault(t, len(number))
    counts = [Counter(search.terms(t)) for _, t in docs]
    df = Counter(t for c in counts for t in c)
    n, length = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in number], "i8")
    completed = []
    plainly = search.Block._completed
    monkeypatch.setattr(search.Block, "_completed", lambda self, c, *a: completed.append(len(c)) or plainly(self, c, *a))
    for most in (5, 1000):
        monkeypatch.setattr(search, "COMPLETED", most)
        got = {}
        for start in range(0, len(docs), 500):
            part = range(start, min(start + 500, len(docs)))
            table = sorted((number[t], d - start, tf) for d in part for t, tf in counts[d].items() if t in number)
            table = np.array(table, "i8")
            block = search.Block([docs[d][0] for d in part], np.array([sum(counts[d].values()) for d in part]), *table.T, weights=weights, n=n, length=length)
            for i, (_, text) in enumerate(items):
                asked = Counter(search.terms(text))
                kept = got.setdefault(i, [])
                kept += block.best(np.array([number[t] for t in asked], "i8"), np.array(list(asked.values()), "i8"), 10, kept[9][0] if len(kept) >= 10 else 1)
                kept.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out = sorted(((items[i][0], rank, doc_id, score) for i, kept in got.items() for rank, (score, doc_id) in enumerate(kept[:10], 1)), key=str)
        assert out == plain(docs, items)
    assert len(completed) > 50 and max(completed) > 5
