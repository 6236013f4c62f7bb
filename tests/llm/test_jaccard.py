import random
import re
from itertools import combinations

import numpy as np
import pytest

from voxtally.llm import jaccard


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def plain(rows):
    sets = [plain_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best.setdefault(find(i), []).append(doc_id)
    return sorted(((rows[i][0], len(sets[i]), min((x for x in best[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


def found(df):
    return sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df).collect()), key=str)


def corpus(r):
    """Chains of near copies at and around the threshold, of all lengths, documents that share a passage, and odd rows."""
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(3, 6)))
    passage = [word() for _ in range(45)]
    rows = [(None, "x y z"), (7, "X\ty z"), (8, None), (8, ""), (9, " \n"), (9, "one"), (3, "One"), (None, None), (5, "a b c d e"), (5, "a b c d e"), (6, "a b c d f")]
    doc_id = 100
    for _ in range(28):
        words = [word() for _ in range(r.choice((3, 6, 8, 12, 20, 40, 80, 150, 300)))]
        for _ in range(r.randint(1, 6)):
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
            for _ in range(max(1, len(words) * r.choice((1, 2, 3, 4)) // 150)):
                words[r.randrange(len(words))] = word()
            if r.random() < 0.4:
                words = words[: len(words) - r.randint(0, max(1, len(words) // 12))]
    for _ in range(40):
        rows.append((doc_id, " ".join([*passage, *(word() for _ in range(r.randint(5, 60)))])))
        doc_id += 1
    base = [word() for _ in range(150)]
    for _ in range(30):
        copy = list(base)
        copy[r.randrange(150)] = word()
        rows.append((doc_id, " ".join(copy)))
        doc_id += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(random.Random(13))
    df = spark.createDataFrame([(*x, 0, "x") for x in rows], "doc_id long, text string, node long, point string")
    want = plain(rows)
    assert found(df) == want
    assert sum(x[0] != x[2] for x in want) > 45


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string")
    assert found(df) == [(1, 2, 1), (2, 0, 2)]
    assert found(df.limit(0)) == []


def test_linked_sets_share_a_key():
    r = np.random.default_rng(5)
    rare = 0
    for n in [*range(1, 60), 75, 90, 120, 333, 1000, 4000]:
        for _ in range(30 if n < 60 else 6):
            a = np.unique(r.integers(0, 1 << 63, n, dtype="u8") * np.uint64(2))
            for out in range(0, n // 6 + 1):
                for more in {0, out, n * 15 // 85 - out}:
                    b = np.unique(np.append(r.permutation(a)[out:], r.integers(0, 1 << 63, max(0, more), dtype="u8") * np.uint64(2) + np.uint64(1)))
                    shared = n - out
                    if 100 * shared >= 85 * (len(a) + len(b) - shared) and len(a) == n and (out or more > 0):
                        rare += 1
                        assert set(jaccard.part_keys(a).tolist()) & set(jaccard.part_keys(b).tolist()), (n, out, more)
                if n > 200 and out > 3:
                    break
    assert rare > 500
    clumped = [np.arange(i, i + 12, dtype="u8") for i in (0, 1)]  # all in one part
    assert set(jaccard.part_keys(clumped[0]).tolist()) & set(jaccard.part_keys(clumped[1]).tolist())


def test_searches_equal_full_counts(monkeypatch):
    r = random.Random(2)
    common = [r.getrandbits(63) for _ in range(60)]
    held = []
    for i in range(120):
        held.append(set(r.sample(sorted(held[-1]) if held and r.random() < 0.6 and len(held[-1]) > 20 else common, 20)) | {r.getrandbits(63) for _ in range(r.choice((0, 1, 3, 40)))})
        held[-1] = set(list(held[-1])[: r.randint(1, 60)]) | set(held[-1])
    array = lambda x: np.array(sorted(x), "u8")
    unit = jaccard.Unit([(True, True, str(i).encode(), array(x)) for i, x in enumerate(held)])
    for mu, probed in ((0.01, 2_000_000), (1.0, 7)):
        monkeypatch.setattr(jaccard, "MU", mu)
        monkeypatch.setattr(jaccard, "PROBED", probed)
        for x in held:
            assert unit.search(array(x)) == [i for i, y in enumerate(held) if 100 * len(x & y) >= 85 * len(x | y)]
    assert jaccard.Unit([(True, False, b"a", array({1, 2}))]).search(array({1, 2})) == []
