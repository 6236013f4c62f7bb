import random
import re
import time
import zlib
from collections import Counter

from voxtally.llm import spelling


def plain_distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if plain_distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def found(df):
    return sorted(((x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df).collect()), key=str)


def test_variants_equal_brute_force(spark):
    r = random.Random(11)
    stems = ["".join(r.choices("abcé", k=r.randint(5, 8))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            for _ in range(r.choice((0, 0, 1, 2))):
                at = r.randrange(len(w))
                w = r.choice((w[:at] + w[at + 1 :], w[:at] + r.choice("abcéÿ") + w[at:], w[:at] + r.choice("abc") + w[at + 1 :]))
            words.append(r.choice((w, w.upper(), w.capitalize())))
        rows.append((i, r.choice((" ", ", ", "9", "Ā")).join(words)))
    rows += [(None, "word worde " * 4), (None, None), (7, ""), (7, "same same Same "), (7, "×÷aaaa " * 3), (8, "chaina " * 3 + "chainb " * 6 + "chain " * 12 + "chains " * 24)]
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, N long")
    want = plain(rows)
    assert found(df) == want and len(want) > 200
    assert any(x[1] is not None and x[2] != x[1] for x in want)
    assert found(df.limit(0)) == []


def test_keys_are_hashes_of_what_is_left():
    for w in ("hello", "aab", "aaaaa", "ab", "aabbccdÿ"):
        left = [w] + [w[:i] + w[i + 1 :] for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
        keys = [key for key, _ in spelling.deletion_keys(w)]
        assert [w if at < 0 else w[:at] + w[at + 1 :] for _, at in spelling.deletion_keys(w)] == left
        assert keys == [next(spelling.deletion_keys(x))[0] for x in left] and len(set(keys)) == len(keys)


def test_very_long_words_take_linear_time(spark):
    r = random.Random(3)
    word = "".join(r.choices("abcdefgh", k=100_000))
    other = word[:50_000] + "z" + word[50_001:]
    began = time.perf_counter()
    got = found(spark.createDataFrame([(1, f"{word} {word} {word} {word} {word} {word} {other}"), (2, f"{other} {other}")], "doc_id long, text string"))
    assert [(x[0] == word, x[1] == word if x[1] else None, x[3:5]) for x in got] in ([(True, None, (6, 1)), (False, True, (3, 1))], [(False, True, (3, 1)), (True, None, (6, 1))])
    assert time.perf_counter() - began < 30
