import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from voxtally.llm import sanitise as sn

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    found.sort()
    counts = [sum(f[2] == k for f in found) for k in PLAIN]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest())


def texts():
    r = random.Random(1)
    out = ["", None, "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "é 4111 1111 1111 1111, 4111-1111-1111-1112 é", "+1 (555) 123-4567. +12 3", "x" * 50_000 + "@", "1" * 30_000, "ä@b.de 漢字 a.b@c-d.e.f. 00000000000255.1.1.1"]
    for _ in range(300):
        out.append("".join(r.choices(["1", "23", "4111111111111111", " ", "😀", "-", ".", "+", "(", ")", "a", "b@", "@", ".c", "é", "_", "255", "%"], k=r.randint(1, 40))))
    return out


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a@b.c", "x"), (5, "twin a@b.c", "x"), (5, "twin a@b.c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    want = sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    got = sn.private_spans(df).collect()
    assert sorted((tuple(x)[:6] for x in got), key=str) == want
    assert sn.private_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_terms_that_reveal_and_sanitised_text(spark, monkeypatch, limit):
    monkeypatch.setattr("voxtally.llm.common.BROADCAST_ROWS", limit)
    r = random.Random(2)
    word = lambda: "".join(r.choices("bcdfgh", k=6))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(200):
        body = " ".join(r.choices(common, k=30)) + f" {word()}"
        if i % 20 == 0:
            body += f" the {'Quasimodo' if i else 'Esmeralda'} mail q@bell.example and {r.choice(common)}"
        elif i == 7:
            body += " quasimodo elsewhere"
        rows.append((i, body, "keep"))
    rows += [(300 + i, rows[i][1], "copy") for i in (1, 2, 2, 2, 3)]  # copies are no further evidence
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = {x.doc_id: x for x in sn.private_spans(df).collect()}
    text = {i: t for i, t, _ in rows}
    for i in range(200):
        named = {text[i][int(a) : int(b)].lower(): k for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s)}
        if i % 20 == 0:
            assert named.pop("q@bell.example") == "email"
            assert named.pop("mail") == "secret"  # stands nowhere else
            assert (named.pop("quasimodo", None) == "secret") == (i > 0) and "esmeralda" not in named
            assert not set(named) & set(common)
        else:
            assert named == {}
    clean = sn.sanitise_text(df)
    assert clean.columns == df.columns
    out = {x.doc_id: x.text for x in clean.collect()}
    assert out[7] == text[7] and "[EMAIL]" in out[40] and "Quasimodo" not in out[40] and "@" not in out[0]


def prose(n):
    r = random.Random(3)
    common = ["".join(r.choices("bcdfgh", k=6)) for _ in range(30)]
    return common, [" ".join(r.choices(common, k=60)) for _ in range(n)]


def marked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in sn.private_spans(df).collect()}
    return {i: [(k, texts[i][int(a) : int(b)]) for k, a, b in v] for i, v in got.items() if v}


@pytest.mark.parametrize("n", [70, 2000])
def test_rare_words_are_no_evidence_and_classes_are(spark, n):
    """What stands in one text with a value says nothing, at any size; several addresses of a domain with one name do."""
    _, texts = prose(n)
    texts[5] += " Zorblat one@only.example"
    texts[12] += " rarely one@two.example, one@three.example"
    for i in range(20, 50):
        texts[i] += " rarely"
    for i in range(60, 65):
        texts[i] += f" Kwyjibo user{i}@shared.example unheard{chr(97 + i - 60)}"
    named = marked(spark, texts)
    assert named == {5: [("email", "one@only.example")], 12: [("email", "one@two.example"), ("email", "one@three.example")]} | {i: [("secret", "Kwyjibo"), ("email", f"user{i}@shared.example")] for i in range(60, 65)}


def test_many_spans_in_one_text_take_linear_time(spark):
    def took(n):
        text = " ".join(f"user{i}@mail{i}.example é" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert sn._blanked(sn.base_spans(df)).select("rest").first().rest == " ".join(" " * len(f"user{i}@mail{i}.example") + " é" for i in range(n))
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < took(1_000) + 10


def test_terms_anywhere_in_the_text(spark):
    _, texts = prose(1200)
    for i in (7, 8, 9, 10):
        texts[i] = f"Quasimodo {texts[i]} q@bell.example {texts[i]} QUASIMODO"
    texts[11] += " quasimodo"
    named = marked(spark, texts)
    assert named == {i: [("secret", "Quasimodo"), ("email", "q@bell.example"), ("secret", "QUASIMODO")] for i in (7, 8, 9, 10)}


def plain_marks(texts):
    """Terms of each text by pointwise mutual information, counted one by one over distinct texts."""
    distinct = sorted(set(texts))
    word = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    parts = {}
    for t in distinct:
        found = [(m.start(), m.end(), k, m[0]) for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m[0])]
        blank = list(t)
        for a, b, *_ in found:
            blank[a:b] = " " * (b - a)
        digits = lambda v: re.sub("[^0-9]", "", v)
        named = {f"{k}:{digits(v) if k in ('card', 'phone') else v.lower()}" for *_, k, v in found}
        share = {"email": lambda v: v.rsplit("@", 1)[-1].lower(), "ip": lambda v: v.rsplit(".", 1)[0], "card": lambda v: digits(v)[:6], "phone": lambda v: digits(v)[:5]}
        named |= {f"{k} class {share[k](v)}" for *_, k, v in found}
        parts[t] = (named, word("".join(blank)))
    n = len(distinct)
    n_t, n_e, both, tests = Counter(), Counter(), Counter(), 0
    for t in distinct:
        n_t.update(word(t))
        n_e.update(parts[t][0])
        both.update((e, w) for e in parts[t][0] for w in parts[t][1])

    tests = sum(len(parts[t][1]) for t in distinct for e in parts[t][0] if n_e[e] >= 3)

    def unlikely(k, m, q):
        p = k / m
        return -m * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0))

    out = {}
    for t in distinct:
        best = {}
        for e in parts[t][0]:
            for w in parts[t][1]:
                k, a, b = both[e, w], n_e[e], n_t[w]
                if k < 3:
                    continue
                pmi, whole = math.log2(k * n / (a * b)), math.log2(n / a)
                if pmi > 0 and whole > 0 and pmi / whole >= 0.5 and min(unlikely(k, a, b / n), unlikely(k, b, a / n)) + math.log(tests) <= math.log(0.01) + 1e-9:
                    best[w] = max(best.get(w, 0), pmi / whole)
        if best:
            out[t] = {w: "secret" if s >= 0.9 else "term" for w, s in best.items()}
    return out


def test_terms_equal_a_plain_version(spark):
    r = random.Random(9)
    common, texts = prose(1500)
    names = [f"{a}{b}" for a in ("Anna", "Otto", "Vera") for b in ("berg", "mann", "stein", "feld")]
    values = [f"{n.lower()}@mail.example" for n in names] + ["10.0.0.7", "+49 30 1234567", "4111 1111 1111 1111"]
    for i in range(0, 1500, 3):
        k = r.randrange(len(values))
        if r.random() < 0.5:
            texts[i] += f" {values[k]} {r.choice(common)}"
        for _ in range(r.randint(0, 2)):  # a value's own name, mostly, and names that stand alone
            texts[i] = f"{names[k % len(names)] if r.random() < 0.8 else r.choice(names)} {texts[i]}"
    for i in range(77, 81):
        texts[i] += f" unheard one{i}@only.example and ANNABERG too"
    texts += texts[:40]
    want = plain_marks(texts)
    got = marked(spark, texts)
    for i, t in enumerate(texts):
        have = {v.lower(): k for k, v in got.get(i, []) if k in ("term", "secret")}
        assert have == want.get(t, {}), t
    kinds = Counter(k for marks in want.values() for k in marks.values())
    assert kinds["term"] > 20 and kinds["secret"] > 0
