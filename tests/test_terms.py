import random
import re
import time

import pytest
from pyspark.sql import functions as F

from voxtally.functions.text import may_overlap
from voxtally.operators import automaton, matching
from voxtally.sources import dictionaries
from voxtally.sources.dictionaries import dictionary_of, spelling_conflicts


def plain_spans(text, form):
    pattern = rf"(?<![A-Za-z0-9_]){re.escape(form)}(?![A-Za-z0-9_])" if form.isascii() else re.escape(form)
    return [(m.start(), m.end()) for m in re.finditer(pattern, text)]


def plain_kept(text, forms):
    """The places of the forms that keep a span, all pairs compared."""
    kept = []
    for start, end, place in sorted(((s, e, i) for i, f in enumerate(forms) for s, e in plain_spans(text, f)), key=lambda x: (x[0] - x[1], x[0], x[2])):
        if all(start >= e or s >= end for s, e, _ in kept):
            kept.append((start, end, place))
    return sorted({p for _, _, p in kept})


def some_terms(r, n):
    return [sorted({"".join(r.choices("ab_ é.", k=r.randint(1, 5))).strip() or "a" for _ in range(r.randint(1, 6))}) for _ in range(n)]


def test_matcher_against_a_plain_version():
    r = random.Random(1)
    for _ in range(60):
        terms = some_terms(r, 5)
        matcher = automaton.Matcher((f, i, place) for i, forms in enumerate(terms) for place, f in enumerate(forms))
        for _ in range(20):
            text = "".join(r.choices("aab_ é.", k=r.randint(0, 60)))
            assert matcher.kept(text) == {i: k for i, forms in enumerate(terms) if (k := plain_kept(text, forms))}
            assert matcher.counts(text) == {(i, p): n for i, forms in enumerate(terms) for p, f in enumerate(forms) if (n := len(plain_spans(text, f)))}


def test_a_hundred_thousand_overlapping_spans():
    text = "ababa" * 60_000 + "é"
    began = time.perf_counter()
    kept = automaton.Matcher([(f, 0, i) for i, f in enumerate(["ébab", "ababéé", "babaé", "aé"])]).kept(text)
    spans = [(i, i + 4, i % 3) for i in range(100_000)]
    assert automaton.kept_places(spans, 100_010) == [0, 1, 2] and kept == {0: [2]}
    assert time.perf_counter() - began < 5


def test_overlaps_against_all_pairs():
    r = random.Random(2)
    for _ in range(3000):
        terms = ["".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(r.randint(1, 4))]
        want = any(a != b and (a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b))))) for a in terms for b in terms)
        assert may_overlap(terms) == want
    began = time.perf_counter()
    assert not may_overlap([f"<{i:06}" for i in range(50_000)]) and time.perf_counter() - began < 10


@pytest.mark.parametrize("chars", [matching.AUTOMATON_CHARS, 30])
def test_large_dictionaries_in_one_pass_and_in_several(spark, monkeypatch, chars):
    monkeypatch.setattr(matching, "AUTOMATON_CHARS", chars)
    monkeypatch.setattr(matching, "INLINE_SPELLINGS", 0)
    r = random.Random(4)
    forms = sorted({f for forms in some_terms(r, 30) for f in forms})
    rows = spark.createDataFrame([(f"t{r.randrange(8)}", "name", f) for f in forms] + [("t9", "n", None), ("t9", "n", " ")], "id string, name string, spelling string")
    d = dictionary_of(rows, "v1", "d")
    assert sorted(p for t in d.terms for p in t.patterns) == forms and [t.id for t in d.terms] == sorted(t.id for t in d.terms)
    texts = ["".join(r.choices("aab_ é.", k=r.randint(0, 40))) for _ in range(50)] + ["", None]
    comments = spark.createDataFrame([(str(i), "v", t) for i, t in enumerate(texts)], "comment_id string, video_id string, normal_text string")
    comments = comments.withColumns({"published_at": F.lit("2026-01-01").cast("timestamp"), "ingested_at": F.lit("2026-01-02").cast("timestamp"), "ord": F.lit(1)})
    got = {(x.comment_id, x.topic_id): x.matched_keywords for x in matching.topic_records(comments, d).collect()}
    want = {(str(i), t.id): [t.spellings[p] for p in k] for i, text in enumerate(texts) for t in d.terms if (k := plain_kept(text or "", t.patterns))}
    assert got == want and len(got) > 100
    got = {(x.comment_id, x.id, x.spelling): x.n for x in matching.occurrence_rows(comments, d).collect()}
    assert got == {(str(i), t.id, s): n for i, text in enumerate(texts) for t in d.terms for s, p in zip(t.spellings, t.patterns, strict=True) if (n := len(plain_spans(text or "", p)))}
    assert matching.topic_records(comments.limit(0), d).count() == 0


def test_conflicts_of_a_table(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "n", "One"), ("a", "n", "ONE "), ("b", "n", "ｏｎｅ"), ("b", "n", "two"), ("c", "n", "three"), ("c", "n", "three"), ("c", "n", None)], "id string, name string, spelling string")
    got = {(x.form, x.term_count, x.spelling_count, x.first_term, x.problem) for x in spelling_conflicts(rows).collect()}
    assert got == {("one", 2, 3, "a", "conflict"), ("three", 1, 2, "c", "duplicate")}
    assert [(t.id, t.patterns) for t in dictionary_of(rows, "v", "d").terms] == [("a", ("one",)), ("b", ("two",)), ("c", ("three",))]
    monkeypatch.setattr(dictionaries, "TABLE_SPELLINGS", 2)
    with pytest.raises(ValueError, match="may have 2 spellings"):
        dictionary_of(rows, "v", "d")
