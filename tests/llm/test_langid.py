import random
import zlib
from collections import Counter

from voxtally.llm import langid


def plain_ngrams(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(clean.split()) + " " if clean.split() else ""
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                out[g] += 1
    return out


def number(g):
    out = 0
    for c in g:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def plain_profile(text):
    return [g for g, _ in sorted(plain_ngrams(text).items(), key=lambda x: (-x[1], number(x[0])))][: langid.PROFILE]


def test_profiles_and_distance():
    r = random.Random(3)
    texts = ["", "a", "..", "Ab c, 漢字! É\n x  y", "".join(r.choices("abcé ß.,\n", k=9000)), "😀 a😀b"]
    for t in texts:
        assert langid.profile(*langid.ngrams(t)).tolist() == [number(g) for g in plain_profile(t)]
    ranked = {"x": plain_profile("abc abd abe " * 9), "y": plain_profile("zzz yyy zyx " * 7)}
    known = langid.Profiles({k: [number(g) for g in v] for k, v in ranked.items()})
    for t in texts[1:]:
        own = plain_profile(t)
        want = [sum(abs(i - v.index(g)) if g in v else langid.PROFILE for i, g in enumerate(own)) for v in ranked.values()]
        if own:
            assert known.distances(langid.profile(*langid.ngrams(t))).tolist() == want


def test_columns(spark):
    r = random.Random(4)
    say = {"aa": "la le lo mi ma ", "bb": "str grz pnk ", "cc": "漢字仮名"}
    rows = [(i, "".join(r.choices(list(say[lang]), k=r.randint(30, 300))), lang if i % 7 else None, "s") for i in range(600) for lang in [r.choice(list(say))]]
    truth = {i: next(k for k, v in say.items() if any(c in v for c in t if c.isalpha())) for i, t, *_ in rows}
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !?", "bb", "s"), (None, "la la", "aa", "s"), (1003, "la mi lo", "bb", "s"), (1003, "la mi lo", "bb", "s"), (1004, "lala " * 40_000, "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    df = df.withColumns({c: df.score for c in ("id", "n", "gram", "rank")})
    profiles = langid.learn_profiles(df)
    assert sorted(profiles) == ["aa", "bb", "cc"]
    got = langid.identify(df, profiles).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(by[i].lang_pred == truth[i] for i in range(600))
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1004].lang_pred == "aa"
    assert {x.lang_pred for x in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), profiles).count() == 0 and langid.learn_profiles(df.limit(0)) == {}
    assert sorted(langid.learn_profiles(df, sample=50)) == ["aa", "bb", "cc"]


def test_predictions_equal_a_plain_version(spark):
    r = random.Random(14)
    say = {"aa": "la le lo mi ma ", "bb": "lo re mi sa ", "cc": "le lé sé mé "}
    rows = [(i, "".join(r.choices(list(say[lang]), k=r.randint(5, 120))), lang if i % 9 else None) for i in range(400) for lang in [r.choice(list(say))]]
    rows += [(500, None, "aa"), (501, "", None), (502, "1, 2", "bb"), (503, "é", "cc"), (504, "zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = {lang: Counter() for lang in say}
    for i, text, lang in rows:
        if lang and text and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang] += plain_ngrams(text)
    ranked = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))][: langid.PROFILE] for lang, c in learned.items()}
    profiles = langid.learn_profiles(df)
    assert profiles == {lang: [number(g) for g in grams] for lang, grams in ranked.items()}
    got = {x.doc_id: x for x in langid.identify(df, profiles).collect()}
    for i, text, _ in rows:
        own = plain_profile(text or "")
        far = {lang: sum(abs(k - grams.index(g)) if g in grams else langid.PROFILE for k, g in enumerate(own)) for lang, grams in ranked.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        want = (best, 1 - far[best] / (langid.PROFILE * len(own))) if own else ("und", 0.0)
        assert (got[i].lang_pred, got[i].score) == want, text
