import hashlib
import random
import re

import pytest

from voxtally.llm import decontaminate as dc

WORD = re.compile(dc.WORD)


def plain(docs, bench, window=10):
    split = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = []
    for doc_id, text, *_ in docs:
        w = split(text)
        hit, items = set(), set()
        for item_id, t in bench:
            b = split(t)
            size = min(len(b), window)
            wins = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    items.add(item_id)
        ids = ",".join(sorted(map(str, items)))
        rows.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def fixture():
    r = random.Random(3)
    bench = [(i, " ".join(r.choices(["aa", "bb", "cc", "Dd"], k=r.choice([1, 3, 7, 10, 11, 30])))) for i in range(2, 14)] + [(20, None), (21, "!!"), (22, "Äpfel und x1"), (23, "Äpfel und x1")]
    docs = []
    for i in range(40):
        text = " ".join(r.choices(["aa", "Bb", "cc", "dd", "zz", "qq,"], k=r.randint(0, 60)))
        if i % 3 == 0:
            text += ". " + r.choice(bench[:12])[1].upper().replace(" ", ", ") + " tail"
        docs.append((i, text, "x"))
    docs += [(50, None, ""), (51, "", ""), (52, "äpfel ÄPFEL Äpfel und X1", ""), (53, "twin " + bench[5][1], ""), (53, "twin " + bench[5][1], ""), (None, bench[6][1], ""), (54, "w " * 30_000, "")]
    return docs, bench


@pytest.mark.parametrize("limit", [500_000, 0])
def test_report(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", limit)
    docs, bench = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(bench, "item_id long, text string")
    d = d.selectExpr("*", "items AS w", "items AS tie", "items AS at", "items AS key", "items AS size", "items AS gone_id", "items AS hits", "items AS _hits", "items AS bitmap")
    want = plain(docs, bench)
    assert sorted((tuple(x) for x in dc.contamination_report(d, b).collect()), key=str) == want
    clean = dc.drop_contaminated(d, b)
    assert clean.columns == d.columns and sorted((x.doc_id for x in clean.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)
    assert dc.contamination_report(d.limit(0), b).count() == 0
    assert {x.contaminated for x in dc.contamination_report(d, b.limit(0)).collect()} == {False}


def test_a_very_long_text_and_a_full_bitmap(spark, monkeypatch):
    """Look-ups are linear in a text's words; a bitmap that holds everything only sends more rows to the join."""
    passage = [f"p{i}" for i in range(25)]
    bench = spark.createDataFrame([(i, " ".join(passage)) for i in range(3)] + [(9, "lone")], "item_id long, text string")
    r = random.Random(5)
    long = r.choices([f"w{i}" for i in range(300)], k=300_000)
    long[1000:1000] = passage[:15]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:50], *passage[3:9], *long[:50]])), (3, "Lone " + " ".join(passage[4:14]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for longs in (dc.MOST_LONGS, 1):
        monkeypatch.setattr(dc, "MOST_LONGS", longs)
        part = d if longs > 1 else d.where("doc_id > 1")
        got = {x.doc_id: tuple(x)[1:4] for x in dc.contamination_report(part, bench).collect()}
        assert got == {i: v for i, v in {1: (300_015, 15, 3), 2: (106, 0, 0), 3: (11, 11, 4)}.items() if i > 1 or longs > 1}


def test_cut_text_keeps_the_rest(spark):
    d = spark.createDataFrame([(1, "«Start, one two three! end.»", 1), (2, "clean", 2), (3, None, 3)], "doc_id long, text string, n long")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {x.doc_id: x.text for x in dc.remove_spans(d, b).collect()}
    assert got == {1: "«Start, end.»", 2: "clean", 3: None}


def test_sql(spark):
    import duckdb
    import pandas as pd

    docs, bench = fixture()
    docs = [x for x in docs if x[0] not in (None, 53)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "z"]))
    con.register("benchmark", pd.DataFrame(bench, columns=["item_id", "text"]))
    assert sorted((tuple(x) for x in con.execute(dc.SQL).fetchall()), key=str) == plain(docs, bench)
