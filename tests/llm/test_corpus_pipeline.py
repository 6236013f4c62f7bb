import random
from collections import Counter

import pytest

import corpus_pipeline
from voxtally.llm import simhash
from voxtally.llm.common import bounded_sample

pytest.importorskip("public_tokenizers")


def fixture(spark, place):
    r = random.Random(11)
    common = ["".join(r.choices("bcdfghlm", k=r.randint(3, 8))) for _ in range(400)]
    bad = ["wretch", "villain", "scoundrel", "knave"]
    bench = [(i, " ".join(r.choices(common, k=20))) for i in range(5)]
    docs, labels, kinds = [], [], {}
    for i in range(600):
        words = r.choices(common, k=r.randint(40, 120))
        kind = "clean"
        if i % 6 == 0:
            kind, words[5:5] = "toxic", r.sample(bad, 3)
        elif i % 10 == 1:
            kind, words[7:7] = "leak", bench[i % 5][1].split()[3:15]
        docs.append((i, " ".join(words), "en", f"s{i % 4}", len(words)))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    for i in range(0, 40, 4):  # exact and near copies of clean documents
        base = next(d for d in docs[i:] if kinds[d[0]] == "clean")
        docs.append((1000 + i, base[1], "en", "s9", base[4]))
        kinds[1000 + i] = "copy"
    docs += [(2000, "", "en", "s1", 0), (2001, None, None, None, None), (2002, "short", "en", "s1", 1)]
    kinds |= {2000: "clean", 2001: "copy", 2002: "clean"}  # null and empty are one group
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return docs, kinds


def test_stages(spark, tmp_path):
    place = str(tmp_path)
    docs, kinds = fixture(spark, place)
    now = spark.read.parquet(f"{place}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, place).write.parquet(f"{place}/{name}")
        now = spark.read.parquet(f"{place}/{name}")
        seen[name] = now.collect()
    ids = {name: {x.doc_id for x in rows} for name, rows in seen.items()}
    of = lambda *k: {i for i, kind in kinds.items() if kind in k}
    assert all(spark.read.parquet(f"{place}/{n}").columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    assert ids["toxicity"] == of("clean", "leak", "copy")
    prints = {d[0]: simhash.fingerprint(d[1]) % (1 << 64) for d in docs}
    assert ids["simhash_near_dedup"] == of("clean", "leak")
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for a in ids["simhash_near_dedup"] for b in ids["simhash_near_dedup"] if a < b)
    assert ids["benchmark_decontamination"] == of("clean")
    text = {d[0]: d[1] for d in docs}
    assert all(x.text == text[x.doc_id] for x in seen["source_mixing"])
    taken = Counter(x.doc_id for x in seen["source_mixing"])
    assert max(taken.values()) <= 2 and set(taken) <= of("clean")
    words = sum(len((text[i] or "").split()) for i in of("clean"))
    assert sum(len(x.text.split()) for x in seen["source_mixing"]) == pytest.approx(1.5 * words, rel=0.02)
    last = sorted(seen["token_files"], key=lambda x: x.start)
    assert [x.doc_id for x in last] == sorted(taken.elements())
    assert [x.start for x in last] == [sum(y.n_tokens for y in last[:k]) for k in range(len(last))]


def test_run_gives_what_the_stages_give(spark, tmp_path):
    fixture(spark, str(tmp_path))
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert first == again and first


def test_a_bounded_sample_is_the_same_each_time(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000)
    got = {x.id for x in bounded_sample(df, F.col("id"), 100).collect()}
    assert len(got) == 100 and got == {x.id for x in bounded_sample(df.repartition(7), F.col("id"), 100).collect()}
    assert bounded_sample(df, F.col("id"), 5000).count() == 1000 and bounded_sample(df.limit(0), F.col("id"), 5).count() == 0
