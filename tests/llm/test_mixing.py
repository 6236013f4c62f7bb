import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxtally.llm import mixing


def plain_targets(sizes, weights, total):
    fixed = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        if not rest:
            return [fixed[i] for i in range(len(sizes))]
        left = total - sum(fixed.values())
        level = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = [i for i in rest if level[i] > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, level.get(i)) for i in range(len(sizes))]
        fixed |= {i: 2 * sizes[i] for i in over}


def test_targets(spark):
    r = random.Random(1)
    for tasks in (1, 2, 5, 3, 4, 7):
        sizes = [r.choice([0, 5, 100, 1000, 30_000]) for _ in range(r.randint(1, 40))]
        names = [f"s{i:03}" for i in range(len(sizes) - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(tasks)
        got = sorted(mixing.with_targets(df).collect(), key=lambda x: x["at"])
        assert [(x.source, x.source_size, x["at"], x.weight) for x in got] == [(n, z, i, (3, 1, 2)[i % 3]) for i, (n, z) in enumerate(zip(names, sizes, strict=True))]
        want = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
        assert [x.target for x in got] == pytest.approx(want) and sum(want) == pytest.approx(1.5 * sum(sizes))


def test_tree_is_exact_and_draws_fairly():
    quotas = [0, 1, 37, 400, 12]
    for shards in (1, 2, 7, 16):
        got = mixing.split_quotas(quotas, shards)
        assert got.sum(0).tolist() == quotas and (got >= 0).all()
        assert np.ptp(got.sum(1)) <= shards.bit_length() + 1
    mean = np.mean([mixing.split_quotas(quotas, 4, seed)[0] for seed in range(400)], axis=0)
    assert mean == pytest.approx([q / 4 for q in quotas], rel=0.15, abs=0.3)
    # in groups: first the groups, then the sources within what their group got
    whole = mixing.split_quotas([38, 412], 4)
    parts = [mixing.split_quotas(q, 4, [20, g], whole[:, g]) for g, q in enumerate(([0, 1, 37], [400, 12]))]
    assert np.hstack(parts).sum(0).tolist() == quotas and all((p.sum(1) == whole[:, g]).all() for g, p in enumerate(parts))
    assert 0 <= mixing._hypergeometric(np.random.default_rng(1), 5 * 10**9, 10**9, 3 * 10**9) <= 3 * 10**9


def fixture():
    r = random.Random(2)
    rows = [(i, " ".join(["wör d"] * int(r.paretovariate(1) * 5 % 2000)), r.choice(["hot", "hot", "b", "a", None, "\U0001f600", "￿"]), i) for i in range(1500)]
    return rows + [(2000, None, "a", 1), (2001, " \t\x0b", "empty", 1), (2002, "same row", "a", 1), (2002, "same row", "a", 1), (None, "no id", "b", 1), (2003, "x", "one", 1)]


@pytest.mark.parametrize(("limit", "docs", "groups"), [(200_000, 1000, 1024), (0, 100, 2)])
def test_report_and_rows(spark, monkeypatch, limit, docs, groups):
    """Also where sources are shuffled, edges are dealt over several levels, and sources split in groups."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    monkeypatch.setattr(mixing, "EDGE_DOCS", docs)
    monkeypatch.setattr(mixing, "EDGE_DEALT", docs // 6 + 1)
    monkeypatch.setattr(mixing, "GROUPS", groups)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500 if limit else 2000)
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)
    got = mixing.mixing_report(df).collect()
    assert len(got) == len(rows)
    size = {row: len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")) for row in rows}
    by = defaultdict(int)
    for row in rows:
        by[row[2]] += size[row]
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(names, plain_targets([by[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(by.values())), strict=True))
    source = {row[0]: row[2] for row in rows}
    taken = Counter()
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == by[s] and x.target == pytest.approx(want[s])
        assert 0 <= x.taken <= 2 * x["size"] and (x["size"] == 0 or x.taken % x["size"] == 0)
        taken[s] += x.taken
    for s in names:
        assert taken[s] == pytest.approx(want[s], abs=20), s
    again = mixing.mixing_report(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mix(df, with_shard=True).collect()
    counts = Counter(x.doc_id for x in out)
    assert all(counts[x.doc_id] * x["size"] == x.taken for x in got if x.doc_id != 2002 and x["size"])
    assert len({x.shard for x in out}) == mixing.SHARDS and mixing.mix(df).columns == df.columns


def test_the_draw_equals_a_plain_version(spark, monkeypatch):
    """From the plan's quotas and splits, documents are dealt to blocks, draws and shards one by one."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    monkeypatch.setattr(mixing, "EDGE_DOCS", 40)
    monkeypatch.setattr(mixing, "EDGE_DEALT", 8)
    df = spark.createDataFrame(fixture(), "doc_id long, text string, source string, n long").drop("n")
    sized = df.select("doc_id", *mixing._sized(df, "doc_id", "text", "source"))
    plan = {x.source: x for x in mixing.plan_sources(sized.select(*mixing.SIZED))[0].collect()}
    assert max(len(p.edge) for p in plan.values() if p.edge) >= 1
    numbers = sized.join(mixing.plan_sources(sized.select(*mixing.SIZED))[0].withColumnRenamed("source", "p"), on=None, how="cross").where("source <=> p").select("doc_id", "source", "size", mixing._number(sized["key"], mixing.F.col("at"), mixing.F.col("blocks")).alias("number")).collect()
    shards = {}
    for s, p in plan.items():  # draw by draw
        shard_of = [k for k, (a, b) in enumerate(zip([0, *p.ends], p.ends, strict=False)) for _ in range(b - a)]
        assert len(shard_of) == p.quota == p.ends[-1]
        for draw, shard in enumerate(shard_of):
            shards.setdefault((s, draw % p.blocks), []).append(shard)
    got = {}
    for x in mixing.mixing_report(df).collect():
        got[x.doc_id] = x
    for x in numbers:
        want = shards.get((x.source, x.number), []) if x["size"] else []
        p = plan[x.source]
        edge = p["first"] is not None and p["first"] <= x.number < p.last
        have = [int(s) for s in got[x.doc_id].shards.split(",") if s]
        assert have == want or edge and have == want[:-1], x
        assert len(set(got[x.doc_id].orders.split(","))) == max(1, len(have))
    assert mixing._number.__doc__ and all(len({(a * b + c) % 64 for a in range(64)}) == 64 for b in (1, 77, 4097) for c in (0, 5))  # an odd factor permutes


def test_names_that_the_operator_uses_itself(spark):
    rows = [(i, f"some words {i}", "ab"[i % 2], i, "x", i + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key string, shards long")
    df = df.withColumns({n: mixing.F.lit(n) for n in ("at", "row", "number", "edge", "target", "first", "last", "copy", "shard", "__size", "__key")})
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert all(x["size"] == x.doc_id and x.key == "x" and x["at"] == "at" and x.shards == x.doc_id + 1 and x["__size"] == "__size" for x in out.collect())
    assert mixing.mixing_report(df).count() == 300


def test_shards_are_written_in_their_own_order(spark, tmp_path):
    df = spark.createDataFrame(fixture(), "doc_id long, text string, source string, size long")
    mixing.write_shards(df, str(tmp_path / "mix"), shards=5)
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert {x.shard for x in back.select("shard").collect()} == set(range(5))
    want = Counter((x.doc_id, x.shard) for x in mixing.mix(df, with_shard=True, shards=5).collect())
    assert Counter((x.doc_id, x.shard) for x in back.collect()) == want
    words = Counter()
    for x in back.collect():
        words[x.shard] += len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
    assert min(words.values()) > 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixing_report(df).count() == 0 and mixing.mix(df).count() == 0
