import random
from collections import defaultdict

import xxhash

from voxtally.llm import simhash
from voxtally.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def plain_groups(points):
    """Smallest point of each group, all pairs compared."""
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    points = sorted(points)
    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {p: find(p) for p in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)] + [(300, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_links_keep_every_group(spark, monkeypatch):
    r = random.Random(8)
    points = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(12):
            centre ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
            points.add(centre)
    swarm = r.getrandbits(64)
    points |= {swarm ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(90)}
    want = plain_groups(points)
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    for small, broadcast in ((256, 500_000), (20, 0), (2, 500_000)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", broadcast)
        found = simhash.links(df).collect()
        root = {p: p for p in points}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            a, b = a % (1 << 64), b % (1 << 64)
            assert a != b and (a ^ b).bit_count() <= 4
            low, high = sorted((find(a), find(b)))
            root[high] = low
        assert {p: find(p) for p in points} == want


def test_documents(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows = [(1, None, "x"), (7, "", "x"), (2, " \t\n", "x"), (3, "One", "x"), (4, "one", "x"), (None, "only here twice", "x"), (None, "only here twice", "x"), (None, "one", "x"), (9, "same row again", "x"), (9, "same row again", "x"), (9, "other text, same id", "x")]
    for i in range(20):
        words = [word() for _ in range(r.randint(3, 200))]
        for j in range(r.randint(1, 4)):
            rows.append((20 + 5 * i + j, " ".join(words), "y"))
            words[r.randrange(len(words))] = word()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    prints = {row: plain_fingerprint(row[1]) for row in rows}
    groups = plain_groups(set(prints.values()))
    members = defaultdict(list)
    for row in rows:
        members[groups[prints[row]]].append(row)
    want = sorted(((row[0], f"{prints[row]:016x}", min((m[0] for m in members[groups[prints[row]]] if m[0] is not None), default=None)) for row in rows), key=str)
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()), key=str) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    kept = [tuple(x) for x in kept.collect()]
    assert len(kept) == len(members) and set(kept) <= set(rows)
    assert {k[0] for k in kept} == {min((m[0] for m in ms if m[0] is not None), default=None) for ms in members.values()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0
