import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from vexel.llm import near_dedup as nd
from vexel.llm.components import components


def weighted(a, b):
    x, y = dict(zip(*map(list, a))), dict(zip(*map(list, b)))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_agreement_is_weighted_similarity():
    rnd = np.random.default_rng(1)
    for n, heavy in ((40, 1), (300, 6), (900, 40)):
        e = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        c = rnd.integers(1, heavy + 1, len(e))
        d = np.where(rnd.random(len(e)) < 0.3, rnd.integers(1, heavy + 2, len(e)), c)
        keep = rnd.random(len(e)) < 0.9
        a, b = (e, c), (e[keep], d[keep])
        s = nd.signatures([a, b], 4096)
        assert abs((s[0] == s[1]).mean() - weighted(a, b)) < 0.035
        assert abs(nd.similarity(a, b) - weighted(a, b)) < 1e-12
        # together or alone, with a lower or higher first limit, the signature is the same
        assert (nd.signatures([b], 64) == nd.signatures([a, b], 64)[1:]).all()
        assert (nd.signatures([b], 64, slack=-2) == nd.signatures([b], 64)).all()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300 - i, 300) for i in range(1, 50)] + [(rnd.randint(400, 460), rnd.randint(400, 460)) for _ in range(45)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    groups, mine = defaultdict(set), defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    for x, y in got.items():
        mine[y].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def brute(data):
    sets = [nd.shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(data)), 2):
        if len(sets[i][0]) and len(sets[j][0]) and nd.similarity(sets[i], sets[j]) >= 0.8:
            parent[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(data)):
        out[find(i)].append(data[i][0])
    return sorted(sorted(x, key=lambda d: (d is None, d or 0)) for x in out.values())


def test_classes_equal_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: "w" + str(rnd.randint(0, 10**6))

    def edit(words, n):
        words = list(words)
        for _ in range(n):
            words[rnd.randrange(len(words))] = word()
        return words

    data, at = [], 0
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(30, 200))]
        for _ in range(rnd.randint(1, 5)):
            data.append((at, " ".join(edit(base, rnd.randint(0, 3)))))
            at += 1
    hot = [word() for _ in range(150)]
    for _ in range(120):  # one large group
        data.append((at, " ".join(edit(hot, rnd.randint(0, 2)))))
        at += 1
    line = " ".join(word() for _ in range(20))
    for _ in range(60):  # a passage that many share
        data.append((at, line + " " + " ".join(word() for _ in range(60))))
        at += 1
    data += [(5000, None), (5001, ""), (5002, "!!"), (5003, "Two words"), (5004, "two  words."), (None, "two words"), (5005, "rep " * 20_000), (5006, "rep " * 19_000), (3, data[3][1]), (3, data[3][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, class_id string, links int")
    rows = nd.near_dedup(df.repartition(4)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.class_id, r.class_size].append(r)
    want = brute(data)
    none = [[5000], [5001], [5002]]
    mine = Counter()
    for r in rows:
        mine[r.class_id] += 1
    assert len(rows) == len(data) and sum(r.kept for r in rows) == len(want)
    expect = {}
    for g in want:
        for d in g:
            expect.setdefault(d, []).append(min(x for x in g if x is not None))
    for r in rows:
        assert r.class_id in expect[r.doc_id], r
    assert all(x in want for x in none)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(want)
    assert nd.near_dedup(df.limit(0)).count() == 0 and nd.keep_one(df.limit(0)).count() == 0


def test_large_families_equal_brute_force(spark):
    rnd = random.Random(11)
    word = lambda: "w" + str(rnd.randint(0, 10**6))
    data = []
    for _ in range(12):  # varied texts, mostly under 0.8 to each other and to leaders
        base = [word() for _ in range(200)]
        for _ in range(60):
            words = list(base)
            for _ in range(rnd.randint(2, 7)):
                words[rnd.randrange(len(words))] = word()
            data.append((len(data), " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = defaultdict(list)
    for r in nd.near_dedup(df).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(x) for x in got.values()) == brute(data)


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = defaultdict(list)
    for r in nd.near_dedup(docs).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(x) for x in got.values()) == brute(data)


def test_no_partial_count_of_links(spark):
    df = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert nd.near_dedup(df).columns == ["doc_id", "class_id", "class_size", "kept"]


def test_one_family_loses_no_link(spark):
    """400 texts of 200 words with 1 to 6 words of one base replaced: many are under 0.8 to most of the family."""
    rnd = random.Random(5)
    word = lambda: "w" + str(rnd.randint(0, 10**7))
    base = [word() for _ in range(200)]
    data = []
    for i in range(400):
        words = list(base)
        for at in rnd.sample(range(200), rnd.randint(1, 6)):
            words[at] = word()
        data.append((i, " ".join(words)))
    got = defaultdict(list)
    for r in nd.near_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect():
        got[r.class_id].append(r.doc_id)
    want = brute(data)
    assert len(want) > 50 and sorted(sorted(x) for x in got.values()) == want


def test_tiles_of_any_size_give_the_same(spark, monkeypatch):
    """A bucket that is cut into many tiles joins the same classes as one in a single tile."""
    rnd = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([np.arange(40, dtype=np.uint64), rnd.integers(100, 10**6, rnd.integers(2, 14)).astype(np.uint64)])) for _ in range(90)]
    buckets = spark.createDataFrame([(1, i, len(s), 90) for i, s in enumerate(sets)], "band long, node long, weight long, m long")
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "node long, label long")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, e binary")

    def joined():
        got = components(nd.tile_links(nd.open_tiles(buckets, labels), table, 0.8)).collect()
        return sorted(r.node for r in got)

    label = np.array([0] * 60 + list(range(60, 90)))
    want = {v for i, j in itertools.combinations(range(90), 2) if label[i] != label[j] and len(b := np.intersect1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j]) - len(b)) >= 0.8 for v in (label[i], label[j])}
    assert 5 < len(want) < 31
    for size in (256, 7, 1):
        monkeypatch.setattr(nd, "TILE", size)
        assert joined() == sorted(want)
