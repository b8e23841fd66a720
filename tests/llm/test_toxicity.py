import itertools
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from vexel.llm import toxicity as tx


def brute(values):
    """Ruzzo-Tompa's definition by recursion: the best segment, then the rest on either side."""

    def best(lo, hi):
        top = max(((sum(values[a:b]), -(b - a), -a, a, b) for a, b in itertools.combinations(range(lo, hi + 1), 2)), default=None)
        if not top or top[0] <= 1e-12:
            return []
        a, b = top[3], top[4]
        return [*best(lo, a), (top[0], a, b - 1), *best(b, hi)]

    return best(0, len(values))


def test_segments_equal_definition():
    rnd = random.Random(5)
    for _ in range(300):
        v = [rnd.choice([-0.5, -0.5, -0.5, rnd.uniform(0.1, 2)]) for _ in range(rnd.randint(0, 25))]
        got = tx.segments([(i, s) for i, s in enumerate(v) if s > 0], 0.5)
        want = brute(v)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want], v
        assert all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = tx.score_documents(docs, labels)
    assert got.count() == docs.count()
    r = got.join(labels, "doc_id").where("held_out").agg(
        F.sum((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count("*").alias("n"),
        F.sum(F.when((F.col("toxic") == 1) & (F.col("predicted") == 1), 1).otherwise(0)).alias("hit"),
        F.sum("toxic").alias("toxic"), F.sum(F.when((F.col("toxic") == 0), F.col("predicted")).otherwise(0)).alias("false"),
    ).first()
    print(r)
    assert r.right / r.n > 0.97 and r.hit / r.toxic > 0.8 and r.false / r.n < 0.01


def test_odd_rows(spark):
    rows = [(i, ("you utter idiot, " if i % 3 == 0 else "plain calm ") + f"word{chr(97 + i % 26)} " * (i % 5), 0.5, "x") for i in range(300)]
    rows += [(1000, None, 1.0, None), (1001, "", 2.0, "a"), (None, "idiot", 3.0, "b"), (1002, "calm " * 50_000 + "idiot", 4.0, "c"), (3, "again", 0.0, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = tx.score_documents(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    none = labels.limit(0)
    assert tx.score_documents(docs, none).count() == len(rows) and tx.score_documents(docs.limit(0), labels).count() == 0
    kept = tx.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_passages(spark):
    m = tx.Model({"=idiot": 6.0, "=scum": 6.0}, 1.5, 0.0, [0.0] * 4)
    docs = spark.createDataFrame([(7, "calm " * 20 + "you idiot and scum here " + "calm " * 20), (8, None)], "doc_id long, text string")
    got = tx.passages_of(docs, m).collect()
    assert [(r.doc_id, r.first, r.last, r.passage) for r in got] == [(7, 21, 23, "idiot and scum")]


def test_scores_equal_brute_force(spark):
    """Weights, extreme-value constants, evidence and score, each from its definition; the fit is where its gradient is 0."""
    rnd = random.Random(9)
    bad, calm = ["idiot", "idiotic", "scum", "vermin", "trash"], [f"w{chr(97 + i)}{chr(97 + j)}rd" for i in range(8) for j in range(8)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        words = [rnd.choice(bad) if rnd.random() < (0.3 if toxic else 0.01) else rnd.choice(calm) for _ in range(rnd.randint(6, 22))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.learn(docs, known)

    seen = [(t.split(), y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    assert len({" ".join(w[:5]) for w, _ in seen}) > 300  # no near copies among them
    has = lambda f, w: any(x == f[1:] if f[0] == "=" else x.startswith(f[1:]) and len(x) >= len(f) - 1 for x in w)
    n1, n0 = sum(y for _, y in seen), sum(1 - y for _, y in seen)
    weights = {}
    for f in {f for w, _ in seen for x in w for f in ["=" + x, *("^" + x[:k] for k in (4, 5, 6) if len(x) >= k)]}:
        y1, y0 = sum(has(f, w) for w, y in seen if y), sum(has(f, w) for w, y in seen if not y)
        prior = 0.5 + 10 * (y1 + y0) / (n1 + n0)
        a, b = y1 + prior, y0 + prior
        odds = math.log(a / (n1 + 2 * prior - y1) / b * (n0 + 2 * prior - y0))
        if y1 >= 3 and odds >= 1 and odds / math.sqrt(1 / a + 1 / b) > 3.3:
            weights[f] = odds
    assert weights and model.weights.keys() == weights.keys() and all(abs(model.weights[f] - x) < 1e-9 for f, x in weights.items())

    score = lambda x: max((s for f, s in weights.items() if has(f, [x])), default=0.0)
    clean = [score(x) for w, y in seen if not y for x in w]
    total, up = len(clean) + 1, [s for s in clean if s > 0]
    excess = sum(math.exp(model.lam * s) for s in up) / total + (len(clean) - len(up)) / total * math.exp(-model.lam * 0.5) - 1
    assert up and abs(excess) < 1e-4
    assert abs(model.log_k - (math.log(len(up) / total) + model.lam * min(up))) < 1e-4

    def evidence(words):
        found = [s for s, _, _ in brute([score(x) or -0.5 for x in words])]
        bits = [model.lam * s - model.log_k - math.log(len(words)) for s in found]
        return [math.log1p(max([0.0, *bits])), math.log1p(sum(x for x in bits if x > -math.log(0.05))), math.log1p(sum(found))]

    x = np.array([[1.0, *evidence(w)] for w, _ in seen])
    p = 1 / (1 + np.exp(-x @ np.array(model.beta)))
    slope = x.T @ (np.array([y for _, y in seen]) - p) - np.array([1e-6, 0.05, 0.05, 0.05]) * model.beta
    assert np.abs(slope).max() < 1e-3
    got = {r.doc_id: r.score for r in tx.score_documents(docs, known).collect()}
    for i, t in rows:
        z = model.beta[0] + float(np.dot(model.beta[1:], evidence(t.split())))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6
