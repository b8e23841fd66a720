import random
import time

import numpy as np

from vexel.llm import lm_scoring as lm


def network(seed=1):
    rng = np.random.default_rng(seed)
    p = lm.fresh(rng.integers(0, 50, lm.VOCABULARY).astype(float))
    return {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in p.items()}


def brute(p, ids):
    """Sum of conditional log-probabilities, one token at a time, in double precision."""
    q = {k: v.astype(float) for k, v in p.items()}
    total = 0.0
    for i, t in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else lm.PAD for j in range(i - lm.SIDE, i + lm.SIDE + 1) if j != i]
        h = np.tanh(np.concatenate([q["E"][a] for a in around]) @ q["W"] + q["b"])
        k, m = t % lm.CLASSES, t // lm.CLASSES
        a, b = h @ q["A"] + q["a"], h @ q["B"][k] + q["c"][k]
        total += a[k] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())
    return total


def test_probabilities():
    p = network()
    context = np.tile(np.array([[5, 9, lm.PAD, 77]]), (lm.VOCABULARY, 1))
    assert abs(np.exp(lm.log_probs(p, context, np.arange(lm.VOCABULARY))).sum() - 1) < 1e-4


def test_wide_logits_stay_finite():
    p = network()
    p["B"] *= 200
    context = np.tile(np.array([[5, 9, lm.PAD, 77]]), (lm.VOCABULARY, 1))
    found = lm.log_probs(p, context, np.arange(lm.VOCABULARY))
    assert np.isfinite(found).all() and abs(np.exp(found).sum() - 1) < 1e-3


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in network().items()}
    rng = np.random.default_rng(4)
    context, target = rng.integers(0, lm.VOCABULARY + 1, (20, 4)), rng.integers(0, lm.VOCABULARY, 20)
    g = lm.gradients(p, context, target)
    for k in p:
        hot = np.unravel_index(np.argsort(-np.abs(g[k]), axis=None)[:3], g[k].shape)
        for at in zip(*hot, strict=True):
            e = 1e-5
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += e
            down[k][at] -= e
            slope = -(lm.log_probs(up, context, target).mean() - lm.log_probs(down, context, target).mean()) / (2 * e)
            assert abs(slope - g[k][at]) < 1e-4 * max(1, abs(slope)), (k, at)


def test_hashes_follow_the_pattern_and_are_cheap(spark, monkeypatch):
    """Tokens are cut as TOKEN cuts them, equal ones alone have equal hashes, and hashing takes less time than TOKEN alone."""
    r = random.Random(1)
    some = [lambda: r.randrange(128), lambda: r.randrange(0x3000), lambda: r.randrange(0x110000), lambda: r.choice(" \n\x1c\u03a3\u0130\ud800_.")]
    texts = ["".join(c if isinstance(c := r.choice(some)(), str) else chr(c) for _ in range(r.randrange(300))) for _ in range(1000)] + [None, "", "x" * 1000, " " * 500]
    with monkeypatch.context() as m:
        m.setattr(lm, "CHARS", 64)
        counts, found = lm.token_hashes(texts)
    want = [lm.tokens_of(t) for t in texts]
    assert counts.tolist() == [len(x) for x in want] and len(found) == sum(counts)
    of: dict[str, int] = {}
    assert all(of.setdefault(w, h) == h for w, h in zip((w for x in want for w in x), found.tolist(), strict=True))
    assert len(set(of.values())) == len(of) > 10_000
    assert all(int(lm.hashed(w)[0]) == h for w, h in list(of.items())[:200])
    docs = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] * 4
    begun = time.process_time()
    n = sum(len(lm.tokens_of(t)) for t in docs)
    between = time.process_time()
    assert lm.token_hashes(docs)[0].sum() == n
    assert time.process_time() - between < between - begun


def test_ids_and_contexts_of_many_texts():
    rng = np.random.default_rng(5)
    words, rest = np.split(rng.integers(0, 1 << 64, 3000, np.uint64), [lm.VOCABULARY - lm.BUCKETS])
    place = {int(w): i for i, w in enumerate(words)}
    got = lm.Ids(words.tolist()).of(np.concatenate([rest, words, rest]))
    assert got.tolist() == [place.get(int(h), lm.VOCABULARY - lm.BUCKETS + int(h) % lm.BUCKETS) for h in (*rest, *words, *rest)]
    counts = np.array([0, 1, 5, 0, 2, 0])
    ends = np.cumsum(counts)
    assert lm.contexts_of(got[:8], counts).tolist() == [c for a, z in zip(ends - counts, ends) for c in lm.contexts(got[a:z]).tolist()]


ROWS = [(1, "The cat, the dog."), (1, "The cat, the dog."), (2, None), (3, ""), (4, " \n"), (None, "word"), (5, "alpha beta gamma " * 9000)]


def vocabulary(*words):
    return lm.Ids([int(lm.hashed(w)[0]) for w in words])


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, n_tokens int, k string")
    p, ids = network(), vocabulary("the", "cat", ",", "dog")
    got = lm.score(lm.tokens(df, "doc_id", "text"), ids, p).collect()
    assert len(got) == len(ROWS)
    want = {(d, len(x := ids.of(lm.hashed(t)))): brute(p, x.tolist()) for d, t in ROWS}
    for r in got:
        w = want[r.k, r.n_tokens]
        assert abs(r.log_likelihood - w) <= 1e-4 * max(1, abs(w))
        assert (r.mean_log_prob is None) == (r.n_tokens == 0)
    out = lm.score_documents(df)
    assert out.columns == ["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"]
    assert out.count() == len(ROWS) and lm.score_documents(df.limit(0)).count() == 0


def test_every_token_is_a_target_once(spark, monkeypatch):
    texts = [None, "", "one", "two words", "a b c d e f g", "x " * 200] * 3
    rows = []
    monkeypatch.setattr(lm, "_round", lambda w, shards, p, turn: (rows.extend((turn, r.row, r.n) for r in w.collect()), p)[1])
    lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sum(n for *_, n in rows) == sum(len(lm.tokens_of(t)) for t in texts) and len({r for _, r, _ in rows}) == len(rows)
    w = lm.windows_of(np.array([4, 5, 6]))
    assert w.tolist() == [[lm.PAD, lm.PAD, 5, 6, 4], [lm.PAD, 4, 6, lm.PAD, 5], [4, 5, lm.PAD, lm.PAD, 6]]


def test_averages_shards(spark, monkeypatch):
    """Many shards are added up as a tree, each by its number of tokens."""
    monkeypatch.setattr(lm, "train", lambda p, w, seed: {k: v + len(w) for k, v in p.items()})
    rows = [(i, i % 7 + 1, np.arange(i % 7 + 1, dtype=np.uint16).tobytes()) for i in range(400)]
    df = spark.createDataFrame(rows, "row long, n long, w binary").repartition(5)
    sizes = {r.s: r.n for r in df.selectExpr("pmod(xxhash64(row), 300) s", "n").groupBy("s").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    p = network()
    got = lm._round(df, 300, p, 0)
    shift = sum(n * n for n in sizes.values()) / sum(sizes.values())
    assert len(sizes) > lm.FAN ** 2 // 2 and all(np.allclose(got[k], p[k] + shift, atol=1e-3) for k in p)
    assert lm._round(df.limit(0), 1, p, 0) is p


def test_rare_words_have_their_share(spark):
    ids = vocabulary("the", "cat", ",", "dog")
    code = {w: int(lm.hashed(w)[0]) for w in map("w{}".format, range(5000))}
    first, *others = [w for w, h in code.items() if h % lm.BUCKETS == code["w0"] % lm.BUCKETS]
    assert len({code[w] % lm.SLOTS for w in (first, *others[:2])}) == 3
    signed = lambda w: int(lm.hashed(w).view(np.int64)[0])
    counts = spark.createDataFrame([(signed("the"), 50), (signed(first), 6), (signed(others[0]), 2)], "h long, n long")
    texts = [f"the {first} cat", f"the {others[0]} cat", f"the {others[1]} cat", "the cat", f"{first} {first} {others[0]}", None]
    df = lm.tokens(spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").coalesce(1), "doc_id", "text")
    p = network()
    part = {first: 6 / 9, others[0]: 2 / 9, others[1]: 1 / 9}
    want = sorted((len(x := ids.of(lm.hashed(t))), brute(p, x.tolist()) + sum(np.log(part.get(w, 1)) for w in lm.tokens_of(t))) for t in texts)
    got = sorted((r.n_tokens, r.log_likelihood) for r in lm.score(df, ids, p, lm.shares(counts, ids)).collect())
    assert [n for n, _ in got] == [n for n, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-3)


def test_beats_word_frequencies(spark):
    """On the corpus that it learns from, training gains 0.5 a token at the least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = lm.tokens(docs, "doc_id", "text")
    mean = lambda ids, p: (lambda r: r[0] / r[1])(lm.score(texts, ids, p).selectExpr("sum(log_likelihood)", "sum(n_tokens)").first())
    ids, p, _ = lm.learn_counts(texts, rounds=0)
    before = mean(ids, p)
    ids, p, _ = lm.learn_counts(texts)
    after = mean(ids, p)
    print(before, after)
    assert after > before + 0.5


def test_learns_word_order(spark):
    rnd = random.Random(1)
    subject, verb, thing = ([f"{k}{i}" for i in range(30)] for k in "svo")

    def sentence():
        return f"{rnd.choice(subject)} {rnd.choice(verb)} the {rnd.choice(thing)} ."

    texts = [" ".join(sentence() for _ in range(80)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ids, p = lm.learn(df)
    good = [" ".join(sentence() for _ in range(20)) for _ in range(40)]
    bad = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in good]
    mean = lambda ts: np.mean([lm.log_probs(p, lm.contexts(i), i).mean() for i in (ids.of(lm.hashed(t)) for t in ts)])
    start = lm.fresh(np.ones(lm.VOCABULARY))
    print(mean(good), mean(bad))
    assert mean(good) > mean(bad) + 0.5 and start is not None
    again = lm.learn(df)[1]
    assert all(np.array_equal(p[k], again[k]) for k in p)
