import itertools
import random
import re
from collections import Counter

import pytest

from vexel.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, size int, copies string"


def test_targets():
    assert mx.targets([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    t = mx.targets([10, 1000, 10])
    assert t == pytest.approx([30, 960, 30]) and sum(t) == pytest.approx(1020)
    assert mx.targets([]) == [] and mx.targets([0, 0]) == [0, 0]
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.choice([0, 1, 5, 100, 10_000]) for _ in range(rnd.randint(1, 9))]
        t = mx.targets(s)
        assert sum(t) == pytest.approx(sum(s)) and all(a <= 3 * b + 1e-9 for a, b in zip(t, s, strict=True))
        free = [(x, mx.WEIGHTS[i % 3]) for i, (x, b) in enumerate(zip(t, s, strict=True)) if x < 3 * b - 1e-9]
        assert len({round(x / w, 6) for x, w in free}) <= 1


def test_knapsack_finds_nearest():
    rnd = random.Random(2)
    for _ in range(300):
        lengths = rnd.sample(range(1, 15), rnd.randint(1, 4))
        counts = [rnd.randint(0, 3) for _ in lengths]
        budget = rnd.randint(0, 40)
        got = mx.knapsack(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        best = min(abs(budget - sum(a * b for a, b in zip(lengths, x, strict=True))) for x in itertools.product(*[range(c + 1) for c in counts]))
        assert abs(budget - sum(a * b for a, b in zip(lengths, got, strict=True))) == best


def test_fill():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = rnd.sample(range(1, 3000), 200)
        counts = [rnd.randint(1, 40) for _ in lengths]
        size = sum(a * b for a, b in zip(lengths, counts, strict=True))
        target = rnd.uniform(0, 3) * size
        copies, extra = mx.fill(lengths, counts, target)
        assert all(0 <= e <= c for e, c in zip(extra, counts, strict=True))
        assert abs(copies * size + sum(a * b for a, b in zip(lengths, extra, strict=True)) - target) <= 1
    copies, extra = mx.fill([30_000, 7, 3], [1, 500, 600], 31_000)
    assert (copies, 30_000 * extra[0] + 7 * extra[1] + 3 * extra[2]) == (0, 31_000)
    assert mx.fill([1_000_000], [5], 2_400_000) == (0, [2]) and mx.fill([1_000_000], [1], 600_000) == (0, [1]) and mx.fill([0], [4], 0.0) == (0, [0])


def test_remainder_is_met_as_nearly_as_any_sum(monkeypatch):
    """The window grows until the sum is the nearest there is, whatever it begins with."""
    rnd = random.Random(8)
    for width in (4, 1 << 13):
        monkeypatch.setattr(mx, "WINDOW_WORDS", width)
        for _ in range(150):
            lengths = [x * rnd.choice([1, 6]) for x in rnd.sample(range(1, 40), rnd.randint(1, 4))]
            lengths = list(dict.fromkeys(lengths))
            counts = [rnd.randint(0, 3) for _ in lengths]
            rest = rnd.randint(0, 200)
            got = mx._approach(lengths, counts, rest)
            assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
            best = min(abs(rest - sum(a * b for a, b in zip(lengths, x, strict=True))) for x in itertools.product(*[range(c + 1) for c in counts]))
            assert abs(rest - sum(a * b for a, b in zip(lengths, got, strict=True))) == best
    # far more than one window: 7 * 999,999 + 12 * 10,007 is met to the word
    got = mx._approach([999_999, 10_007, 5_003], [7, 12, 2], 7_120_077)
    assert 999_999 * got[0] + 10_007 * got[1] + 5_003 * got[2] == 7_120_077


def rows():
    rnd = random.Random(4)
    out = [(i, " ".join(["w"] * rnd.randint(1, 60)), rnd.choice(["a", "a", "a", "B", "é", None]), 1, "x") for i in range(900)]
    out += [(2000 + i, "same size text", "a", 1, "x") for i in range(400)]
    return out + [(5000, None, "a", 1, None), (5001, "", None, 1, "x"), (None, "two words", "B", 1, "x"), (7, "dup  row\there", "a", 1, "x"), (7, "dup  row\there", "a", 1, "x"), (5002, "x " * 3_000, "B", 1, "x"), (5004, "x " * 30_000, "zz", 1, "x"), (5003, "\u00a0 \x1c", "zero", 1, "x")]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = mx.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size(t)) for d, t, *_ in data)
    by = Counter()
    for _, t, s, *_ in data:
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, mx.targets([by[s] for s in order]), strict=True))
    src = {d: s for d, _, s, *_ in data}
    taken = Counter()
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(goal[s]) and r.taken <= 3 * r["size"]
        assert r.taken == 0 if not r["size"] else r.taken % r["size"] == 0
        taken[s] += r.taken
    for s in order:
        if s == "zz":  # one long document: whole copies are all there is
            assert abs(taken[s] - goal[s]) <= 15_000
        else:
            assert abs(taken[s] - goal[s]) <= 1, (s, taken[s], goal[s])
    again = mx.mix(df.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    out = mx.take(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += size(r.text)
    assert words == +taken
    assert mx.mix(df.limit(0)).count() == 0 and mx.take(df.limit(0)).count() == 0
