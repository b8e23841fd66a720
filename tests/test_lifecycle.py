import random

import pytest

from vexel.operators import lifecycle as lc
from vexel.schema import VECTORS, numbered, vector_table
from vexel.streaming.oplog import apply_log


def rows_of(t):
    return [(r.slot, r.id, r.deleted) for r in t.orderBy("slot").collect()]


def brute(lines, base=()):
    out = [list(r) for r in base]
    for op, key in lines:
        if op == "insert":
            out.append([len(out), key, False])
        elif op == "delete":
            first = next((r for r in out if r[1] == key), None)
            if first is not None:
                first[2] = True
    return [tuple(r) for r in out]


def log_of(spark, lines, start=0):
    return spark.createDataFrame([(start + i, op, key, [float(key), 1.0] if op == "insert" else None, "{}" if op == "insert" else None) for i, (op, key) in enumerate(lines)], lc.OPLOG)


def some_lines(seed, n=60):
    rnd = random.Random(seed)
    return [(rnd.choice(["insert", "insert", "delete", "other"]), rnd.randint(0, 12)) for _ in range(n)]


def test_replay_equals_walk(spark):
    for seed in range(3):
        lines = some_lines(seed)
        assert rows_of(lc.replay(log_of(spark, lines))) == brute(lines)
    base = vector_table(spark.createDataFrame([(i, i % 4, [1.0, 2.0], i == 1) for i in range(8)], "n int, id long, embedding array<float>, deleted boolean"), order="n")
    lines = some_lines(9)
    assert rows_of(lc.replay(log_of(spark, lines), base)) == brute(lines, [(i, i % 4, i == 1) for i in range(8)])
    assert rows_of(lc.replay(log_of(spark, []))) == []


def test_deletes_and_compact(spark):
    t = vector_table(spark.createDataFrame([(i, i % 5, [1.0]) for i in range(12)], "n int, id long, embedding array<double>"), order="n")
    ids = spark.createDataFrame([(1,), (1,), (99,), (3,)], "id long")
    once = lc.delete(t, ids)
    assert {s for s, _, d in rows_of(once) if d} == {1, 3}
    assert rows_of(lc.delete(once, ids)) == rows_of(once)
    asked = {r.id: r.deleted for r in lc.is_deleted(once, spark.createDataFrame([(1,), (2,), (99,)], "id long")).collect()}
    assert asked == {1: True, 2: False, 99: False}
    assert tuple(lc.sizes(once).first()) == (12, 10)
    small = lc.compact(once)
    assert [(s, i) for s, i, _ in rows_of(small)] == [(n, i % 5) for n, i in enumerate(x for x in range(12) if x not in (1, 3))]


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        lc.load(spark, path)
    t = vector_table(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, embedding array<double>"))
    lc.save(t, path, dim=2)
    old = lc.load(spark, path)
    lc.save(t.where("id < 2"), path, dim=2, checkpoint_seq=7)
    assert lc.load(spark, path, 2).count() == 2 and old.count() == 5 and lc.properties(spark, path)["checkpoint_seq"] == 7
    assert lc.load(spark, path).schema == VECTORS
    with pytest.raises(ValueError):
        lc.load(spark, path, 3)


def test_checkpoints_and_recovery(spark, tmp_path):
    log, snap = f"file://{tmp_path}/log", f"file://{tmp_path}/snap"
    lines = some_lines(4, 90)
    assert rows_of(lc.recover(spark, snap, log)) == []
    for a, b in ((0, 30), (30, 60)):
        lc.append(log_of(spark, lines[a:b], a), log)
        assert rows_of(lc.recover(spark, snap, log)) == brute(lines[:b])
        assert rows_of(lc.checkpoint(spark, snap, log)) == brute(lines[:b])
        assert lc.read_log(spark, log).count() == 0
    lc.append(log_of(spark, lines[60:], 60), log)
    lc.append(log_of(spark, lines[40:60], 40), log)  # left over from before the checkpoint: no longer read
    assert rows_of(lc.recover(spark, snap, log)) == brute(lines)
    assert rows_of(lc.checkpoint(spark, snap, log)) == rows_of(lc.checkpoint(spark, snap, log)) == brute(lines)


def test_stream(spark, tmp_path):
    log, snap, c = (f"file://{tmp_path}/{x}" for x in ("log", "snap", "c"))
    lines, seen = some_lines(6, 80), []
    for a, b in ((0, 30), (30, 50), (50, 80)):
        lc.append(log_of(spark, lines[a:b], a).coalesce(1), log)
        apply_log(spark, log, snap, c, on_insert=lambda d: seen.append(d.count()), on_delete=lambda d: seen.append(d.count())).awaitTermination()
        assert rows_of(lc.load(spark, snap)) == brute(lines[:b])
    assert sum(seen) == sum(op != "other" for op, _ in lines)


def test_numbers_are_dense_in_order(spark):
    rnd = random.Random(2)
    values = [0] * 50 + [rnd.randint(0, 9) for _ in range(200)] + [10**17 + i for i in range(40)] + [-(10**15)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int").repartition(5)
    got = numbered(df, "v", "i", name="n", start=3).orderBy("n").collect()
    assert [(r.v, r.i) for r in got] == sorted((v, i) for i, v in enumerate(values))
    assert [r.n for r in got] == list(range(3, 3 + len(values)))
    assert numbered(df.limit(0), "v").count() == 0
    texts = spark.createDataFrame([(w,) for w in ("b", "a", "é", "", "aa", None, "Z")], "v string").repartition(3)
    assert [r.v for r in numbered(texts, "v").orderBy("slot").collect()] == [None, "", "Z", "a", "aa", "b", "é"]
    one = numbered(spark.createDataFrame([(None,), (None,)], "v long"), "v").collect()
    assert sorted(r.slot for r in one) == [0, 1]


def test_known_slots_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in range(9)], "id long, embedding array<double>")
    t = vector_table(rows, slot="id")
    assert [r.slot for r in t.orderBy("id").collect()] == list(range(9))
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
