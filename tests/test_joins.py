"""The exact join and the graph where the table is cut: tiles, groups of queries, shares of files, segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import blocks, graph, search
from vexel.operators.blocks import Nearest, Rows
from vexel.operators.graph import GraphIndex
from vexel.operators.search import knn_join
from vexel.plans.metrics import mean_recall
from vexel.plans.storage import materialise
from vexel.schema import Config, vector_table
from vexel.sources.files import generate


def brute(q, x, slots, k, metric, keys=None):
    out = []
    for i, v in enumerate(q.astype(float)):
        d = x.astype(float)
        if metric == "l2":
            s = -np.cumsum((v - d) ** 2, axis=1)[:, -1]
        else:
            scale = np.sqrt(np.cumsum(v * v)[-1]) * np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
            s = np.where(scale < 1e-12, 0, np.cumsum(v * d, axis=1)[:, -1] / np.where(scale < 1e-12, 1, scale))
        o = [j for j in np.lexsort((slots, -s)) if keys is None or slots[j] != keys[i]][:k]
        out.append([(int(slots[j]), float(s[j])) for j in o])
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("own", [False, True])
def test_nearest_by_tiles(metric, own, monkeypatch):
    """Copies, near copies closer than single precision tells, zero and tiny vectors, more hits asked for than there are."""
    monkeypatch.setattr(blocks, "ROW_TILE", 37)
    monkeypatch.setattr(blocks, "QUERY_TILE", 16)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    x[50:120] = x[7]
    x[120:160] = x[7] * (1 + 1e-7 * rng.standard_normal((40, 12)))
    x[160:163], x[163:166] = 0, 1e-8 * x[163:166]
    slots = rng.permutation(400).astype(np.int64)
    q, keys = np.concatenate([x[:60], x[155:170]]), np.concatenate([slots[:60], slots[155:170]])
    for k in (1, 10, 500):
        n = Nearest(q, k, metric, keys if own else None)
        for a in range(0, 400, 150):
            n.offer(Rows(x[a : a + 150], slots[a : a + 150], slots[a : a + 150], metric))
        hits, want = n.hits(np.arange(len(q))).to_pylist(), brute(q, x, slots, k, metric, keys if own else None)
        got = [[] for _ in q]
        for r in hits:
            assert r["rank"] == len(got[r["qid"]]) + 1 and r["id"] == r["slot"]
            got[r["qid"]].append((r["slot"], r["score"]))
        assert got == want


def test_product_memory():
    """Scores at once are those of a tile, whatever a block holds (8,000,000 before)."""
    assert blocks.QUERY_TILE * blocks.ROW_TILE * 4 <= 8 << 20


def test_no_table_is_dealt(spark):
    """Every row meets every query, and no row is shuffled for that (all queries were sent to every block before)."""
    t = materialise(vector_table(generate(spark, 5000, 16), 16), "test")
    edges = graph.nearest_edges(t, 5)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the queries, once
    x = {r.slot: np.array(r.embedding, float) for r in t.collect()}
    m = np.array([x[i] for i in range(5000)])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, -2)
    assert {(r.src, r.dst) for r in edges.collect()} == {(i, int(j)) for i in range(5000) for j in np.argsort(-s[i], kind="stable")[:5]}


def test_expression_join_goes_over_to_blocks(spark, monkeypatch):
    """By pairs, not only by queries: a large table isn't crossed and sorted."""
    t = materialise(vector_table(generate(spark, 300, 8), 8), "test")
    q = generate(spark, 20, 8, 99).select(F.col("id").alias("qid"), F.col("embedding").alias("v"))
    small = knn_join(q, t, 4, method="expression")
    monkeypatch.setattr(search, "EXPRESSION_PAIRS", 5999)
    large = knn_join(q, t, 4, method="expression")
    assert "NestedLoop" in small._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_graph_of_segments(spark, monkeypatch, tmp_path):
    """Several segments: recall, inserts, deletes; lists stay inside a segment, and a search makes no table a step."""
    monkeypatch.setattr(graph, "SEGMENT", 300 * 16)
    t = materialise(vector_table(generate(spark, 900, 16), 16), "test")
    q = materialise(generate(spark, 30, 16, 777).select(F.col("id").alias("qid"), F.col("embedding").alias("v")), "test-q")
    g = GraphIndex.build(t.where("slot % 3 <> 0"), Config(M=8)).insert(t.where("slot % 3 = 0"))
    assert g.segments == 2 and g.nodes.count() == 900
    other = g.edges.join(g.nodes.select(F.col("slot").alias("dst"), F.col("segment").alias("to")), "dst")
    assert other.where("segment <> to").count() == 0
    made = []
    monkeypatch.setattr(graph, "materialise", lambda *a, **b: made.append(a[1]) or materialise(*a, **b))
    hits = g.search(q, 10, ef=80).collect()
    assert made == []  # at least four tables a step before
    assert mean_recall(spark.createDataFrame(hits), knn_join(q, t, 10), 10).first().recall >= 0.9
    gone = t.where("slot % 2 = 0").select("slot")
    hits = g.search(q, 10, ef=120, gone=gone)
    assert made == ["graph-fit"]
    left = t.where("slot % 2 = 1")
    assert mean_recall(hits, knn_join(q, left, 10), 10).first().recall >= 0.9
    assert hits.where("slot % 2 = 0").count() == 0
    grown = g.insert(vector_table(generate(spark, 600, 16, 5000).withColumn("id", F.col("id") + 900), slot="id"))
    assert grown.segments == 5 and grown.nodes.count() == 1500
