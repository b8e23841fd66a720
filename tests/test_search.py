import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import graph
from vexel.operators.graph import GraphIndex
from vexel.operators.ivf import IvfIndex
from vexel.operators.search import knn, knn_join
from vexel.operators import lifecycle
from vexel.plans.metrics import Stopwatch, latency_summary, mean_recall, peak_memory_gb
from vexel.plans.storage import materialise
from vexel.schema import Config, vector_table
from vexel.sources.files import generate


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    meta = F.to_json(F.struct((2018 + i % 7).alias("year"), (F.lit(0.1) * (i % 10)).alias("score")))
    return materialise(vector_table(generate(spark, 600, 32).withColumn("metadata", meta), 32), "test")


def truth(table, q, k, keep=lambda r: True):
    rows = [r for r in table.collect() if not r.deleted and keep(r)]
    x = np.array([r.embedding for r in rows], float)
    s = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    o = np.lexsort(([r.slot for r in rows], -s))[:k]
    return [rows[i].slot for i in o]


def query(seed=5, dim=32):
    return np.random.default_rng(seed).standard_normal(dim)


def test_knn(spark, table):
    q = query()
    got = knn(table, q, 10)
    assert [r.slot for r in got.collect()] == truth(table, q, 10)
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()
    where = {"year": {"$gte": 2021}, "score": {"$lt": 0.5}}
    keep = lambda r: json.loads(r.metadata)["year"] >= 2021 and json.loads(r.metadata)["score"] < 0.5
    assert [r.slot for r in knn(table, q, 7, where).collect()] == truth(table, q, 7, keep)
    post = [r.slot for r in knn(table, q, 7, where, mode="postfilter").collect()]
    near = truth(table, q, 28)
    rows = {r.slot: r for r in table.collect()}
    assert post == [s for s in near if keep(rows[s])][:7]
    assert [r.slot for r in knn(table, q, 5, predicate=lambda m: "2019" in m).collect()] == truth(table, q, 5, lambda r: "2019" in r.metadata)
    assert [r.slot for r in knn(table, q, 5, predicate=F.col("id") < 50).collect()] == truth(table, q, 5, lambda r: r.id < 50)
    assert knn(table, q, 0).count() == 0 and knn(table, q, 5000).count() == 600
    l2 = [r.slot for r in knn(table, q, 9, metric="l2").collect()]
    x = np.array([r.embedding for r in table.orderBy("slot").collect()], float)
    assert l2 == np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:9].tolist()
    for bad in ({"k": -1}, {"mode": "other"}, {"metric": "dot"}, {"dim": 7}):
        with pytest.raises(ValueError):
            knn(table, q, **({"k": 3} | bad)).collect()


def test_ties_and_zero_vectors(spark):
    rows = [(5, [1.0, 0.0]), (4, [2.0, 0.0]), (3, [0.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.0])]
    t = vector_table(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, id long, embedding array<double>"), order="n")
    got = [(r.slot, r.id, r.score) for r in knn(t, [1.0, 0.0], 5).collect()]
    assert got == [(0, 5, 1.0), (1, 4, 1.0), (4, 5, 1.0), (2, 3, 0.0), (3, 2, 0.0)]
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "qid long, v array<double>")
    for method in ("blocks", "expression"):
        out = knn_join(q, t, 3, method=method).orderBy("qid", "rank").collect()
        assert [(r.qid, r.slot) for r in out] == [(7, 0), (7, 1), (7, 4), (8, 0), (8, 1), (8, 2)]


def test_bad_dimension_fails(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="hasn't 2 dimensions"):
        vector_table(rows, 2).collect()


def queries_of(spark, n=40):
    return materialise(generate(spark, n, 32, 777).select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("v")), "test-q")


def test_joins_agree(spark, table):
    q = queries_of(spark)
    a, b = (sorted((r.qid, r["rank"], r.slot) for r in knn_join(q, table, 5, method=m).collect()) for m in ("blocks", "expression"))
    assert a == b and len(a) == 200
    l2 = [sorted((r.qid, r["rank"], r.slot) for r in knn_join(q, table, 4, "l2", method=m).collect()) for m in ("blocks", "expression")]
    assert l2[0] == l2[1]
    assert knn_join(q, table, 0).count() == 0
    plan = knn_join(q, table, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cells(spark, table, tmp_path):
    q = queries_of(spark)
    index = IvfIndex.build(table, f"file://{tmp_path}/ivf", 8)
    exact = materialise(knn_join(q, table, 10), "test-truth")
    assert mean_recall(index.knn_join(q, 10, 8), exact, 10).first().recall == 1.0
    assert mean_recall(index.knn_join(q, 10, 7), exact, 10).first().recall > 0.9
    again = IvfIndex.open(spark, f"file://{tmp_path}/ivf")
    v = query()
    assert [r.slot for r in again.search(v, 10, 8).collect()] == truth(table, v, 10)
    plan = again.search(v, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    few = again.search(v, 5, 8, {"year": 2020})
    assert [r.slot for r in few.collect()] == truth(table, v, 5, lambda r: json.loads(r.metadata)["year"] == 2020)


def test_graph(spark, table):
    gone = lifecycle.delete(table, table.where("id % 10 = 0").select("id"))
    q = queries_of(spark, 25)
    for t, least in ((table, 0.9), (gone, 0.85)):
        g = GraphIndex.build(t, Config(M=10))
        hits = materialise(g.search(q, 10, ef=80), "test-hits")
        assert mean_recall(hits, knn_join(q, t, 10), 10).first().recall >= least
        dead = {r.slot for r in t.where("deleted").collect()}
        assert not dead & {r.slot for r in hits.collect()}
    assert g.edges.where("layer = 0").groupBy("src").count().agg({"count": "max"}).first()[0] <= 20
    all_gone = lifecycle.delete(table, table.select("id"))
    assert GraphIndex.build(all_gone, Config(M=10)).search(q, 5).count() == 0
    assert GraphIndex.build(table.limit(0), Config(M=10)).search(q, 5).count() == 0


def test_cells_of_edges(spark):
    """With several cells, most of each node's nearest are found; with all of them visited, they are exact."""
    t = materialise(vector_table(generate(spark, 3000, 16), 16), "test")
    exact = {(r.src, r.dst) for r in graph.nearest_edges(t, 6).collect()}
    some = {(r.src, r.dst) for r in graph.cell_edges(t, 6, breadth=25).collect()}
    assert len(some) == len(exact) == 18_000 and 0.4 < len(some & exact) / len(exact) < 1
    assert {(r.src, r.dst) for r in graph.cell_edges(t, 6, breadth=75).collect()} == exact
    assert graph.cell_edges(t.limit(0), 6).count() == 0


def test_graph_after_the_build(spark, table):
    """More nodes, deletes and filters on a graph that stands."""
    q = queries_of(spark, 25)
    g = GraphIndex.build(table.where("slot % 3 <> 0"), Config(M=10))
    g = g.insert(table.where("slot % 3 = 0"))
    assert g.nodes.count() == 600 and g.edges.where("layer = 0").groupBy("src").count().agg({"count": "max"}).first()[0] <= 20
    assert g.insert(table.limit(0)) is g
    hits = materialise(g.search(q, 10, ef=80), "test-hits")
    assert mean_recall(hits, knn_join(q, table, 10), 10).first().recall >= 0.9
    gone, where = table.where("slot % 4 = 1").select("slot"), {"year": {"$lt": 2022}}
    left = table.join(gone, "slot", "left_anti")
    hits = materialise(g.search(q, 10, ef=200, gone=gone, where=where), "test-hits")
    assert mean_recall(hits, knn_join(q, left, 10, where=where), 10).first().recall >= 0.9
    bad = {r.slot for r in gone.collect()} | {r.slot for r in table.collect() if json.loads(r.metadata)["year"] >= 2022}
    assert not bad & {r.slot for r in hits.collect()}
    first = GraphIndex.build(table.limit(0), Config(M=10)).insert(table)
    assert mean_recall(first.search(q, 10, ef=80), knn_join(q, table, 10), 10).first().recall >= 0.9


def test_measures(spark):
    w = Stopwatch(clock=iter([1.0, 3.5]).__next__)
    with w.timed("a"):
        pass
    assert w.seconds == {"a": 2.5} and peak_memory_gb() > 0
    r = latency_summary(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "ms double")).first()
    assert (r.n, r["mean"], r.p50, r["max"]) == (3, 4.0, 2.0, 9.0)
    for bad in ({"M": 1}, {"ef_search": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
