"""Exact search: filtered top-k for one query, and joins of many queries with their nearest rows.

The order is always score descending, then slot ascending; with the l2 metric the score is the negative squared
distance, and ``distance`` its opposite.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators import blocks
from vexel.plans.predicate import compile_where
from vexel.schema import check_k, check_metric, check_query

#: Queries up to which the expression join broadcasts them (at 1,024 dimensions some 80 MB), and pairs that it scores and
#: sorts (some 3 microseconds each); beyond either, blocks are used.
BROADCAST_QUERIES, EXPRESSION_PAIRS = 10_000, 5_000_000
#: How many times k hits a post-filtered search looks at.
OVERFETCH = 4


def score_column(vector: Column, query: Column, metric: str) -> Column:
    return V.cosine_similarity(vector, query) if check_metric(metric) == "cosine" else -V.l2_squared(vector, query)


def live(table: DataFrame) -> DataFrame:
    return table.where(~F.col("deleted")) if "deleted" in table.columns else table


def knn(
    table: DataFrame,
    query: Sequence[float],
    k: int = 10,
    where: dict | None = None,
    metric: str = "cosine",
    mode: str = "prefilter",
    predicate: Callable[[str], bool] | Column | None = None,
    dim: int | None = None,
) -> DataFrame:
    """The k nearest live rows: slot, id, score, metadata, nearest first.

    The plan is a filtered scan and one TakeOrderedAndProject: each task keeps k rows. Ranking reads slot and embedding
    (and what the filter needs); predicate is a Column, or a function of the metadata text that runs in Arrow batches.
    mode "postfilter" ranks OVERFETCH * k rows first and filters those, so it may return fewer than k.
    """
    k, values = check_k(k), check_query(query, dim)
    if mode not in ("prefilter", "postfilter"):
        raise ValueError("mode must be prefilter or postfilter")
    tests = [c for c in (compile_where(where, F.col("metadata")), _predicate(predicate)) if c is not None]
    rows = live(table)
    if mode == "prefilter":
        for c in tests:
            rows = rows.where(c)
    scored = rows.select("slot", "id", score_column(F.col("embedding"), V.vector_literal(values), metric).alias("score"), "metadata")
    best = scored.orderBy(F.desc("score"), "slot")
    if mode == "prefilter" or not tests:
        return best.limit(k)
    near = best.limit(OVERFETCH * k)
    for c in tests:
        near = near.where(c)
    return near.orderBy(F.desc("score"), "slot").limit(k)


def _predicate(predicate: Callable[[str], bool] | Column | None) -> Column | None:
    if predicate is None or isinstance(predicate, Column):
        return predicate
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([bool(predicate(t)) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean")(F.col("metadata"))


def knn_join(queries: DataFrame, table: DataFrame, k: int = 10, metric: str = "cosine", where: dict | None = None, method: str = "blocks") -> DataFrame:
    """qid, rank, slot, id, score of the k nearest live rows of every query (qid, v).

    "blocks" streams the rows past the queries and multiplies matrices; "expression" is a broadcast join of column
    expressions, for few pairs and readable plans. Every row meets every query in both, and they give the same hits.
    """
    k = check_k(k)
    check_metric(metric)
    test = compile_where(where, F.col("metadata"))
    rows = live(table) if test is None else live(table).where(test)
    rows = rows.select("slot", "id", F.col("embedding").alias("v"))
    n = queries.limit(BROADCAST_QUERIES + 1).count() if method == "expression" else None
    if n is not None and n <= BROADCAST_QUERIES and n * rows.count() <= EXPRESSION_PAIRS:
        pairs = rows.crossJoin(F.broadcast(queries.select("qid", F.col("v").alias("q"))))
        return blocks.ranked(pairs.select("qid", "slot", "id", score_column(F.col("v"), F.col("q"), metric).alias("score")), k).select("qid", "rank", "slot", "id", "score")
    return blocks.all_topk(rows, queries, k, metric)
