"""python -m vexel.cli bench --n 10000 --dim 64 --k 10: build, search and recall of the approximate methods.

python -m vexel.cli kernels --n 100000 --dims 64 768: vector functions as expressions, and scores by matrix products.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vexel.functions import vectors as V
from vexel.operators.graph import GraphIndex
from vexel.operators.ivf import IvfIndex
from vexel.operators.search import knn_join
from vexel.plans.metrics import Stopwatch, mean_recall, peak_memory_gb
from vexel.plans.storage import materialise, shared_path
from vexel.schema import METRICS, Config, vector_table
from vexel.sources import files

SWEEP = (10, 50, 100, 200, 500)
DIMS = (64, 256, 768)
#: Added to a query's number for its seed.
QUERY_SEED = 999_999


def bench(spark: SparkSession, args: argparse.Namespace) -> list[tuple]:
    """Rows of (method, setting, build s, ms per query, recall)."""
    files.register(spark)
    if args.embeddings:
        rows = spark.read.format("npy").load(args.embeddings).limit(args.n)
    else:
        rows = files.generate(spark, args.n, args.dim)
    table = materialise(vector_table(rows), "bench")
    if args.queries:
        asked = spark.read.format("npy").load(args.queries)
    else:
        asked = files.generate(spark, 100, args.dim if not args.embeddings else len(table.first().embedding), QUERY_SEED)
    queries = materialise(asked.select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("v")), "bench-queries")
    n, watch, out = queries.count(), Stopwatch(), []
    with watch.timed("exact"):
        truth = materialise(knn_join(queries, table, args.k), "bench-truth")
    out.append(("exact", "", 0.0, 1000 * watch.seconds["exact"] / n, 1.0))
    for method in args.methods:
        with watch.timed(method):
            if method == "ivf":
                index = IvfIndex.build(table, shared_path(spark, "ivf"), args.cells)
                settings = [p for p in (1, 2, 4, 8, 12, 16, 32) if p <= args.cells]
                search = lambda p: index.knn_join(queries, args.k, p)
            else:
                graph = GraphIndex.build(table, Config())
                settings = list(args.sweep)
                search = lambda ef: graph.search(queries, args.k, ef)
        for x in settings:
            with watch.timed(f"{method} {x}"):
                found = materialise(search(x), "bench-found")
            recall = mean_recall(found, truth, args.k).first().recall
            out.append((method, x, watch.seconds[method], 1000 * watch.seconds[f"{method} {x}"] / n, recall))
    return out


def kernels(spark: SparkSession, args: argparse.Namespace) -> list[tuple]:
    """Rows of (kernel, dim, pairs per second). Expressions are per row; blocks score 100 queries by matrix products."""
    out = []
    for dim in args.dims:
        rows = materialise(files.generate(spark, args.n, dim), "kernels")
        q = V.vector_literal([float(x) for x in rows.first().embedding])
        vector = F.col("embedding").cast("array<double>")
        for name, score in (("inner_product", V.inner_product(vector, q)), ("cosine", V.cosine_similarity(vector, q)), ("l2_squared", V.l2_squared(vector, q)), ("l2_norm", V.l2_norm(vector))):
            watch = Stopwatch()
            with watch.timed(name):
                rows.agg(F.sum(score)).collect()
            out.append((name, dim, args.n / watch.seconds[name]))
        asked = materialise(files.generate(spark, 100, dim, QUERY_SEED).select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("v")), "kernels-queries")
        table = vector_table(rows, slot="id")
        for metric in METRICS:
            watch = Stopwatch()
            with watch.timed(metric):
                knn_join(asked, table, 10, metric).agg(F.sum("score")).collect()
            out.append((f"blocks {metric}", dim, 100 * args.n / watch.seconds[metric]))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vexel")
    sub = p.add_subparsers(dest="command")
    b = sub.add_parser("bench", help="build time, query time and recall")
    b.add_argument("--embeddings", help="npy file of vectors")
    b.add_argument("--queries", help="npy file of queries")
    b.add_argument("--dim", type=int, default=768)
    b.add_argument("--n", type=int, default=100_000)
    b.add_argument("--k", type=int, default=10)
    b.add_argument("--cells", type=int, default=16)
    b.add_argument("--methods", nargs="*", default=["ivf", "graph"], choices=["ivf", "graph"])
    b.add_argument("--sweep", nargs="*", type=int, default=list(SWEEP))
    c = sub.add_parser("kernels", help="pairs per second of the vector functions")
    c.add_argument("--n", type=int, default=100_000)
    c.add_argument("--dims", nargs="*", type=int, default=list(DIMS))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command is None:
        p.print_help()
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "kernels":
        print("| kernel | dim | pairs/s |\n|---|---|---|")
        for name, dim, rate in kernels(spark, args):
            print(f"| {name} | {dim} | {rate:.0f} |")
        return 0
    print("| method | setting | build (s) | query (ms) | queries/s | recall@k |\n|---|---|---|---|---|---|")
    for method, x, build, ms, recall in bench(spark, args):
        print(f"| {method} | {x} | {build:.2f} | {ms:.2f} | {1000 / ms:.1f} | {recall:.4f} |")
    print(f"peak driver memory: {peak_memory_gb():.2f} GB")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
