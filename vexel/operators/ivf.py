"""Approximate search over clustered cells: k-means cells as a partition column, queries read the nearest few.

The build writes the table partitioned by cell, so a query's cells prune the scan to their folders; nprobe cells of the
centroids nearest to the query are ranked exactly. With nprobe equal to the number of cells the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.functions.vectors import normalize, vector_literal
from vexel.operators import blocks
from vexel.operators.search import live, score_column
from vexel.plans.predicate import compile_where
from vexel.schema import VECTORS, check_k, check_metric, check_query

#: Rows that the centroids are fitted on, at most about.
FIT_ROWS = 200_000
CELLS = T.StructType([*VECTORS.fields, T.StructField("cell", T.IntegerType())])


class IvfIndex:
    """Cells of one table. centroids is [cell, dim]; rows lie under path/cell=..."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, metric: str):
        self.spark, self.path, self.centroids, self.metric = spark, path, centroids, metric

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")

    @classmethod
    def build(cls, table: DataFrame, path: str, cells: int = 16, metric: str = "cosine", seed: int = 1, fit_rows: int = FIT_ROWS) -> IvfIndex:
        """Fit centroids on a seeded sample of about fit_rows live rows, and write every row into its cell."""
        spark = table.sparkSession
        check_metric(metric)
        centroids = fit_centroids(live(table), cells, metric, seed, fit_rows)
        spark.createDataFrame([(i, [float(x) for x in c], metric) for i, c in enumerate(centroids)], "cell int, centroid array<double>, metric string").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path, centroids, metric)
        index.insert(table)
        return index

    def insert(self, table: DataFrame) -> None:
        """Write more rows into their cells; the centroids stay as they are."""
        n, cells = table.count(), len(self.centroids)
        p = point(F.col("embedding"), self.metric)
        located = table.select(*VECTORS.fieldNames()).withColumn("cell", F.when(F.size(p) == self.centroids.shape[1], nearest_cells(self.centroids, 1)(p)[0]).otherwise(F.lit(0)))
        parts = F.pmod(F.xxhash64("slot"), F.lit(max(1, n // (cells * blocks.BLOCK_ROWS))))
        located.repartition("cell", parts).write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfIndex:
        """The number of cells bounds what is read here."""
        own = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        return cls(spark, path, np.array([r.centroid for r in own]), own[0].metric)

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        q = np.asarray(query, float)
        if self.metric == "cosine" and (norm := np.linalg.norm(q)) > 0:
            q = q / norm
        order = np.lexsort((np.arange(len(self.centroids)), ((self.centroids - q) ** 2).sum(axis=1)))
        return [int(c) for c in order[:nprobe]]

    def _live(self, rows: DataFrame, where: dict | None, gone: DataFrame | None) -> DataFrame:
        """Rows that aren't deleted, neither when they were written nor since (gone has their slots), and pass the filter."""
        rows = live(rows)
        if (test := compile_where(where, F.col("metadata"))) is not None:
            rows = rows.where(test)
        return rows if gone is None else rows.join(gone.select("slot"), "slot", "left_anti")

    def search(self, query: Sequence[float], k: int = 10, nprobe: int = 8, where: dict | None = None, gone: DataFrame | None = None) -> DataFrame:
        """slot, id, score, metadata: a scan pruned to nprobe cells, filtered, then the exact top k."""
        values = check_query(query, self.centroids.shape[1])
        rows = self._live(self.rows.where(F.col("cell").isin(self.probes(values, nprobe))), where, gone)
        scored = rows.select("slot", "id", score_column(F.col("embedding"), vector_literal(values), self.metric).alias("score"), "metadata")
        return scored.orderBy(F.desc("score"), "slot").limit(check_k(k))

    def knn_join(self, queries: DataFrame, k: int = 10, nprobe: int = 8, where: dict | None = None, gone: DataFrame | None = None) -> DataFrame:
        """qid, rank, slot, id, score for every query (qid, v); a query visits its nprobe cells alone."""
        rows = self._live(self.rows, where, gone).select("cell", "slot", "id", F.col("embedding").alias("v"))
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v"))
        asked = asked.select("qid", "v", F.explode(nearest_cells(self.centroids, nprobe)(point(F.col("v"), self.metric))).alias("cell"))
        return blocks.ranked(cell_topk(rows, asked, len(self.centroids), check_k(k), self.metric), k).select("qid", "rank", "slot", "id", "score")


def cell_topk(rows: DataFrame, asked: DataFrame, cells: int, k: int, metric: str) -> DataFrame:
    """(qid, slot, id, score): the k best rows (cell, slot, id, v) of each cell for each query (qid, v, cell) that visits it.
    A cell is split into blocks by slot, so that a large cell is no single task."""
    per = max(1, rows.select("slot").count() // (cells * blocks.BLOCK_ROWS) + 1)
    split = F.pmod(F.xxhash64("slot"), F.lit(per)).cast("int")
    data = rows.select((F.col("cell") * per + split).cast("int").alias("block"), "slot", "id", "v")
    asked = asked.select("qid", "v", "cell", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("split"))
    asked = asked.select((F.col("cell") * per + F.col("split")).cast("int").alias("block"), "qid", "v")
    return blocks.block_topk(data, asked, k, metric, max(1, cells * per))


def point(vector: Column, metric: str) -> Column:
    """A vector where cells are made: of length 1 for the cosine."""
    return normalize(vector) if metric == "cosine" else vector.cast("array<double>")


def fit_centroids(rows: DataFrame, cells: int, metric: str = "cosine", seed: int = 1, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """[cell, dim] by k-means on a seeded sample of about fit_rows rows."""
    n = rows.count()
    if n == 0:
        return np.zeros((1, 1))
    p = point(F.col("embedding"), metric)
    if cells == 1:
        return np.zeros((1, rows.select(F.size("embedding").alias("d")).first().d))
    sample = rows.where(F.pmod(F.xxhash64("slot", F.lit(seed)), F.lit(1_000_000)) < F.lit(max(1, min(1_000_000, int(1e6 * fit_rows / n)))))
    model = KMeans(k=max(1, min(cells, n)), seed=seed, maxIter=20, featuresCol="f").fit(sample.select(array_to_vector(p).alias("f")))
    return np.array(model.clusterCenters())


def nearest_cells(centroids: np.ndarray, n: int):
    """A function of points: the numbers of the n nearest centroids, nearest first; null vectors are in the first cells."""

    def run(vectors: pa.Array) -> pa.Array:
        keep = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        out = np.tile(np.arange(min(n, len(centroids)), dtype=np.int32), (len(vectors), 1))
        if len(keep):
            x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1)
            d = (centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T
            out[keep] = np.argsort(d, axis=1, kind="stable")[:, :n]
        return pa.array(list(out), pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")
