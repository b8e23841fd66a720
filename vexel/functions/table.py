"""knn as a table function for SQL: SELECT * FROM knn(TABLE(t), array(...), 10)."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vexel.functions.vectors import TINY


@udtf(returnType="id long, slot long, score double")
class Knn:
    """Keeps the k best of each partition of the table argument; rows need id, slot, embedding and deleted. With WITH
    SINGLE PARTITION the result is the top k, else each partition's, to be ordered and limited by the caller."""

    def __init__(self):
        self.best: list[tuple[float, int, int]] = []
        self.k, self.query = 0, None

    def eval(self, row, query, k: int):
        if self.query is None:
            self.query, self.k = np.asarray(query, float), k
            self.norm = float(np.sqrt((self.query**2).sum()))
        if row["deleted"] or row["embedding"] is None or self.k < 1:
            return
        v = np.asarray(row["embedding"], float)
        scale = float(np.sqrt((v * v).sum())) * self.norm
        item = (0.0 if scale < TINY else float((v * self.query).sum()) / scale, -row["slot"], row["id"])
        if len(self.best) < self.k:
            heapq.heappush(self.best, item)
        else:
            heapq.heappushpop(self.best, item)

    def terminate(self):
        for score, slot, key in sorted(self.best, reverse=True):
            yield key, -slot, score


def register(spark: SparkSession) -> None:
    spark.udtf.register("knn", Knn)
