"""Recall, latency and process measures."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, on: str = "slot") -> DataFrame:
    """(qid, recall) for every query of truth: matches among both first k, divided by k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    a = found.where(F.col("rank") <= k).select("qid", on).distinct()
    b = truth.where(F.col("rank") <= k).select("qid", on).distinct()
    hits = a.join(b, ["qid", on]).groupBy("qid").agg(F.count("*").alias("n"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int, on: str = "slot") -> DataFrame:
    return recall_at_k(found, truth, k, on).agg(F.avg("recall").alias("recall"))


def latency_summary(latencies: DataFrame, column: str = "ms") -> DataFrame:
    return latencies.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.max(column).alias("max"))


def peak_memory_gb() -> float:
    """Of this process, not of the JVM or the executors."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024**2


@dataclass
class Stopwatch:
    """Wall-clock seconds by name."""

    seconds: dict[str, float] = field(default_factory=dict)
    clock: Callable[[], float] = time.perf_counter

    @contextmanager
    def timed(self, name: str):
        began = self.clock()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + self.clock() - began
