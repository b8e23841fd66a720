"""Approximate nearest neighbours by collision counting on query-centred windows.

Vectors are scaled to length 1, where cosine and Euclidean order agree. PROJECTIONS random directions give each block
of rows as many arrays of single projections, kept as the quantile (one of 256) each row lies in. A query's window in
every array is centred on its own projection and grows with the search radius R (virtual rehashing: no array is
rebuilt); its ends are moved to the nearest ends of quantiles, and its centre's quantile always belongs to it. Two vectors at distance d share a window of half-width HALF * R
with probability 2 Phi(HALF * R / d) - 1, so rows at R collide in 89 % of the arrays and rows at 1.25 R in 80 %. Rows
whose collisions reach THRESHOLD are verified by the exact measure on the original vectors. A query is done when its
k-th best verified row lies within R (Huang et al. 2015). Radii are FIRST_RADIUS times powers of GROWTH. Windows only grow,
so smaller radii can be left out without losing a row: a query begins where three of four others of its block had to go or further.

Rows are dealt into blocks by hashed identifier; each block is indexed where it lies, wholly, and every query visits
every block, in batches. There is no cap on collisions or candidates: a very common vector is verified row by row.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS = 256
HALF = 1.6
THRESHOLD = 223
FIRST_RADIUS = 0.06
GROWTH = 1.05
#: Rows of a block at most (on average), and at least where a small table is split for parallel work.
BLOCK_ROWS, LEAST_ROWS = 131_072, 2048
#: Marks of verified rows that are held at once: queries of a batch times rows of a block.
COUNTERS = 4_000_000
#: Rows and projections that are counted together, so that they stay in a core's cache.
ROWS_AT_ONCE, AXES_AT_ONCE = 8192, 32
#: Queries whose radii tell where the next one begins.
RECENT = 32
SEED = 7


def cosines(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Row by row in double precision, so that equal vectors have equal scores wherever they lie."""
    return (rows * q).sum(axis=1) / (norms * q_norm)


def radius_of(step: int) -> float:
    return FIRST_RADIUS * GROWTH**step


def step_of(distance: float) -> int:
    """The first step whose radius is at least distance."""
    step = max(0, math.ceil(math.log(max(distance, FIRST_RADIUS) / FIRST_RADIUS, GROWTH)) - 1)
    while radius_of(step) < distance:
        step += 1
    return step


#: The first radius of 2 or more: no two unit vectors are further apart, so whatever is left is verified.
LAST = step_of(2.0)


class BlockIndex:
    """Single projections of one block, by quantile."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.verified = 0  # rows that exact scores were computed for, over all queries
        self.norms = np.sqrt((rows * rows).sum(axis=1))
        self.axes = np.random.default_rng(SEED).standard_normal((PROJECTIONS, rows.shape[1]))
        n = len(rows)
        unit = rows / self.norms[:, None]
        self.edges = np.empty((PROJECTIONS, 511))  # of quantiles and, at even places, of their halves
        self.by_row = np.empty((n, PROJECTIONS), np.uint8)
        for j in range(0, PROJECTIONS, AXES_AT_ONCE):
            p = np.ascontiguousarray((unit @ self.axes[j : j + AXES_AT_ONCE].T).T)
            self.edges[j : j + AXES_AT_ONCE] = np.sort(p, axis=1)[:, np.arange(1, 512) * n // 512]
            for i, own in enumerate(p, j):
                self.by_row[:, i] = self._half(i, own) >> 1
        self.parts = [(at, np.ascontiguousarray(self.by_row[at : at + ROWS_AT_ONCE].T)) for at in range(0, n, ROWS_AT_ONCE)]
        self.recent: deque[int] = deque(maxlen=RECENT)

    def _half(self, j: int, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges[j], p, side="right")

    def _halves(self, p: np.ndarray) -> np.ndarray:
        return np.stack([self._half(j, own) for j, own in enumerate(np.ascontiguousarray(p.T))], axis=1)

    def _windows(self, centre: np.ndarray, reach: np.ndarray | float, mid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of queries [query, axis]: the first quantile of each window, and how many follow. mid: _halves of centre."""
        low, mid, high = self._halves(centre - reach), self._halves(centre) if mid is None else mid, self._halves(centre + reach)
        low, high = np.minimum(low + 1, mid) >> 1, np.maximum(high - 1, mid) >> 1
        return low.astype(np.uint8), (high - low).astype(np.uint8)

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and the ids and scores of its k nearest found here, its own id left out."""
        at = 0
        while at < len(q_ids):  # as many as have told where to begin
            most = max(1, COUNTERS // len(self.ids))
            end = at + (most if len(self.recent) == RECENT else min(most, max(1, len(self.recent))))
            yield from self._batch(q_ids[at:end], queries[at:end], k)
            at = end

    def _collided(self, at: int, part: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The rows of a part, which begins at row at, that lie in THRESHOLD windows or more. A row is dropped once it is
        outside of too many; when few are left, the other projections are looked up for these alone."""
        rows, most = part.shape[1], PROJECTIONS - THRESHOLD
        outside = np.zeros(rows, np.uint8)
        far = np.empty((AXES_AT_ONCE, rows), np.uint8)
        for j in range(0, PROJECTIONS - AXES_AT_ONCE, AXES_AT_ONCE):
            own, end = slice(j, j + AXES_AT_ONCE), j + AXES_AT_ONCE
            np.subtract(part[own], low[own, None], out=far)  # quantiles below the window come out above its width
            np.greater(far, width[own, None], out=far.view(bool))
            outside += np.add.reduce(far, axis=0, dtype=np.uint8)
            if end > most and np.count_nonzero(outside <= most) <= rows // 8:
                break
        left = np.flatnonzero(outside <= most)
        rest = (self.by_row[at + left, end:] - low[end:] > width[end:]).sum(axis=1)
        return at + left[outside[left] + rest <= most]

    def _batch(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        q_norms = np.sqrt((queries * queries).sum(axis=1))
        centre = (queries / q_norms[:, None]) @ self.axes.T
        mid = self._halves(centre)
        seen = np.zeros((len(q_ids), len(self.ids)), bool)
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in q_ids]
        begin = int(np.quantile(self.recent, 0.25)) if self.recent else 0
        steps, active = np.full(len(q_ids), begin), np.arange(len(q_ids))
        while len(active):
            low, width = self._windows(centre[active], HALF * FIRST_RADIUS * GROWTH ** steps[active, None].astype(float), mid[active])
            met: list[list[np.ndarray]] = [[] for _ in active]
            for at, part in self.parts:
                for i, q in enumerate(active):
                    if steps[q] < LAST:
                        met[i].append(self._collided(at, part, low[i], width[i]))
            going = []
            for i, q in enumerate(active):
                last = steps[q] >= LAST
                new = np.arange(len(self.ids)) if last else np.concatenate(met[i])
                new = new[~seen[q, new]]
                if len(new):
                    seen[q, new] = True
                    new = new[self.ids[new] != q_ids[q]]
                    self.verified += len(new)
                    score = cosines(self.rows[new], self.norms[new], queries[q], q_norms[q])
                    ids, score = np.concatenate([best[q][0], self.ids[new]]), np.concatenate([best[q][1], score])
                    if len(ids) > 64 + k:  # only ties with the k-th need to be ordered
                        top = score >= np.partition(score, len(score) - k)[len(score) - k]
                        ids, score = ids[top], score[top]
                    top = np.lexsort((ids, -score))[:k]
                    best[q] = (ids[top], score[top])
                found = best[q][1]
                need = step_of(math.sqrt(max(0.0, 2 - 2 * found[k - 1]))) if len(found) >= k else LAST
                if last or need <= steps[q]:
                    self.recent.append(min(need, LAST))
                else:
                    steps[q] += 1
                    going.append(q)
            active = np.array(going, np.int64)
        for q, (ids, score) in zip(q_ids, best, strict=True):
            yield int(q), ids, score


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not zero."""
    v = F.coalesce(vector, F.array().cast("array<double>"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return fine & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found by cosine for every row whose key is divisible by every.

    Ties go to the smaller key. Rows with a null key or an unusable vector take no part; vectors of another length
    than a query's aren't its candidates. Rows that repeat a query's key are not its candidates and give one query
    (the smallest of their vectors); repeated rows rank once. Fewer candidates than k: all of them. Empty table: no
    rows. Columns other than key and vector are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n = rows.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS)))
    data = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = data.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("dim", "block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index = None, None
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for b in batches:
            dim, block, kind = (b.column(i).to_numpy() for i in range(3))
            starts = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1), b.num_rows]
            for a, z in zip(starts, starts[1:]):
                if a == z:
                    continue
                if place != (dim[a], block[a]):
                    place, index, ids, values = (dim[a], block[a]), None, [], []
                part = b.slice(a, z - a)
                own, v = part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(z - a, dim[a])
                if kind[a] == 0:
                    ids.append(own)
                    values.append(v)
                    continue
                if index is None:
                    if not ids:
                        continue
                    index, ids, values = BlockIndex(np.concatenate(ids), np.concatenate(values)), [np.empty(0)], []
                got = list(index.search(own, v, k))
                size = [len(x[1]) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in got], size), pa.int64()), pa.array(np.concatenate([x[1] for x in got]), pa.int64()), pa.array(np.concatenate([x[2] for x in got]), pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
