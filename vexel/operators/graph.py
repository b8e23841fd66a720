"""Approximate search over a layered neighbour graph held as tables, for all queries at once.

nodes is (slot, id, embedding, metadata, deleted, level, place, segment), edges (layer, src, dst, sim, segment). A node's
segment follows from its slot; there is one for every SEGMENT numbers of the vectors, so small tables have one. A layer's
edges are each node's nearest M of that layer and its segment among the rows of the cells near to it, with their reverses,
cut to the nearest 2 M on layer 0 and M above; the breadth while building says how many cells a node visits. More nodes are
linked by searching their segment with that breadth, and lists that they enter are cut again.

A search has its queries dealt to tasks. A task holds one segment at a time, read from the folder that all share, and
walks every query through it: each step expands every open node among the query's best ef, follows their edges, leaves out
what the query has met, scores, and cuts to ef again, until nothing is open. This expands all that a best-first search
would. The best of all segments are merged in the task. Nodes that are deleted, before or after the build, or fail a filter
carry the search on and are left out of its result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel.functions.vectors import TINY
from vexel.operators import blocks
from vexel.operators.ivf import fit_centroids, nearest_cells, point
from vexel.plans.predicate import compile_where
from vexel.plans.storage import discard, files_of, materialise
from vexel.schema import VECTORS, Config, check_k, check_metric

#: Rows of a cell on average, and the breadth for which one cell more is visited.
CELL_ROWS, PER_CELL = 1024, 25
#: Nodes spread over a segment at which a search starts, besides the entry point.
STARTS = 8
#: How many times k hits a filtered search looks at.
OVERFETCH = 4
#: Numbers of the vectors of a segment on average: 131,072 nodes of 64 dimensions, 33 MB.
SEGMENT = 1 << 23
#: Nodes that a task links while building, at most and at least (on average).
LINKED, LEAST_LINKED = 16_384, 1024


def segment_of(slot: str, segments: int) -> Column:
    return F.pmod(F.xxhash64(slot), F.lit(segments)).cast("int")


def by_segment(table: DataFrame, slot: str, segments: int, name: str, *order: str, rows: int = 0) -> DataFrame:
    """A table written with a folder for each segment, sorted inside its files. Of a table with so many rows (by slot) there
    are as many files as give every core work."""
    parts = max(1, min(math.ceil(2 * table.sparkSession.sparkContext.defaultParallelism / segments), rows // (segments * LEAST_LINKED)))
    part = F.pmod(F.xxhash64(F.lit(1), F.col(slot)), F.lit(parts)).cast("int")
    dealt = table.withColumn("segment", segment_of(slot, segments)).repartitionById(segments * parts, F.col("segment") * parts + part)
    return materialise(dealt.sortWithinPartitions("segment", *order), name, folders="segment")


def segment_files(table: DataFrame) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for f in files_of(table):
        found.setdefault(int(re.search(r"/segment=(\d+)/", f)[1]), []).append(f)
    return found


def level_of(key: Column, M: int) -> Column:
    """A node's top layer: floor(-ln(u) / ln(M)) with u in (0, 1] from the first 32 bits of its id's MD5."""
    if M < 2:
        raise ValueError("M must be at least 2")
    u = (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    return F.floor(-F.log(u) * F.lit(1 / math.log(M))).cast("int")


def nearest_edges(nodes: DataFrame, M: int, metric: str = "cosine") -> DataFrame:
    """(src, dst, sim): each node's M nearest others, exactly, by a join of the nodes with themselves."""
    v = F.col("embedding").alias("v")
    rows = nodes.select("slot", F.lit(None).cast("long").alias("id"), v)
    hits = blocks.all_topk(rows, nodes.select(F.col("slot").alias("qid"), v), M, metric, others=True)
    return hits.select(F.col("qid").alias("src"), F.col("slot").alias("dst"), F.col("score").alias("sim"))


def cell_edges(nodes: DataFrame, M: int, metric: str = "cosine", breadth: int = 200, segments: int = 1) -> DataFrame:
    """(src, dst, sim): each node's M nearest of its segment among the rows of the cells nearest to it, one cell per PER_CELL
    of breadth.

    A segment's cells have CELL_ROWS rows on average, more where their number would exceed the square root of the nodes', so
    a node meets breadth * CELL_ROWS / PER_CELL others whatever the size of the table. In a single cell the edges are exact.
    A task reads one segment and links a part of its nodes, so only edges leave it.
    """
    spark = nodes.sparkSession
    nodes = nodes.where(F.col("embedding").isNotNull())
    n = math.ceil(nodes.count() / segments)
    centroids = fit_centroids(nodes, max(1, min(math.ceil(n / CELL_ROWS), math.ceil(math.sqrt(n)))), metric)
    near = nearest_cells(centroids, max(1, math.ceil(breadth / PER_CELL)))
    rows = nodes.select("slot", F.col("embedding").alias("v"), near(point(F.col("embedding"), metric)).alias("cells"))
    files = segment_files(by_segment(rows, "slot", segments, "graph-cells", "slot", rows=n * segments))
    parts = max(1, math.ceil(n / LINKED), min(math.ceil(2 * spark.sparkContext.defaultParallelism / segments), math.ceil(n / LEAST_LINKED)))

    def linked(own: list[str], part: int) -> pa.RecordBatch:
        read = list(blocks.read_batches(own, ["slot", "v", "cells"]))
        slots, vectors, cells = (np.concatenate([f(b.column(i)) for b in read]) for i, f in enumerate((pa.Array.to_numpy, blocks.vectors_of, blocks.vectors_of)))
        del read
        order = np.argsort(cells[:, 0], kind="stable")
        starts = np.searchsorted(cells[order, 0], np.arange(len(centroids) + 1))
        src = order[len(order) * part // parts : len(order) * (part + 1) // parts]
        nearest, visited = blocks.Nearest(vectors[src], M, metric, slots[src]), cells[src]
        for cell in np.unique(visited):
            members = order[starts[cell] : starts[cell + 1]]
            if len(members):
                nearest.offer(blocks.Rows(vectors[members], slots[members], slots[members], metric), np.flatnonzero((visited == cell).any(axis=1)))
        return nearest.hits(slots[src])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_numpy():
                own = files.get(int(task) // parts)
                if own:
                    yield from blocks.cut(linked(own, int(task) % parts))

    hits = spark.range(0, segments * parts, 1, segments * parts).mapInArrow(run, blocks.HITS)
    return hits.select(F.col("qid").alias("src"), F.col("slot").alias("dst"), F.col("score").alias("sim"))


def with_reverse(edges: DataFrame, most: int) -> DataFrame:
    """Edges with their reverses, cut to the most similar `most` of each source."""
    both = edges.select(F.inline(F.array(F.struct("src", "dst", "sim"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))))
    # the two directions of a pair may differ in the last bit of sim; a source's edges meet once, for both steps
    once = both.repartition("src").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    return shrunk(once, most)


def shrunk(edges: DataFrame, most: int) -> DataFrame:
    """The most similar `most` edges of each source."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def _most(M: int, layer: int) -> int:
    return M * (2 if layer == 0 else 1)


class Segment:
    """One segment's nodes and edges in memory; nodes are known by their place in the order of slots."""

    def __init__(self, nodes: list[str], edges: list[str], fit: list[str] | None, metric: str):
        read = [b.filter(b.column(1).is_valid()) for b in blocks.read_batches(nodes, ["slot", "embedding", "level", "deleted", "place"])]
        read = [b for b in read if b.num_rows]
        self.metric, self.n = metric, sum(b.num_rows for b in read)
        if not self.n:
            return
        slots, self.x, level, dead, place = (np.concatenate([f(b.column(i)) for b in read]) for i, f in enumerate((pa.Array.to_numpy, blocks.vectors_of, _plain, _plain, _plain)))
        del read
        if (np.diff(slots) < 0).any():
            o = np.argsort(slots)
            slots, self.x, level, dead, place = slots[o], self.x[o], level[o], dead[o], place[o]
        self.slots, self.level, live = slots, level, ~dead
        self.norm = np.concatenate([blocks.norms(self.x[a : a + 8192].astype(np.float64)) for a in range(0, self.n, 8192)])
        self.seen, self.stamp = np.zeros(self.n, np.int32), 0
        wide = int(slots[-1] - slots[0]) + 1
        self._table = None
        if wide <= 32 * self.n:
            self._table = np.full(wide, -1, np.int32)
            self._table[slots - slots[0]] = np.arange(self.n)
        # the entry is the first node of the highest level; the first live one, if that is deleted
        entry = int(np.lexsort((slots, -level))[0])
        self.entry = entry if live[entry] or not live.any() else int(np.flatnonzero(live)[0])
        self.spread = np.lexsort((slots, place))[:STARTS]
        self.fit = live
        if fit is not None:
            self.fit = np.zeros(self.n, bool)
            for b in blocks.read_batches(fit, ["slot"]):
                own = self.places(b.column(0).to_numpy())
                self.fit[own[own >= 0]] = True
        self.layers = self._layers(edges)

    def places(self, slots: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        if self._table is not None:
            at = slots - self.slots[0]
            inside = (at >= 0) & (at < len(self._table))
            return np.where(inside, self._table[np.where(inside, at, 0)], -1)
        at = np.minimum(np.searchsorted(self.slots, slots), self.n - 1)
        return np.where(self.slots[at] == slots, at, -1)

    def _layers(self, files: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By layer: the row of each node in a matrix of neighbours (-1: none), and that matrix, filled up with the node itself."""
        read = [(b.column(0).to_numpy(), self.places(b.column(1).to_numpy()).astype(np.int32), self.places(b.column(2).to_numpy()).astype(np.int32)) for b in blocks.read_batches(files, ["layer", "src", "dst"], 1 << 18)]
        if not read:
            return {}
        layer, src, dst = (np.concatenate([r[i] for r in read]) for i in range(3))
        del read
        out = {}
        for own in np.unique(layer):
            pick = np.flatnonzero((layer == own) & (src >= 0) & (dst >= 0))
            if not len(pick):
                continue
            a, z = src[pick], dst[pick]
            if (np.diff(a) < 0).any():
                o = np.argsort(a, kind="stable")
                a, z = a[o], z[o]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            sizes = np.diff(np.append(first, len(a)))
            row = np.full(self.n, -1, np.int32)
            row[a[first]] = np.arange(len(first))
            matrix = np.repeat(a[first][:, None], sizes.max(), axis=1)
            matrix[np.repeat(np.arange(len(first)), sizes), np.arange(len(a)) - np.repeat(first, sizes)] = z
            out[int(own)] = row, matrix
        return out

    def similar(self, q: np.ndarray, norm: float, at: np.ndarray, exactly: bool = False) -> np.ndarray:
        x = self.x[at].astype(np.float64)
        if self.metric == "l2":
            d = x - q
            s = -(np.cumsum(d * d, axis=1)[:, -1] if exactly else np.einsum("ij,ij->i", d, d))
        else:
            scale = norm * self.norm[at]
            dot = np.cumsum(x * q, axis=1)[:, -1] if exactly else x @ q
            small = scale < TINY
            s = np.where(small, 0.0, dot / np.where(small, 1.0, scale))
        return s if exactly else np.where(np.isnan(s), np.inf, s)

    def beam(self, q: np.ndarray, norm: float, at: np.ndarray, layer: int, ef: int) -> np.ndarray:
        """The best ef nodes that a walk from some nodes meets on a layer."""
        if layer not in self.layers:
            return at
        row, matrix = self.layers[layer]
        self.stamp += 1
        self.seen[at] = self.stamp
        sim, open_ = self.similar(q, norm, at), np.ones(len(at), bool)
        while True:
            front = row[at[open_]]
            to = matrix[front[front >= 0]].ravel()
            to = to[self.seen[to] != self.stamp]
            open_[:] = False
            if not len(to):
                break
            to = np.unique(to)
            self.seen[to] = self.stamp
            at, sim = np.concatenate([at, to]), np.concatenate([sim, self.similar(q, norm, to)])
            open_ = np.concatenate([open_, np.ones(len(to), bool)])
            if len(at) > ef:
                keep = np.flatnonzero(sim >= np.partition(sim, len(sim) - ef)[len(sim) - ef])
                if len(keep) > ef:  # ties to the smaller slot
                    keep = keep[np.lexsort((at[keep], -sim[keep]))[:ef]]
                at, sim, open_ = at[keep], sim[keep], open_[keep]
            if not open_.any():
                break
        if len(at) > ef:
            at = at[np.lexsort((at, -sim))[:ef]]
        return at

    def best(self, q: np.ndarray, norm: float, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some nodes the k nearest, in order, and their scores."""
        s = self.similar(q, norm, at, exactly=True)
        o = np.lexsort((at, -np.where(np.isnan(s), np.inf, s)))[:k]
        return at[o], s[o]


def _plain(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class GraphIndex:
    def __init__(self, nodes: DataFrame, edges: DataFrame, config: Config, metric: str, max_layer: int, segments: int = 1):
        self.nodes, self.edges, self.config, self.metric, self.max_layer, self.segments = nodes, edges, config, metric, max_layer, segments

    @classmethod
    def build(cls, table: DataFrame, config: Config | None = None, metric: str = "cosine") -> GraphIndex:
        """Layer by layer; a layer has the nodes whose level reaches it, 1 / M of those below, so layer 0 is nearly all
        of the work."""
        config = config or Config()
        check_metric(metric)
        size = table.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max(level_of(F.col("id"), config.M)).alias("top")).first()
        segments = max(1, math.ceil(size.n * max(1, size.dim or 0) / SEGMENT))
        nodes = _stored_nodes(table, config.M, segments, size.n)
        max_layer = -1 if size.top is None else int(size.top)
        edges = None
        for layer in range(max_layer + 1):
            own = nodes.where(F.col("level") >= layer).select("slot", "embedding")
            linked = with_reverse(cell_edges(own, config.M, metric, config.ef_construction, segments), _most(config.M, layer)).select(F.lit(layer).alias("layer"), "src", "dst", "sim")
            edges = linked if edges is None else edges.unionByName(linked)
        if edges is None:
            edges = table.sparkSession.createDataFrame([], "layer int, src long, dst long, sim double")
        return cls(nodes, _stored_edges(edges, segments, size.n), config, metric, max_layer, segments)

    def entry_point(self) -> int | None:
        """The first node of the highest level; the first live one, if that is deleted; none in a dead graph."""
        best = self.nodes.agg(F.max_by(F.struct("slot", "deleted"), F.struct("level", -F.col("slot"))).alias("e"), F.min(F.when(~F.col("deleted"), F.col("slot"))).alias("live")).first()
        if best.e is None or best.live is None:
            return None
        return best.live if best.e.deleted else best.e.slot

    def insert(self, table: DataFrame) -> GraphIndex:
        """The graph with more rows. They are linked to what a search with the breadth of the build finds in their segment and
        to each other; lists that they enter are cut again. Where segments would come to hold more than twice their numbers, all
        is built anew, with more of them."""
        if self.max_layer < 0:
            return GraphIndex.build(table, self.config, self.metric)
        M, breadth = self.config.M, self.config.ef_construction
        new = _stored_nodes(table, M, self.segments, table.count())
        size = new.agg(F.max("level").alias("top"), F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        if size.top is None:
            return self
        everything = self.nodes.select(*VECTORS.fieldNames()).unionByName(new.select(*VECTORS.fieldNames()))
        n = self.nodes.count() + size.n
        if n * max(1, size.dim) > 2 * self.segments * SEGMENT:
            return GraphIndex.build(everything, self.config, self.metric)
        max_layer = max(self.max_layer, int(size.top))
        found = materialise(self._links(new, max_layer, breadth), "graph-found")
        edges, made = None, [found, new]
        for layer in range(max_layer + 1):
            own = new.where(F.col("level") >= layer).select("slot", "embedding")
            near = found.where(F.col("layer") == layer).select("src", "dst", "sim")
            linked = shrunk(near.unionByName(cell_edges(own, M, self.metric, breadth, self.segments)), M)
            # lists that nothing enters stay as they are
            old = self.edges.where(F.col("layer") == layer).select("src", "dst", "sim")
            joined = shrunk(with_reverse(linked, 1 << 30).unionByName(old), _most(M, layer)).select(F.lit(layer).alias("layer"), "src", "dst", "sim")
            edges = joined if edges is None else edges.unionByName(joined)
        nodes, edges = _stored_nodes(everything, M, self.segments, n), _stored_edges(edges, self.segments, n)
        discard(*made)
        return GraphIndex(nodes, edges, self.config, self.metric, max_layer, self.segments)

    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None, starts: int = STARTS, where: dict | None = None, gone: DataFrame | None = None) -> DataFrame:
        """qid, rank, slot, id, score of at most k hits per query (qid, v) that are live and pass the filter.

        Breadth in a segment is max(ef, k), or with a filter max(ef, OVERFETCH * k); where few rows pass it, fewer than k may
        be found. gone has the slots that were deleted since the build. Layers above 0 are descended with breadth 1 from the
        entry point; layer 0 starts at where they end and at `starts` nodes (STARTS at most) spread over the segment, as it
        may be in parts.
        """
        spark = self.nodes.sparkSession
        k, ef = check_k(k), max(ef or self.config.ef_search, k if where is None else OVERFETCH * k)
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
        n = asked.count()
        if self.entry_point() is None or k == 0 or n == 0:
            return spark.createDataFrame([], blocks.HITS)
        test, fit = compile_where(where, F.col("metadata")), None
        if test is not None or gone is not None:
            rows = self.nodes.where(~F.col("deleted"))
            rows = rows if test is None else rows.where(test)
            rows = rows if gone is None else rows.join(gone.select("slot"), "slot", "left_anti")
            fit = segment_files(by_segment(rows.select("slot"), "slot", self.segments, "graph-fit", "slot"))
        segment, max_layer = self._reader(fit), self.max_layer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = [(b.column(0).to_numpy(), blocks.vectors_of(b.column(1))) for b in batches if b.num_rows]
            if not read:
                return
            keys, q = (np.concatenate([r[i] for r in read]) for i in range(2))
            norm = blocks.norms(q)
            slots, score = np.full((len(q), 0), blocks.NONE), np.empty((len(q), 0))
            for g in segment.all():
                slots = np.concatenate([slots, np.full((len(q), k), blocks.NONE)], axis=1)
                score = np.concatenate([score, np.full((len(q), k), -np.inf)], axis=1)
                for i in range(len(q)):
                    at = np.array([g.entry])
                    for layer in range(max_layer, 0, -1):
                        at = g.beam(q[i], norm[i], at, layer, 1)
                    at = g.beam(q[i], norm[i], np.union1d(at, g.spread[:starts]), 0, ef)
                    at, s = g.best(q[i], norm[i], at[g.fit[at]], k)
                    slots[i, -k : len(at) - k or None], score[i, -k : len(at) - k or None] = g.slots[at], s
                order = np.lexsort((slots, -np.where(np.isnan(score), np.inf, score)), axis=1)[:, :k]
                slots, score = np.take_along_axis(slots, order, 1), np.take_along_axis(score, order, 1)
            there = slots != blocks.NONE
            i, rank = np.nonzero(there)
            yield from blocks.cut(pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(rank + 1), pa.array(slots[there]), pa.array(score[there])], ["qid", "rank", "slot", "score"]))

        hits = self._dealt(asked, n).mapInArrow(run, "qid long, rank long, slot long, score double")
        return hits.join(self.nodes.select("slot", "id"), "slot").select("qid", "rank", "slot", "id", "score")

    def _reader(self, fit: dict[int, list[str]] | None = None) -> Segments:
        return Segments(segment_files(self.nodes), segment_files(self.edges), fit, self.metric)

    @staticmethod
    def _dealt(asked: DataFrame, n: int, *first: str) -> DataFrame:
        """Queries dealt to tasks, by some columns before their number."""
        cores = asked.sparkSession.sparkContext.defaultParallelism
        chunks = min(max(2 * cores, math.ceil(n / blocks.MOST_QUERIES)), math.ceil(n / blocks.LEAST_QUERIES))
        if first:
            return asked.repartitionByRange(chunks, *first, "qid")
        return asked.repartitionById(chunks, F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))

    def _links(self, new: DataFrame, max_layer: int, ef: int) -> DataFrame:
        """(layer, src, dst, sim): the M nearest nodes that a search of a new node's own segment finds on each of its layers."""
        asked = new.where(F.col("embedding").isNotNull()).select(F.col("slot").alias("qid"), F.col("embedding").alias("v"), "level", segment_of("slot", self.segments).alias("segment"))
        segment, M = self._reader(), self.config.M

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, g = None, None
            for b in batches:
                if not b.num_rows:
                    continue
                q, out = blocks.vectors_of(b.column(1)).astype(np.float64), []
                norm = blocks.norms(q)
                for i, (key, level, own) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                    if own != number:
                        number, g = own, None
                        g = segment.one(own)
                    if g is None:
                        continue
                    at = np.union1d([g.entry], g.spread)
                    for layer in range(max_layer, -1, -1):
                        at = g.beam(q[i], norm[i], at, layer, ef)
                        if level >= layer:
                            to, s = g.best(q[i], norm[i], at[g.level[at] >= layer], M)
                            out.append((np.full(len(to), layer, np.int32), np.full(len(to), key), g.slots[to], s))
                if out:
                    yield from blocks.cut(pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], ["layer", "src", "dst", "sim"]))

        return self._dealt(asked, max(1, asked.count()), "segment").sortWithinPartitions("segment", "qid").mapInArrow(run, "layer int, src long, dst long, sim double")


class Segments:
    """Where a graph's segments lie, for tasks."""

    def __init__(self, nodes: dict[int, list[str]], edges: dict[int, list[str]], fit: dict[int, list[str]] | None, metric: str):
        self.nodes, self.edges, self.fit, self.metric = nodes, edges, fit, metric

    def one(self, number: int) -> Segment | None:
        """None for a segment without vectors."""
        if number not in self.nodes:
            return None
        g = Segment(self.nodes[number], self.edges.get(number, []), None if self.fit is None else self.fit.get(number, []), self.metric)
        return g if g.n else None

    def all(self) -> Iterator[Segment]:
        """One after the other; one without fitting nodes gives no hits and is left out."""
        for number in sorted(self.nodes):
            g = self.one(number)
            if g is not None and g.fit.any():
                yield g
            del g


def _stored_nodes(table: DataFrame, M: int, segments: int, n: int) -> DataFrame:
    rows = table.select(*VECTORS.fieldNames()).withColumn("level", level_of(F.col("id"), M)).withColumn("place", F.xxhash64("slot"))
    return by_segment(rows, "slot", segments, "graph-nodes", "slot", rows=n)


def _stored_edges(edges: DataFrame, segments: int, n: int) -> DataFrame:
    return by_segment(edges, "src", segments, "graph-edges", "layer", "src", rows=n)
