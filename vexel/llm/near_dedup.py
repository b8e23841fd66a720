"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

A document is the weighted set of its five-word shingles, weighted by their counts. Each shingle owns a region
[0, weight) x [0, rank limit) of the plane. Hashed darts are thrown at it as a Poisson process: strata of the weight
axis ([0, 1), [1, 2), [2, 4), ...) have their own chains of exponential rank gaps, and every dart gets a place in its
stratum and one of K coordinates. Darts beyond the weight miss; of the hits, the earliest per coordinate is the
signature's value there. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity. The rank limit is about (ln K + 3) / total weight, so that some K ln K darts serve a document of any
length (Christiani 2020), and is raised for the few documents with a coordinate left empty.

BANDS bands of ROWS coordinates give buckets. Documents with equal shingles are joined first, so copies are one node.
Each node then meets one leader in each of its buckets, the node that shares most bucket places with others; pairs are
checked exactly by the weighted Jaccard similarity of their shingles, and the similar ones make classes. What a bucket
still holds in different classes meets exactly: the bucket is cut into tiles of two chunks of nodes, a tile's
similarities come from one matrix product over all its shingles, and each tile gives the links that join its classes.
No pair of a bucket in different classes is left out, and no task holds a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from vexel.llm.components import components, rows_of
from vexel.plans.storage import bounded_batches, discard, materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Nodes and elements of a chunk of a large bucket (on average), and columns of a tile's matrix at a time.
TILE, TILE_ELEMENTS, WIDE = 256, 1 << 19, 1 << 12
#: Texts up to which 8-byte hashes of their names are broadcast (some 50 MB as a hash table).
BROADCAST_ROWS = 1_000_000
#: Documents whose darts are thrown together.
TOGETHER = 256
#: Distinct words a worker remembers.
MEMO = 100_000

WORD = re.compile(r"\w+")
# The increment and multipliers of the splitmix64 generator.
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str | None, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words, ascending, and their counts; a shorter text is one shingle, one without words
    has none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            s = mix(s * GOLDEN + h[i : len(h) - k + 1 + i])
    return np.unique(s, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of smaller counts by the sum of larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS, seed: int = 1, slack: float = 3.0) -> np.ndarray:
    """uint64 [document, coordinate]: the earliest dart of each. All sets must be non-empty."""
    out = np.zeros((len(sets), k), np.uint64)
    limits = np.array([(np.log(k) + slack) / c.sum() for _, c in sets])
    todo = np.arange(len(sets))
    while len(todo):
        got, full = _throw([sets[i] for i in todo], limits[todo], k, seed)
        out[todo[full]] = got[full]
        todo = todo[~full]
        limits[todo] *= 3
    return out


def _throw(sets: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures by the darts under each document's rank limit, and which documents have every coordinate."""
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([c for _, c in sets]).astype(np.float64)
    doc = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    slots, ranks, values = [], [], []
    low, stratum = 0.0, 0
    with np.errstate(over="ignore"):
        while len(element):
            width = max(1.0, low)
            state = mix(element + GOLDEN * np.uint64(seed * 64 + stratum))
            rank, w, d, limit = np.zeros(len(element)), weight, doc, limits[doc]
            while len(state):
                state = mix(state + GOLDEN)
                rank = rank - np.log(_unit(state)) / (k * width)
                on = rank < limit
                state, rank, w, d, limit = state[on], rank[on], w[on], d[on], limit[on]
                place = mix(state ^ MIX1)
                hit = low + width * _unit(place) < w
                value = mix(place[hit] ^ MIX2)
                slots.append(d[hit] * k + (value % np.uint64(k)).astype(np.int64))
                ranks.append(rank[hit])
                values.append(value)
            low, stratum = low + width, stratum + 1
            deep = weight > low
            element, weight, doc = element[deep], weight[deep], doc[deep]
    slot, rank, value = np.concatenate(slots), np.concatenate(ranks), np.concatenate(values)
    first = np.full(len(sets) * k, np.inf)
    np.minimum.at(first, slot, rank)
    won = rank == first[slot]
    out = np.zeros(len(sets) * k, np.uint64)
    out[slot[won]] = value[won]
    return out.reshape(-1, k), np.isfinite(first).reshape(-1, k).all(axis=1)


def digest(s: tuple[np.ndarray, np.ndarray]) -> bytes:
    return xxh128_digest(s[0].tobytes() + s[1].astype(np.int64).tobytes())


def _own(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, own, digest, weight, bands) of every row; digest, weight and bands are null for a text without words."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "own", "digest", "weight", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                sets = [shingles(t.as_py()) for t in b.column(2)]
                some = [i for i, s in enumerate(sets) if len(s[0])]
                keys: list[list[int] | None] = [None] * len(sets)
                if some:
                    sig = signatures([sets[i] for i in some], bands * rows)
                    with np.errstate(over="ignore"):
                        h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(some), 1))
                        for r in range(rows):
                            h = mix(h * GOLDEN + sig[:, r::rows])
                    for i, x in zip(some, h.view(np.int64).tolist(), strict=True):
                        keys[i] = x
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([digest(s) if k else None for s, k in zip(sets, keys, strict=True)], pa.binary()),
                     pa.array([int(s[1].sum()) if k else None for s, k in zip(sets, keys, strict=True)], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names,
                )

    texts = docs.select(F.col(f"`{key}`").alias("id"), _own(text).alias("own"), F.col(f"`{text}`").alias("t"))
    return texts.mapInArrow(run, f"id {kind}, own string, digest binary, weight long, bands array<long>")


def texts_of(needed: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, t) of the needed nodes (node, rep, own)."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), _own(text).alias("o"), F.col(f"`{text}`").alias("t"))
    if needed.count() <= BROADCAST_ROWS:  # texts that aren't needed stay where they are
        wanted = needed.select(F.xxhash64("rep", "own").alias("h")).distinct()
        rows = rows.join(F.broadcast(wanted), F.xxhash64("id", "o") == F.col("h"), "left_semi")
    return rows.join(needed, rows.id.eqNullSafe(needed.rep) & (rows.o == needed.own)).select("node", "t")


def elements(s: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A weighted set as a plain one, ascending: the c-th copy of a shingle is an element of its own, so the weighted
    similarity of two texts is that of their elements."""
    e, c = s
    if len(e) == c.sum():
        return e
    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        e = np.repeat(e, c)
        return np.sort(np.where(nth > 0, mix(e + GOLDEN * nth.astype(np.uint64)), e))


def elements_of(texts: DataFrame) -> DataFrame:
    """(node, e) of texts (node, t): the bytes of their elements. Rows that repeat a node give it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([elements(shingles(t.as_py())).tobytes() for t in b.column(1)], pa.binary())], ["node", "e"])

    return texts.mapInArrow(run, "node long, e binary").dropDuplicates(["node"])


def star_pairs(buckets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b): every node of a bucket (band, node, weight, m) with the node there that shares most bucket places
    with others and so lies in the middle of a family. Pairs that their weights alone rule out are left out."""
    score = buckets.groupBy("node").agg(F.sum("m").alias("score"))
    lead = buckets.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node", "weight")).alias("lead"))
    met = buckets.join(lead, "band").where((F.col("node") != F.col("lead.node")) & (F.least("weight", "lead.weight") >= F.greatest("weight", "lead.weight") * F.lit(least - 1e-9)))
    return met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def check_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is least or more, with it; sets has node and e."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("e").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("e").alias("eb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = []
            for a, b in zip(_rows(x.column(2)), _rows(x.column(3)), strict=True):
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                got.append(both / (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    return met.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= least)


def open_tiles(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, i, j, left, node, label): where the nodes of buckets with more than one class meet those of other classes.

    A bucket's largest class and the rest of it are dealt into chunks. A tile holds two chunks of the rest, or one of the
    rest (left) and one of the largest class; a bucket of any size is so many tiles and no task needs all of it.
    """
    at = buckets.join(labels, "node", "left").select("band", "node", "weight", F.coalesce("label", "node").alias("label"))
    by_class = at.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    about = by_class.groupBy("band").agg(F.max(F.struct("n", "label")).alias("big"), F.sum("n").alias("m"), F.sum("w").alias("w"), F.count("*").alias("classes"))
    about = about.where("classes > 1 and m > 2")  # pairs have met their leader

    def chunks(n: Column) -> Column:
        return F.ceil(F.greatest(n / TILE, F.col("w") * n / F.col("m") / TILE_ELEMENTS)).cast("int")

    about = about.select("band", F.col("big.label").alias("most"), chunks(F.col("big.n")).alias("cb"), chunks(F.col("m") - F.col("big.n")).alias("cs"))
    met = at.join(about, "band")
    rest = F.col("label") != F.col("most")
    met = met.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(rest, F.col("cs")).otherwise(F.col("cb"))).cast("int"))

    def tile(i: Column, j: Column, left: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"))

    own, every = F.col("chunk"), F.sequence(F.lit(0), F.col("cs") - 1)
    with_rest = F.transform(every, lambda k: tile(F.least(own, k), F.greatest(own, k), own <= k))
    with_most = F.transform(F.sequence(F.col("cs"), F.col("cs") + F.col("cb") - 1), lambda j: tile(own, j, F.lit(True)))
    of_most = F.transform(every, lambda i: tile(i, F.col("cs") + own, F.lit(False)))
    return met.select("band", "node", "label", F.inline(F.when(rest, F.concat(with_rest, with_most)).otherwise(of_most))).select("band", "i", "j", "left", "node", "label")


def linked(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of labels that join all the classes with a pair of similarity least or more between left and right rows, or
    among all if all are left."""
    size = np.array([len(x) for x in sets])
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    b = b if len(b) else a
    if not len(a):
        return []
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, place = np.repeat(np.arange(len(sets)), size), np.cumsum(often > 1) - 1
    row, column = row[often[column] > 1], place[column[often[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        first, end = np.searchsorted(column, [at, at + WIDE])
        m = np.zeros((len(sets), WIDE), np.float32)
        m[row[first:end], column[first:end] - at] = 1
        both += m[a] @ m[b].T
    both = both.astype(np.float64)
    hit = (both / (size[a][:, None] + size[b][None, :] - both) >= least) & (label[a][:, None] != label[b][None, :])
    x, y = np.nonzero(hit)
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = p
        return v

    out = []
    for u, v in np.unique(np.stack([label[a][x], label[b][y]], axis=1), axis=0).tolist():
        if (r := find(u)) != (s := find(v)):
            parent[max(r, s)] = min(r, s)
            out.append((u, v))
    return out


def tile_links(tiles: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): labels of classes that have a similar pair in a tile. A task holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, label, left = None, [], [], []

        def done() -> pa.RecordBatch:
            got = linked(held, np.array(label, np.int64), np.array(left, bool), least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in range(2)], ["a", "b"])

        for x in batches:
            for t, own, lb, e in zip(zip(*(x.column(k).to_pylist() for k in range(3)), strict=True), x.column(3).to_pylist(), x.column(4).to_pylist(), x.column(5), strict=True):
                if t != last:
                    if held:
                        yield done()
                    last, held, label, left = t, [], [], []
                held.append(np.frombuffer(e.as_py(), np.uint64))
                label.append(lb)
                left.append(own)
        if held:
            yield done()

    met = tiles.join(sets, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return met.select("band", "i", "j", "left", "label", "e").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, own, class_id, class_size, kept) of every row of docs.

    kept marks one row of each class, that with the smallest key.
    """
    bounded_batches(docs.sparkSession)
    signed = materialise(sign(docs, key, text, bands, rows).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    some = signed.where("digest is not null")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own"))
    groups = some.groupBy("digest").agg(best.alias("r"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = materialise(groups.select("digest", F.col("r.id").alias("rep"), F.col("r.own").alias("own"), "weight", "bands").withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    spread = nodes.select("node", "weight", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    buckets = materialise(spread.join(shared, "band").select("band", "node", "weight", "m"), "near-buckets")
    needed = materialise(nodes.select("node", "rep", "own").join(buckets.select("node").distinct(), "node", "left_semi"), "near-needed")
    sets = materialise(elements_of(texts_of(needed, docs, key, text)), "near-elements")
    labels = components(check_pairs(star_pairs(buckets, least), sets, least))
    more = components(tile_links(open_tiles(buckets, labels), sets, least))
    joined = labels.withColumnRenamed("label", "first").join(more.select(F.col("node").alias("first"), "label"), "first", "left").select("node", F.coalesce("label", "first").alias("label"))
    joined = joined.union(more.join(labels, "node", "left_anti").select("node", "label"))
    placed = nodes.select("node", "digest").join(joined, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    member = signed.select("id", "own", "row", "digest").join(placed, "digest", "left")
    # a text without words is a class of its own
    member = materialise(member.select("id", "own", "row", F.coalesce("label", -1 - F.col("row")).alias("label")), "near-member")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    # written, so that the join is with a plain table and Spark can split a class that very many rows share
    whole = materialise(member.groupBy("label").agg(first.alias("f"), F.count("*").alias("class_size")), "near-classes")
    discard(signed, nodes, buckets, needed, sets)
    return member.join(whole, "label").select("id", "own", F.col("f.id").alias("class_id"), "class_size", (F.col("row") == F.col("f.row")).alias("kept"))


def near_dedup(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, class_id, class_size, kept.

    class_id is the smallest key of the class (null keys last). Equal texts are in one class. A text of fewer than
    five words is one shingle; null and empty texts and those without words are classes of their own. Repeated rows
    are members like others, and one stays. Texts are read whole. Empty table: no rows. Columns other than key and
    text are not read.
    """
    return classes(docs, least, key, text).select(F.col("id").alias(key), "class_id", "class_size", "kept")


def keep_one(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with their own columns of any names.

    It is a row with the class's smallest key (null keys last). Null and empty texts and those without words stay. Of rows
    alike in key and text, the first by their other columns stays. Empty table: no rows.
    """
    return rows_of(docs, classes(docs, least, key, text).where("kept"), _own(text), key, text)
