"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the SIDE tokens on its left and the SIDE on its right: their embeddings feed one tanh
layer, and a two-level softmax (CLASSES classes of MEMBERS words) gives the token's probability. A document's score is
the sum of these conditional log-probabilities over all its tokens. Words outside the vocabulary share buckets by
their hash; the network gives the bucket's probability, and the share of the word's slot (one of SLOTS, by its hash) in
the bucket's count in the whole corpus makes it the word's.

Texts are cut into tokens once, and a token is its 64-bit hash from there on. Token counts come from every document, and
every token is a training target once; both are gathered by shuffles that grow with the corpus. Documents are dealt to
the rounds, and a round's documents into shards; every shard trains the current network in numpy where it lies, and the
shards' networks are averaged by their numbers of tokens, sixteen at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.plans.storage import bounded_batches, materialise

SIDE = 2
CLASSES, MEMBERS = 32, 64
BUCKETS, SLOTS = 256, 1 << 20
DIM, HIDDEN = 8, 32
#: Windows of a shard, and those of them that are in memory at a time.
SHARD_WINDOWS, AT_ONCE = 1_000_000, 2_000_000
ROUNDS = 3
BATCH, RATE = 2048, 0.4
#: Tokens that a partition counts before it hands the counts on, and characters that are hashed together.
COUNTED, CHARS = 2_000_000, 1 << 17
#: Networks that are added up in one task.
FAN = 16
#: Tokens that are scored together.
TOGETHER = 16_384

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Begins a token or stands between two, so a text can be cut there.
CUT = re.compile(r"\W")
VOCABULARY = CLASSES * MEMBERS
PAD = VOCABULARY

Params = dict[str, np.ndarray]

def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def _mixed(h: np.ndarray) -> np.ndarray:
    """uint64 whose every bit depends on every bit of h; one to one (the last step of splitmix64)."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class _Characters:
    """Of every code point its kind as TOKEN has it and a random number; powers of BASE and of its inverse."""

    SPACE, OTHER, WORD = range(3)
    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        self.kind = np.full(len(every), self.OTHER, np.uint8)
        for pattern, kind in ((r"\s+", self.SPACE), (r"\w+", self.WORD)):
            for m in re.finditer(pattern, every):
                self.kind[m.start() : m.end()] = kind
        self.number = _mixed(np.arange(1, len(every) + 1, dtype=np.uint64) * np.uint64(self.BASE))
        self.powers = self.inverse = np.empty(0, np.uint64)

    def reach(self, n: int) -> None:
        """Have n powers."""
        if len(self.powers) < n:
            self.powers, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of a text begins, and its hash: the numbers of its characters times powers, summed, mixed. A
        sum over a token is the difference of two sums from the text's beginning, brought to power 0."""
        self.reach(len(codes))
        kind = np.take(self.kind, codes)
        word, other = kind == self.WORD, kind == self.OTHER
        inside = word[1:] & word[:-1]  # a character and the one before are of one token
        starts, ends = word | other, word | other
        starts[1:] &= ~inside
        ends[:-1] &= ~inside
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(np.take(self.number, codes) * self.powers[: len(codes)], out=sums[1:])
        return starts, _mixed((sums[ends] - sums[starts]) * self.inverse[starts])


_characters: list[_Characters] = []


def _pieces(text: str) -> Iterator[str]:
    """text in parts of some CHARS characters, cut where no token is broken."""
    at = 0
    while len(text) - at > CHARS and (m := CUT.search(text, at + CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each text has, and the hashes (uint64) of all."""
    if not _characters:
        _characters.append(_Characters())
    counts: list[int] = []
    found, held, own, size = [np.empty(0, np.uint64)], [], [], 0

    def hash_held() -> None:
        codes = np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, h = _characters[0].hashes(codes)
        found.append(h)
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
        for i, n in zip(own, np.diff(ends, prepend=0).tolist(), strict=True):
            counts[i] += n

    for i, text in enumerate(texts):
        counts.append(0)
        for piece in _pieces((text or "").lower()):
            held.append(piece)
            own.append(i)
            size += len(piece) + 1
            if size >= CHARS:
                hash_held()
                held, own, size = [], [], 0
    if held:
        hash_held()
    return np.array(counts, np.int64), np.concatenate(found)


def hashed(text: str | None) -> np.ndarray:
    """uint64: the hashes of a text's tokens."""
    return token_hashes([text])[1]


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def slot_of(h: np.ndarray) -> np.ndarray:
    """A token's slot; slots of one bucket have numbers alike modulo BUCKETS."""
    return (h % np.uint64(SLOTS)).astype(np.int64)


class Ids:
    """A token's id: its place in the vocabulary, or a bucket after it. words are hashes, most frequent first."""

    def __init__(self, words: Iterable[int]):
        self.words = np.array([int(w) & (1 << 64) - 1 for w in words], np.uint64)
        self.factor, self.table = 0, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # made again where it is used

    def _key(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(self.factor)) >> np.uint64(44)

    def _fill(self) -> None:
        """A table of 20 bits that has each word's place at a key of its own, by the first factor that allows it."""
        rng = np.random.default_rng(0)
        while True:
            self.factor = int(rng.integers(1 << 63)) * 2 + 1
            keys = self._key(self.words)
            if len(np.unique(keys)) == len(np.unique(self.words)):
                break
        self.table = np.zeros(1 << 20, np.int16)
        self.table[keys[::-1]] = np.arange(len(keys))[::-1]

    def of(self, h: np.ndarray) -> np.ndarray:
        out = VOCABULARY - BUCKETS + bucket_of(h)
        if len(self.words):
            if self.table is None:
                self._fill()
            at = np.take(self.table, self._key(h))
            np.copyto(out, at, where=np.take(self.words, at) == h)
        return out


def place(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member of an id: neighbours in frequency go to different classes."""
    return ids % CLASSES, ids // CLASSES


def by_class(cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order that brings tokens of a class together, and where each class begins, with the end."""
    return np.argsort(cls.astype(np.uint8), kind="stable"), [0, *np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()]


def contexts(ids: np.ndarray) -> np.ndarray:
    """[token, 2 * SIDE]: the ids around each token, PAD beyond the ends."""
    padded = np.concatenate([np.full(SIDE, PAD), ids, np.full(SIDE, PAD)])
    n = len(ids)
    return np.stack([padded[k : k + n] for k in range(2 * SIDE + 1) if k != SIDE], axis=1)


def contexts_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """contexts of texts that lie one after the other, each of so many tokens."""
    at = np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(counts) + 1), counts)
    padded = np.full(len(ids) + SIDE * (len(counts) + 1), PAD, ids.dtype)
    padded[at] = ids
    return np.stack([padded[at + k] for k in range(-SIDE, SIDE + 1) if k], axis=1)


def fresh(counts: np.ndarray, seed: int = 3) -> Params:
    """A network whose output without a context is the corpus's word frequencies."""
    rng = np.random.default_rng(seed)
    table = np.log(counts.reshape(MEMBERS, CLASSES).T + 0.5)
    return {
        "E": (rng.standard_normal((VOCABULARY + 1, DIM)) * 0.1).astype(np.float32),
        "W": (rng.standard_normal((2 * SIDE * DIM, HIDDEN)) / math.sqrt(2 * SIDE * DIM)).astype(np.float32), "b": np.zeros(HIDDEN, np.float32),
        "A": np.zeros((HIDDEN, CLASSES), np.float32), "a": np.log(np.exp(table).sum(axis=1)).astype(np.float32),
        "B": np.zeros((CLASSES, HIDDEN, MEMBERS), np.float32), "c": table.astype(np.float32),
    }


def _tanh(z: np.ndarray) -> np.ndarray:
    """In place, by the exponential, which is the faster of the two."""
    z *= -2
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.divide(2, z, out=z)
    z -= 1
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each row, over the number of rows, in place."""
    if max(z.max(), -z.min()) > 40:  # else neither exp nor its sum leaves the range of single precision
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / (z @ np.full(z.shape[1], len(z), z.dtype)))[:, None]
    return z


def _head(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights over bias, shifted so that no logit of a hidden layer in [-1, 1] is above 0; the range must be safe."""
    high = (bias + np.abs(weights).sum(axis=0)).max()
    low = (bias - np.abs(weights).sum(axis=0)).min()
    if high - low > 80:  # exp would underflow in single precision
        weights, bias = weights.astype(np.float64), bias.astype(np.float64)
    return np.vstack([weights, (bias - high)[None, :]])


def _chosen(h1: np.ndarray, head: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log-softmax of the chosen columns of h1 @ head."""
    z = h1 @ head
    picked = z[np.arange(len(z)), column].astype(np.float64)
    np.exp(z, out=z)
    return picked - np.log(z @ np.ones(z.shape[1], z.dtype))


def prepared(p: Params) -> Params:
    """What log_probs needs: what each id adds to the hidden layer at each place, and the output layers."""
    return {
        "tables": np.ascontiguousarray(p["E"] @ p["W"].reshape(2 * SIDE, DIM, HIDDEN)), "b": p["b"],
        "classes": _head(p["A"], p["a"]), **{f"members{k}": _head(p["B"][k], p["c"][k]) for k in range(CLASSES)},
    }


def log_probs(p: Params, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its context; p is prepared here, unless it is already."""
    q = p if "tables" in p else prepared(p)
    cls, member = place(target)
    order, ends = by_class(cls)
    context, cls, member = context[order], cls[order], member[order]
    h1 = np.ones((len(target), HIDDEN + 1), q["b"].dtype)
    z = np.take(q["tables"][0], context[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        z += np.take(q["tables"][k], context[:, k], axis=0)
    z += q["b"]
    h1[:, :HIDDEN] = _tanh(z)
    found = _chosen(h1, q["classes"], cls)
    for k in range(CLASSES):
        a, b = ends[k], ends[k + 1]
        if a < b:
            found[a:b] += _chosen(h1[a:b], q[f"members{k}"], member[a:b])
    out = np.empty(len(target))
    out[order] = found
    return out


class Space(dict):
    """Arrays that are used again and again, by name and shape."""

    def of(self, name: str, *shape: int, like: np.ndarray) -> np.ndarray:
        key = (name, shape, like.dtype)
        if key not in self:
            self[key] = np.empty(shape, like.dtype)
        return self[key]


class Joined:
    """A network, or its gradients, in one array. W, A and B have their biases as a last row."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        shapes = (VOCABULARY + 1, DIM), (2 * SIDE * DIM + 1, HIDDEN), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, MEMBERS)
        ends = np.cumsum([0, *map(math.prod, shapes)])
        self.E, self.W, self.A, self.B = (flat[a:z].reshape(x) for a, z, x in zip(ends, ends[1:], shapes))

    @classmethod
    def of(cls, p: Params) -> Joined:
        return cls(np.concatenate([p["E"].ravel(), p["W"].ravel(), p["b"], p["A"].ravel(), p["a"], np.concatenate([p["B"], p["c"][:, None]], axis=1).ravel()]))

    def apart(self) -> Params:
        return {"E": self.E, "W": self.W[:-1], "b": self.W[-1], "A": self.A[:-1], "a": self.A[-1], "B": self.B[:, :-1], "c": self.B[:, -1]}


def gradients(p: Params, context: np.ndarray, target: np.ndarray) -> Params:
    """Of the mean negative log-probability."""
    own = Joined.of(p)
    g = Joined(np.empty_like(own.flat))
    _gradients(own, g, context, target, Space())
    return g.apart()


def _gradients(p: Joined, g: Joined, context: np.ndarray, target: np.ndarray, space: Space) -> None:
    """Fills g; space holds the layers."""
    n, E = len(target), p.E
    cls, member = place(target)
    order, ends = by_class(cls)
    context, cls, member = np.take(context, order, axis=0), cls[order], member[order]
    x = np.take(E, context, axis=0, out=space.of("x", n, 2 * SIDE, DIM, like=E), mode="clip").reshape(n, -1)
    h = np.matmul(x, p.W[:-1], out=space.of("h", n, HIDDEN, like=E))
    h += p.W[-1]
    _tanh(h)
    h1 = space.of("h1", n, HIDDEN + 1, like=E)
    h1[:, :HIDDEN], h1[:, HIDDEN] = h, 1
    rows, part = np.arange(n), E.dtype.type(1 / n)
    d = _softmax(np.matmul(h1, p.A, out=space.of("d", n, CLASSES, like=E)))
    d[rows, cls] -= part
    np.matmul(h1.T, d, out=g.A)
    dh = np.matmul(d, p.A[:-1].T, out=space.of("dh", n, HIDDEN, like=E))
    z = space.of("z", n, MEMBERS, like=E)
    parts = [(k, h1[a:b], z[a:b], dh[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
    for k, own, out, _ in parts:
        np.matmul(own, p.B[k], out=out)
    _softmax(z)
    z[rows, member] -= part
    if len(parts) < CLASSES:
        g.B.fill(0)
    for k, own, out, back in parts:
        np.matmul(own.T, out, out=g.B[k])
        back += out @ p.B[k, :-1].T
    np.multiply(h, h, out=h)
    np.subtract(1, h, out=h)
    dz = np.multiply(dh, h, out=dh)
    np.matmul(x.T, dz, out=g.W[:-1])
    np.matmul(np.ones(n, E.dtype), dz, out=g.W[-1])
    dx = np.matmul(dz, p.W[:-1].T, out=x).reshape(-1, DIM)
    at = context.ravel()
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    dx = np.take(dx, order, axis=0, out=space.of("dx", *dx.shape, like=E), mode="clip")
    pairs = np.result_type(E.dtype, np.complex64)  # two numbers are added as one complex number, which is faster
    g.E.fill(0)
    g.E[at[first]] = np.add.reduceat(dx.view(pairs), first, axis=0).view(E.dtype)


def train(p: Params, windows: np.ndarray, seed: int) -> Params:
    """One pass over windows [n, 2 * SIDE + 1] (context, then target) in a seeded order, by Adagrad."""
    own = Joined.of(p)
    g = Joined(np.empty_like(own.flat))
    scale, step = np.full_like(own.flat, 1e-3), np.empty_like(own.flat)
    order, space = np.random.default_rng(seed).permutation(len(windows)), Space()
    for at in range(0, len(order), BATCH):
        w = windows[order[at : at + BATCH]].astype(np.int64)
        _gradients(own, g, w[:, :-1], w[:, -1], space)
        scale += np.multiply(g.flat, g.flat, out=step)
        np.sqrt(scale, out=step)
        np.divide(g.flat, step, out=step)
        step *= RATE
        own.flat -= step
    return own.apart()


def pack(p: Params) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def unpack(data: bytes, like: Params) -> Params:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _split(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts).tolist()
    return [tokens[a:z].tobytes() for a, z in zip([0, *ends], ends)]


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, n, w) per row of docs: the number of tokens, and their hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h = token_hashes(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(_split(h, n), pa.binary())], ["k", "n", "w"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"k {kind}, n long, w binary")


def _hashes_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each token occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            for w in _hashes_of(b.column(0)):
                held.append(w)
                size += len(w)
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return texts.select("w").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _targets(texts: DataFrame, ids: Ids) -> DataFrame:
    """(row, n, w) per text with tokens: all their ids in 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = ids.of(np.concatenate([np.empty(0, np.uint64), *_hashes_of(b.column(2))])).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_split(own, b.column(1).to_numpy()), pa.binary())], ["row", "n", "w"])

    return texts.where("n > 0").select("row", "n", "w").mapInArrow(run, "row long, n long, w binary")


def windows_of(ids: np.ndarray) -> np.ndarray:
    """uint16 [token, 2 * SIDE + 1]: the context of every token, then the token."""
    return np.concatenate([contexts(ids), ids[:, None]], axis=1).astype(np.uint16)


def _round(targets: DataFrame, shards: int, p: Params, turn: int) -> Params:
    """Train p on every shard of targets (row, n, w) apart, and average."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            weighted = np.frombuffer(pack(own), np.float32).astype(np.float64) * n
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [n], "p": [weighted.tobytes()]})

        shard, own, n, parts, held = None, p, 0, [], 0
        for b in batches:
            for s, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if parts and (s != shard or held >= AT_ONCE):
                    own, n, parts, held = train(own, np.concatenate(parts), turn * 7919 + shard), n + held, [], 0
                if s != shard and n:
                    yield done()
                    own, n = p, 0
                shard = s
                parts.append(windows_of(np.frombuffer(w.as_py(), np.uint16).astype(np.int64)))
                held += len(parts[-1])
        if parts:
            own, n = train(own, np.concatenate(parts), turn * 7919 + shard), n + held
            yield done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total, n = None, None, 0
        for b in batches:
            for k, m, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = np.frombuffer(blob.as_py())
                shard, total, n = k if shard is None else shard, x if total is None else total + x, n + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [n], "p": [total.tobytes()]})

    # rows of equal texts have numbers of their own, so a text that very many rows share is spread over the shards
    dealt = targets.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "w").repartitionById(shards, "shard").sortWithinPartitions("shard", "row")
    sums = dealt.select("shard", "w").mapInArrow(one, "shard int, n long, p binary")
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        sums = sums.repartitionById(shards, F.pmod("shard", F.lit(shards))).sortWithinPartitions("shard").mapInArrow(add, "shard int, n long, p binary")
    rows = sorted((r.shard, r.n, bytes(r.p)) for r in sums.collect())
    if not rows:
        return p
    mean = sum(np.frombuffer(x) for _, _, x in rows) / sum(n for _, n, _ in rows)
    return unpack(mean.astype(np.float32).tobytes(), p)


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Ids, Params]:
    return learn_counts(tokens(docs.select(F.lit(0).alias("k"), F.col(f"`{text}`").alias("t")), "k", "t", rounds), rounds)[:2]


def tokens(docs: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """tokenised, with a number and a round for every row, written by rounds. Hashes of frequent words compress well."""
    rows = tokenised(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    return materialise(rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(rounds)).cast("int")), "lm-tokens", "zstd", "part")


def learn_counts(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Ids, Params, DataFrame]:
    """A vocabulary and a network from all texts (row, n, w, part), and the counts (h, n) of all tokens. The driver gets at most
    VOCABULARY hashes, and FAN sums of the network's size a round."""
    counts = materialise(_word_counts(texts), "lm-counts")
    top = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY - BUCKETS).collect()
    ids = Ids([r.h for r in top])
    n = texts.agg(F.sum("n")).first()[0] or 0
    frequency = np.zeros(VOCABULARY)
    frequency[: len(top)] = [r.n for r in top]
    frequency[-BUCKETS:] = (n - sum(r.n for r in top)) / BUCKETS
    p = fresh(frequency)
    for turn in range(rounds if n else 0):
        p = _round(_targets(texts.where(F.col("part") == turn), ids), math.ceil(n / rounds / SHARD_WINDOWS), p, turn)
    return ids, p, counts


def shares(counts: DataFrame, ids: Ids) -> np.ndarray:
    """Of each slot, the log of its part of its bucket's count outside the vocabulary; a slot without tokens counts as
    one. What the driver gets is SLOTS counts at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            rest = ids.of(h) >= VOCABULARY - BUCKETS
            yield pa.RecordBatch.from_arrays([pa.array(slot_of(h[rest]).astype(np.int32)), b.column(1).filter(pa.array(rest))], ["slot", "n"])

    rows = counts.select("h", "n").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    own = np.zeros(SLOTS)
    own[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    bucket = np.arange(SLOTS) % BUCKETS
    return (np.log(np.maximum(own, 1)) - np.log(np.bincount(bucket, own, BUCKETS) + 1)[bucket]).astype(np.float32)


def score(texts: DataFrame, ids: Ids, p: Params, share: np.ndarray | None = None) -> DataFrame:
    """k, n_tokens, log_likelihood (of all tokens) and mean_log_prob per row of texts (k, n, w). Without share, a token
    outside the vocabulary has its bucket's probability."""
    shared = texts.sparkSession.sparkContext.broadcast((pack(p), share))  # of fixed sizes
    like = {k: np.empty(v.shape, np.float32) for k, v in p.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, share = shared.value
        net = prepared(unpack(data, like))
        for b in batches:
            rows = _hashes_of(b.column(2))
            sizes = b.column(1).to_numpy()
            sums = np.zeros(len(rows))
            first = 0
            while first < len(rows):  # documents together, or a part of a long one at a time
                last, n = first, 0
                while last < len(rows) and (last == first or n + sizes[last] <= TOGETHER):
                    n += int(sizes[last])
                    last += 1
                h = np.concatenate(rows[first:last])
                target = ids.of(h)
                context = contexts_of(target, sizes[first:last])
                found = np.concatenate([np.empty(0), *(log_probs(net, context[a : a + TOGETHER], target[a : a + TOGETHER]) for a in range(0, n, TOGETHER))])
                if share is not None:
                    rest = target >= VOCABULARY - BUCKETS
                    found[rest] += share[slot_of(h[rest])]
                sums[first:last] = np.bincount(np.repeat(np.arange(last - first), sizes[first:last]), found, last - first)
                first = last
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums)], ["k", "n_tokens", "log_likelihood"])

    kind = texts.schema["k"].dataType.simpleString()
    out = texts.select("k", "n", "w").mapInArrow(run, f"k {kind}, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_prob", mean)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, log_likelihood, mean_log_prob, by a network trained on docs.

    Null, empty and blank texts: no tokens, likelihood 0, mean null. Null keys and repeated rows are documents like
    others. Whole texts of any length are scored, a part at a time. Empty table: no rows. Columns other than key and
    text are not read.
    """
    bounded_batches(docs.sparkSession)
    texts = tokens(docs, key, text)
    ids, p, counts = learn_counts(texts)
    return score(texts, ids, p, shares(counts, ids)).withColumnRenamed("k", key)
