"""Toxicity by maximum-scoring segments of token log-odds.

Learning. From labelled texts, features (a whole word, or a word's beginning) get the log-odds of toxic against
clean documents under an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008); near copies among the
learning rows count once. Features whose log-odds reach MIN_ODDS and exceed MIN_Z standard errors are kept.

Scoring. A token scores the largest log-odds of its features, any other token -GAP_COST. A linear-time scan (Ruzzo and
Tompa 1999) finds every maximal-scoring segment of a whole text. Under clean text, a segment's score S in n tokens
is of extreme-value type: it has exp(-(lambda S - ln(K n))) expected rivals (Karlin and Altschul 1990), lambda being
the root of E[exp(lambda s)] = 1 over clean tokens and K counted from clean texts. Segments with an expectation
under E_VALUE are the significant passages; the strongest, their sum and the sum of all are calibrated to a
probability by a logistic fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vexel.plans.storage import bounded_batches, materialise

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: Learning rows at most: those of smallest hashed doc_id. The model fits on these; all rows are scored.
MAX_ROWS = 20_000
#: A feature must be in this many toxic learning rows.
MIN_ROWS = 3
MIN_Z = 3.3
#: Least log-odds of a feature: common words that are only a little more frequent in toxic texts are no evidence.
MIN_ODDS = 1.0
GAP_COST = 0.5
#: A passage is significant below this many expected in clean text of the same length.
E_VALUE = 0.05
#: Distinct words a worker remembers.
MEMO = 100_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def segments(scores: Iterable[tuple[int, float]], gap_cost: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments, as (score, first token, last token), of a text given by its positive tokens.

    scores has (position, score) of the positive tokens in order; every other token costs gap_cost. Candidates
    are kept with the cumulative score before (l) and after (r) them. A new candidate joins the nearest earlier
    one with a smaller l, if its own r is larger than that one's, else it stands alone.
    """
    found: list[list[float]] = []  # l, r, first, last
    total, at = 0.0, -1
    for i, s in scores:
        total -= gap_cost * (i - at - 1)
        at = i
        new = [total, total + s, i, i]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(r - left, int(a), int(b)) for left, r, a, b in found]


class _Scores(dict):
    """Score of a word, remembered; 0 stands for a token without evidence."""

    def __init__(self, weights: dict[str, float]):
        self.whole = {f[1:]: s for f, s in weights.items() if f[0] == "="}
        self.begin = {f[1:]: s for f, s in weights.items() if f[0] == "^"}
        self.lengths = sorted({len(f) for f in self.begin})

    def __missing__(self, word: str) -> float:
        s = self.whole.get(word, 0.0)
        for k in self.lengths:
            if len(word) >= k and (b := self.begin.get(word[:k], 0.0)) > s:
                s = b
        if len(self) >= MEMO:
            self.clear()
        self[word] = s
        return s


@dataclass
class Model:
    weights: dict[str, float]
    lam: float
    log_k: float
    beta: list[float]

    def __post_init__(self):
        self._scores = _Scores(self.weights)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._scores = _Scores(self.weights)

    def passages(self, text: str | None) -> tuple[int, list[tuple[float, float, int, int]]]:
        """Number of tokens, and every maximal segment as (score, bits over chance, first token, last token)."""
        words = words_of(text)
        positive = [(i, s) for i, s in enumerate(map(self._scores.__getitem__, words)) if s > 0]
        if not positive:
            return len(words), []
        rival = self.log_k + math.log(len(words))
        return len(words), [(s, self.lam * s - rival, a, b) for s, a, b in segments(positive, GAP_COST)]

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        found = self.passages(text)[1]
        if not found:
            return 0.0, 0.0, 0.0
        floor = -math.log(E_VALUE)
        return (
            math.log1p(max(0.0, max(x[1] for x in found))),
            math.log1p(sum(x[1] for x in found if x[1] > floor)),
            math.log1p(sum(x[0] for x in found)),
        )

    def score(self, text: str | None) -> float:
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _tail(weights: list[float], shares: list[float], rest: float) -> float:
    """The positive root of E[exp(lambda s)] = 1; shares are of positive scores, rest of the other tokens."""

    def excess(lam: float) -> float:
        return sum(p * math.exp(min(700.0, lam * s)) for p, s in zip(shares, weights, strict=True)) + rest * math.exp(-lam * GAP_COST) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Weights of a ridge logistic fit by Newton's method, the intercept free."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in b]


def is_held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learning_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of the documents of at most max_rows labelled keys out of the held-out fold, near copies counted once.

    The sample is the labelled keys of smallest hash, so its broadcast has max_rows rows at most. Rows that repeat a key
    give its smallest text, so there are no more rows than keys.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = known.where(~is_held_out(F.col(key))).orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen.select(F.col(key).alias("k"), "toxic")), "k")
    rows = rows.groupBy("k", "toxic").agg(F.min("t").alias("t"))

    def sketch(texts: pa.Array) -> pa.Array:
        """The smallest hash of five words: equal for most near copies."""
        out = []
        for t in texts:
            w = words_of(t.as_py())
            out.append(min(xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))) >> 1)
        return pa.array(out, pa.int64())

    sketched = rows.select("t", "toxic", F.arrow_udf(sketch, "long")("t").alias("near"))
    return sketched.groupBy("near", "toxic").agg(F.min("t").alias("t")).select("t", F.col("toxic").cast("int").alias("toxic"))


def _counts(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(feature, n): in how many rows each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                own = {f for w in set(words_of(t.as_py())) for f in features_of(w)}
                seen.update(own if only is None else own & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    return rows.select("t").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """A model from labelled rows out of the held-out fold. All that comes to the driver is bounded by max_rows texts:
    features of MIN_ROWS toxic rows or more, and three numbers a row. Without rows of both kinds, the model gives
    every text the smoothed share of toxic rows."""
    rows = materialise(learning_rows(docs, labels, max_rows, key, text), "toxic-rows")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    base = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else math.log(0.1)
    if not n1 or not n0:
        return Model({}, 1.0, 0.0, [base, 0.0, 0.0, 0.0])
    toxic = {r.feature: r.n for r in _counts(rows.where("toxic = 1"), None).where(F.col("n") >= MIN_ROWS).collect()}
    clean = {r.feature: r.n for r in _counts(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    weights: dict[str, float] = {}
    for f, y1 in toxic.items():
        y0 = clean.get(f, 0)
        prior = 0.5 + 10 * (y1 + y0) / (n1 + n0)
        a, b = y1 + prior, y0 + prior
        odds = math.log(a / (n1 + 2 * prior - y1)) - math.log(b / (n0 + 2 * prior - y0)) if n1 + 2 * prior > y1 else 0.0
        if odds >= MIN_ODDS and odds / math.sqrt(1 / a + 1 / b) > MIN_Z:
            weights[f] = odds

    first = Model(weights, 1.0, 0.0, [0.0] * 4)

    def clean_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: Counter[float] = Counter()
        n = 0
        for b in batches:
            for t in b.column(0):
                w = words_of(t.as_py())
                n += len(w)
                scores.update(round(s, 6) for s in map(first._scores.__getitem__, w) if s > 0)
        scores[0.0] = n - sum(scores.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(scores), pa.float64()), pa.array(list(scores.values()), pa.int64())], ["s", "n"])

    seen = {r.s: r.n for r in rows.where("toxic = 0").select("t").mapInArrow(clean_tokens, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values()) + 1.0
    positive = sorted(s for s in seen if s > 0)
    if not positive and weights:  # none was met in clean text: half a token of the weakest
        positive, seen = [min(weights.values())], seen | {min(weights.values()): 0.5}
    lam = _tail(positive, [seen[s] / total for s in positive], seen.get(0.0, 0) / total) if positive else 1.0
    # K from the number of clean excursions at or above the weakest positive score
    log_k = math.log(max(0.5, sum(seen[s] for s in positive)) / total) + lam * positive[0] if positive else 0.0

    second = Model(weights, lam, log_k, [0.0] * 4)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [second.evidence(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in x], pa.float64()) for i in range(3)] + [b.column(1)], ["a", "b", "c", "y"])

    fit = rows.select("t", "toxic").mapInArrow(evidence, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    return Model(weights, lam, log_k, _logistic(fit[["a", "b", "c"]].to_numpy(), fit["y"].to_numpy(float)))


def score_of(text: Column, model: Model) -> Column:
    """The score of each text. Only the text goes to Python, in batches; whole texts are scanned."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted.

    Null and empty texts, and texts without evidence, get the calibrated probability of no evidence. Null keys
    count as the empty string for the fold. Repeated rows get equal scores; repeated labels of a key count as toxic
    if one does; null labels are ignored. Empty tables: no rows, or without labels the prior share. Columns of the
    same names as those made here are not read.
    """
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels, key=key, text=text)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    scored = rows.select(F.col("k").alias(key), is_held_out(F.col("k")).alias("held_out"), score_of(F.col("t"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def passages_of(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per significant passage: key, first and last token, score, bits, and its words."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, first int, last int, score double, bits double, passage string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (k, a, z, s, bits, " ".join(words_of(t)[a : z + 1]))
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for s, bits, a, z in model.passages(t)[1]
                if bits > -math.log(E_VALUE)
            ]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "first", "last", "score", "bits", "passage"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under threshold, with their own columns of any names.

    Null and empty texts are scored like texts without evidence, null keys are rows like others, and repeated rows stay or
    go together. Empty table: no rows. Without labels, the prior share decides.
    """
    bounded_batches(docs.sparkSession)
    return docs.where(score_of(F.col("text"), learn(docs, labels)) < threshold)
